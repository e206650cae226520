"""Operator 1: near-duplicate documents by BagMinHash.

A text is the multiset of its shingles of five lower-cased words. Each unit of a shingle's weight is a
Poisson process whose points fall on the signature's positions at random; position i holds the
first point that falls on it. Weights are cut into dyadic strips [0,1), [1,2), [2,4), [4,8) ... and a strip
that a weight fills only in part drops the points beyond it, so two multisets share position i with a probability
of exactly their weighted Jaccard similarity. Only points before a time by which all
positions are filled are made, about m ln m in all, however long the text is.

Signatures are banded. Candidates are verified by the overlap of their multisets. Texts that are
equal in words are one class from the start. Buckets that share documents form families, which are only an upper bound for
groups of near copies. A family meets in one task, or in blocks of ``BLOCK`` documents if it is larger, and there each document is
compared with members of its buckets until it is known which groups it links: a pair of a bucket is left out only if both are
already in one group. Of families with several blocks, buckets' smallest documents are compared with the others next. Then only buckets that still hold
several groups meet, each distinct set of members once: what is not in such a bucket's largest group is compared with its members, by blocks of both. So copies cost a
few comparisons each and never all pairs, a family costs no more than its buckets, however large it is, and no pair is a row.

Defined cases: texts of one to four words are one shingle; a null text, or one without words, is
similar to nothing; a null ``doc_id`` takes part in nothing (component null, kept); rows that share an
id count as one document and stay or go together; an empty table gives no row; further columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bloom import build_filter, may_hold
from .common import join_groups, materialize
from .components import connected_components
from .tokens import forget

SHINGLE, SIMILARITY = 5, 0.8
#: Bands and rows: a pair of similarity 0.8 is missed with a probability of 5e-4, one of 0.85 with 7e-6; one of 0.5 is compared with one of 0.32.
BANDS, ROWS = 25, 6

#: Documents of a family, or of a bucket, that meet in a task.
BLOCK = 1024

_words = re.compile(r"\w+").findall
_M1, _M2, _M3 = (np.uint64(x) for x in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0x9E3779B97F4A7C15))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: equal inputs to equal, well-spread outputs."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None) -> tuple[str, np.ndarray]:
    """The words joined by one space, and a hash of each shingle, with repeats."""
    words = _words((text or "").lower())
    if not words:
        return "", np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    n = max(1, len(words) - SHINGLE + 1)
    out = np.full(n, len(words) if len(words) < SHINGLE else SHINGLE, np.uint64)
    for k in range(min(SHINGLE, len(words))):
        out = mix(out * _M3 + h[k : k + n])
    return " ".join(words), out


def _points(state: np.ndarray, draw: np.ndarray, salt: int) -> np.ndarray:
    return mix(mix(state + draw * _M3) ^ np.uint64(salt * 0x632BE59BD9B4E019 & (1 << 64) - 1))


def _uniform(h: np.ndarray) -> np.ndarray:
    return ((h >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def _strip(signature: np.ndarray, keys: np.ndarray, weights: np.ndarray, low: int, width: int, until: float) -> None:
    """Add the points before ``until`` of the strip [low, low + width) of each key to the signature."""
    m = len(signature)
    state, t = mix(keys + mix(np.full(1, low, np.uint64) + _M3)), np.zeros(len(keys))
    first, step = 0, max(1, math.ceil(until * width + 2 * math.sqrt(until * width)))
    while len(state):
        step = min(step, max(1, 2_000_000 // len(state)))
        draw = np.arange(first, first + step, dtype=np.uint64)[None, :]
        times = t[:, None] + np.cumsum(-np.log(_uniform(_points(state[:, None], draw, 1))) / width, axis=1)
        row, col = np.nonzero(times < until)
        hit = state[row], draw[0][col]
        at = (_points(*hit, 2) % np.uint64(m)).astype(np.int64)
        within = low + _uniform(_points(*hit, 3)) * width < weights[row]
        np.minimum.at(signature, at[within], times[row, col][within])
        goes_on = times[:, -1] < until
        state, t, weights, first = state[goes_on], times[goes_on, -1], weights[goes_on], first + step


def bag_minhash(hashes: np.ndarray, m: int) -> np.ndarray:
    """Signature of a multiset of hashes; empty: all infinite."""
    keys, counts = np.unique(hashes, return_counts=True)
    signature = np.full(m, np.inf)
    if not len(keys):
        return signature
    until = m / len(hashes) * (math.log(m) + 1.5)
    while True:
        low, width = 0, 1
        while True:
            own = counts > low
            if not own.any():
                break
            _strip(signature, keys[own], counts[own], low, width, until)
            low, width = (1, 1) if low == 0 else (low + width, 2 * width)
        if np.isfinite(signature).all():
            return signature
        until *= 1.5


def band_hashes(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    bits = signature.view(np.uint64).reshape(bands, rows)
    out = np.arange(1, bands + 1, dtype=np.uint64)
    for k in range(rows):
        out = mix(out * _M3 + bits[:, k])
    return out.view(np.int64)


def multiset(hashes: np.ndarray) -> np.ndarray:
    """The multiset as a sorted set of 32-bit hashes of (shingle, how many before it)."""
    s = np.sort(hashes)
    new = np.concatenate([[True], s[1:] != s[:-1]])
    starts = np.flatnonzero(new)
    nth = np.arange(len(s)) - np.repeat(starts, np.diff(np.append(starts, len(s))))
    return np.unique((mix(s + nth.astype(np.uint64) * _M3) >> np.uint64(32)).astype(np.uint32))


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / max(1, len(a) + len(b) - both)


_SIGNED = pa.schema([("doc_id", pa.int64()), ("words", pa.binary()), ("n", pa.int64()), ("bands", pa.list_(pa.int64()))])
_ROWS_AT_ONCE = 1000


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    for batch in batches:
        for lo in range(0, batch.num_rows, _ROWS_AT_ONCE):
            some = batch.slice(lo, _ROWS_AT_ONCE)
            yield list(zip(*(c.to_pylist() for c in some.columns), strict=True))


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    forget()
    for some in _texts(batches):
        out: list[list] = [[], [], [], []]
        for doc_id, text in some:
            words, h = shingles(text)
            bands = band_hashes(bag_minhash(h, BANDS * ROWS), BANDS, ROWS).tolist() if len(h) else []
            for column, value in zip(out, (doc_id, xxhash.xxh3_128_digest(words), len(h), bands), strict=True):
                column.append(value)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, _SIGNED.types, strict=True)], schema=_SIGNED)


def _bags(wanted):
    """Multisets of the documents that may be wanted; others are dropped before anything shuffles."""

    def bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), ("words", pa.binary()), ("bag", pa.binary())])
        for batch in batches:
            batch = batch.filter(pa.array(may_hold(batch.column("h").to_numpy(zero_copy_only=False), wanted.value)))
            for some in _texts([batch.select(["doc_id", "text"])]):
                out: list[list] = [[], [], []]
                for doc_id, text in some:
                    words, h = shingles(text)
                    for column, value in zip(out, (doc_id, xxhash.xxh3_128_digest(words), multiset(h).tobytes()), strict=True):
                        column.append(value)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, schema.types, strict=True)], schema=schema)

    return bags


def _verify(least: float):
    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("bag_a"), batch.column("bag_b"), strict=True):
                a, b = (np.frombuffer(v.as_buffer(), np.uint32) for v in (x, y))
                short, long = sorted((len(a), len(b)))
                keep.append(short >= least * long and similarity(a, b) >= least)
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return verify


def _links(pairs: DataFrame, bags: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) whose multisets are similar."""
    named = materialize(pairs, "pairs")
    both = named.df.join(bags.select(F.col("doc_id").alias("a"), F.col("bag").alias("bag_a")), "a").join(bags.select(F.col("doc_id").alias("b"), F.col("bag").alias("bag_b")), "b")
    links = materialize(both.select("a", "b", "bag_a", "bag_b").mapInArrow(_verify(least), "a long, b long"), "links")
    named.drop()
    return links.df


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[list[tuple]]:
    """Rows of sorted batches, gathered by their first ``keys`` columns."""
    key, held = None, []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if row[:keys] != key:
                if held:
                    yield held
                key, held = row[:keys], []
            held.append(row[keys:])
    if held:
        yield held


class _Sets:
    """Disjoint sets."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def find(self, x: int) -> int:
        while self.up.setdefault(x, x) != x:
            self.up[x] = x = self.up[self.up[x]]
        return x

    def join(self, a: int, b: int) -> None:
        a, b = sorted((self.find(a), self.find(b)))
        self.up[b] = a


def _compare(rows: list[tuple], least: float) -> Iterator[tuple[int, int]]:
    """Links that join documents of a block: rows of (id, bands, bag)."""
    sets = _Sets()
    bands = np.array([r[1] for r in rows], np.int64)
    bags = [np.frombuffer(r[2], np.uint32) for r in rows]
    sizes = np.array([len(b) for b in bags])
    for k, (doc, own, _) in enumerate(rows):
        bag = bags[k]
        shares = (bands[:k] == np.array(own, np.int64)).any(axis=1)
        fits = np.minimum(sizes[:k], len(bag)) >= least * np.maximum(sizes[:k], len(bag))
        for j in np.flatnonzero(shares & fits).tolist():
            if sets.find(doc) != sets.find(rows[j][0]) and similarity(bag, bags[j]) >= least:
                sets.join(doc, rows[j][0])
                yield doc, rows[j][0]


_EDGES = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _edge_batch(edges: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([e[k] for e in edges], pa.int64()) for k in range(2)], schema=_EDGES)


def _within(least: float):
    """Links of a block's groups to their smallest document."""

    def within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _groups(batches, 2):
            sets = _Sets()
            for a, b in _compare(rows, least):
                sets.join(a, b)
            if sets.up:
                yield _edge_batch([(doc, sets.find(doc)) for doc in list(sets.up) if sets.find(doc) != doc])

    return within


def _across(least: float):
    """Links that join groups, of a bucket's asked rows with its held ones: rows of (bucket, block, chunk, asked, id, group, bag)."""

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _groups(batches, 3):
            asked, held = ([r[1:] for r in rows if r[0] == side] for side in (True, False))
            if not asked or not held:
                continue
            sets, found = _Sets(), []
            bags = [np.frombuffer(r[2], np.uint32) for r in held]
            sizes = np.array([len(b) for b in bags])
            for doc, group, bag in asked:
                bag = np.frombuffer(bag, np.uint32)
                for j in np.flatnonzero(np.minimum(sizes, len(bag)) >= least * np.maximum(sizes, len(bag))).tolist():
                    if sets.find(group) != sets.find(held[j][1]) and similarity(bag, bags[j]) >= least:
                        sets.join(group, held[j][1])
                        found.append((doc, held[j][0]))
            if found:
                yield _edge_batch(found)

    return across


def _between_blocks(full: DataFrame, leaders: DataFrame, within: DataFrame, least: float) -> DataFrame:
    """Links between the blocks of families that have several. ``full`` holds only these families' documents."""
    named = full.select("rep")
    pairs = leaders.join(named.select(F.col("rep").alias("b")), "b", "left_semi")
    bags = full.select(F.col("rep").alias("doc_id"), "bag")
    across = _links(pairs, bags, least)
    component = connected_components(within.unionByName(across)).withColumnRenamed("node", "rep")
    grouped = materialize(full.select("rep", "bands", "bag").join(component, "rep", "left").withColumn("component", F.coalesce("component", "rep")), "grouped")
    places = materialize(grouped.df.select("rep", "component", F.explode("bands").alias("bucket")), "places")
    # Buckets that still hold several groups; of buckets with the same members, one.
    held = places.df.groupBy("bucket", "component").agg(F.count(F.lit(1)).alias("c"), F.bit_xor(F.xxhash64("rep")).alias("s"), F.bit_xor(F.xxhash64("rep", F.lit(1))).alias("t"))
    mixed = held.groupBy("bucket").agg(F.max(F.struct("c", "component")).alias("top"), F.sum("c").alias("size"), F.count(F.lit(1)).alias("groups"), F.bit_xor("s").alias("s"), F.bit_xor("t").alias("t")).where("groups > 1")
    mixed = mixed.groupBy("size", "s", "t").agg(F.min(F.struct("bucket", "top")).alias("one")).select("one.bucket", F.col("one.top.component").alias("top"), "size", F.col("one.top.c").alias("c"))
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    mixed = materialize(mixed.select("bucket", "top", "size", blocks.alias("blocks"), F.ceil((F.col("size") - F.col("c")) / BLOCK).cast("int").alias("chunks")), "mixed")
    rows = join_groups(places.df, mixed.df, ["bucket"], "size", places.df.count())
    deal = lambda n, salt: F.pmod(F.xxhash64(F.lit(salt), "rep"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    kept = rows.withColumn("block", deal("blocks", 1)).withColumn("chunk", every("chunks")).withColumn("asked", F.lit(False))
    asked = rows.where("component <> top").withColumn("chunk", deal("chunks", 3)).withColumn("block", every("blocks")).withColumn("asked", F.lit(True))
    key = ["bucket", "block", "chunk"]
    met = kept.select(*key, "asked", "rep").unionByName(asked.select(*key, "asked", "rep")).join(grouped.df.select("rep", "component", "bag"), "rep")
    met = met.select(*key, "asked", "rep", "component", "bag").repartition(*key).sortWithinPartitions(*key, "asked", "rep")
    strays = materialize(met.mapInArrow(_across(least), "a long, b long"), "strays")
    for table in (grouped, places, mixed):
        table.drop()
    return across.unionByName(strays.df)


def near_duplicates(docs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """``docs(doc_id, text)`` to one row a document: doc_id, component_id, kept.

    ``component_id`` is the smallest id that links of at least ``least`` reach.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    known = rows.where("doc_id IS NOT NULL")
    signed = materialize(known.mapInArrow(_sign, "doc_id long, words binary, n long, bands array<long>"), "signed")
    some = signed.df.where("n > 0")
    classes = materialize(some.groupBy("words").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("size")), "classes").df
    # A class goes by its smallest id, but where an id is the smallest of several, by a hash for all of them but one.
    crowded = materialize(classes.groupBy("doc_id").agg(F.min("words").alias("least"), F.count(F.lit(1)).alias("c")).where("c > 1").select("doc_id", "least"), "crowded").df
    hashed = not crowded.isEmpty()
    rep = F.col("doc_id")
    if hashed:
        classes = classes.join(crowded, "doc_id", "left")
        rep = F.when(F.col("words") > F.col("least"), F.xxhash64("doc_id", "words")).otherwise(rep)
    classes = classes.select("doc_id", "words", "size", rep.alias("rep"))
    if hashed:
        classes = materialize(classes, "named").df
    reps = some.join(classes.select("doc_id", "words", "rep"), ["doc_id", "words"])
    reps = materialize(reps.groupBy("doc_id", "words").agg(F.min("rep").alias("rep"), F.min("bands").alias("bands")), "reps")
    members = materialize(reps.df.select("rep", F.explode("bands").alias("bucket")).distinct(), "members")
    total = members.df.count()
    buckets = materialize(members.df.groupBy("bucket").agg(F.min("rep").alias("leader"), F.count(F.lit(1)).alias("size")).where("size > 1"), "buckets")
    shared = join_groups(members.df, buckets.df, ["bucket"], "size", total)
    leaders = materialize(shared.where("leader <> rep").select(F.col("leader").alias("a"), F.col("rep").alias("b")).distinct(), "leaders")
    members.drop()
    buckets.drop()
    family = materialize(connected_components(leaders.df, "families").select(F.col("node").alias("rep"), F.col("component").alias("family")), "family")
    wanted = family.df.join(reps.df.select("rep", "doc_id"), "rep") if hashed else family.df.withColumnRenamed("rep", "doc_id")
    wanted = wanted.select(F.xxhash64("doc_id").alias("h"))
    kept = docs.sparkSession.sparkContext.broadcast(build_filter(wanted, family.df.count(), least=1))
    bags = known.withColumn("h", F.xxhash64("doc_id")).mapInArrow(_bags(kept), "doc_id long, words binary, bag binary")
    bags = bags.groupBy("doc_id", "words").agg(F.min("bag").alias("bag"))
    sizes = materialize(family.df.groupBy("family").agg(F.count(F.lit(1)).alias("size")).withColumn("blocks", F.ceil(F.col("size") / BLOCK).cast("int")), "sizes")
    placed = join_groups(family.df, sizes.df, ["family"], "size", total).withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    full = materialize(placed.join(reps.df, "rep").join(bags, ["doc_id", "words"]).select("family", "block", "rep", "bands", "bag", "blocks"), "full")
    met = full.df.select("family", "block", "rep", "bands", "bag").repartition("family", "block").sortWithinPartitions("family", "block", "rep")
    met_links = materialize(met.mapInArrow(_within(least), "a long, b long"), "links")
    links = met_links.df
    large = full.df.where("blocks > 1")
    if not large.isEmpty():
        links = links.unionByName(_between_blocks(large, leaders.df, links, least))
    # Rows that share an id through different texts are one document.
    placed = materialize(join_groups(some.select("doc_id", "words"), classes.drop("doc_id"), ["words"], "size", total).select("doc_id", "rep").distinct(), "placed")
    several = placed.df.groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("z")).where("a <> z").select("doc_id", "a")
    links = links.unionByName(placed.df.join(several, "doc_id").where("a <> rep").select("a", F.col("rep").alias("b")))
    component = connected_components(links).withColumnRenamed("node", "rep")
    for table in (signed, reps, leaders, family, sizes, full, met_links):
        table.drop()
    named = placed.df.groupBy("doc_id").agg(F.min("rep").alias("rep")).join(component, "rep", "left").select("doc_id", F.coalesce("component", "rep").alias("component"))
    if hashed:  # a component goes by its smallest id
        named = materialize(named, "components").df
        least_ids = named.groupBy("component").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("size"))
        named = join_groups(named, least_ids, ["component"], "size", named.count()).select("doc_id", F.col("first").alias("component"))
    out = rows.select("doc_id").join(named, "doc_id", "left")
    return out.select("doc_id", F.coalesce("component", "doc_id").alias("component_id"), (F.col("doc_id").isNull() | (F.coalesce("component", "doc_id") == F.col("doc_id"))).alias("kept"))


#: The same rows in SQL for DuckDB, over a table ``documents``: all pairs of texts that share a shingle are compared.
ORACLE_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS a FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL
), c AS (SELECT row_number() OVER () AS id, a FROM (SELECT DISTINCT a FROM w WHERE len(a) > 0)
), s AS (
  SELECT id, array_to_string(a[i:i + 4], ' ') AS shingle, count(*) AS n FROM (SELECT id, a, unnest(range(1, greatest(1, len(a) - 4) + 1)) AS i FROM c) GROUP BY ALL
), t AS (SELECT id, sum(n) AS total FROM s GROUP BY id
), pairs AS (SELECT x.id AS a, y.id AS b, sum(least(x.n, y.n)) AS same FROM s x JOIN s y ON x.shingle = y.shingle AND x.id < y.id GROUP BY ALL
), links AS (
  SELECT a, b FROM pairs JOIN t ta ON ta.id = a JOIN t tb ON tb.id = b WHERE same >= 0.8 * (ta.total + tb.total - same)
), d AS (SELECT DISTINCT doc_id, id FROM w JOIN c USING (a)
), edges AS (
  SELECT p.doc_id AS a, q.doc_id AS b FROM d p JOIN d q ON p.id = q.id WHERE p.doc_id <> q.doc_id
  UNION SELECT p.doc_id, q.doc_id FROM links JOIN d p ON p.id = a JOIN d q ON q.id = b
  UNION SELECT q.doc_id, p.doc_id FROM links JOIN d p ON p.id = a JOIN d q ON q.id = b
), reach AS (SELECT DISTINCT doc_id AS a, doc_id AS b FROM d UNION SELECT reach.a, edges.b FROM reach JOIN edges ON reach.b = edges.a
), least AS (SELECT a AS doc_id, min(b) AS component FROM reach GROUP BY a)
SELECT documents.doc_id, coalesce(component, documents.doc_id) AS component_id, documents.doc_id IS NULL OR coalesce(component, documents.doc_id) = documents.doc_id AS kept
FROM documents LEFT JOIN least ON documents.doc_id = least.doc_id
"""
