"""Operator 3: near-duplicate embeddings by product quantisation over inverted lists.

Unit vectors fall into the list of their nearest coarse centroid; what remains is cut into subspaces
and each is replaced by the nearest of 256 codewords. A query compares itself with a list's codes by
asymmetric table lookups and reranks candidates by exact cosine. Two bounds make this
lossless, whatever the codebooks: a pair at distance d can only straddle two cells if the query lies within d of
the plane between their centroids (so exactly those lists are probed), and a lookup is off by no more than the
vector's own quantisation error, which is stored with its codes. Codebooks are fitted on a
bounded sample; they decide how much work is saved, not what is found.

Equal vectors with equal labels are one class that is compared once. Lists are cut into blocks, and a
block's queries into chunks, so that no task holds an unbounded list. A task returns
counts and a spanning forest of the links it found, never all pairs.

Defined cases: a vector that is null, empty or zero or has a null or non-finite component, and a vector with a
null label, links with nothing; so do vectors of different lengths. A null ``vec_id``
has component null and is kept; rows that share an id are one node of the components, and each has the links of its own
vector; rows that share an id and a vector link with each other. An empty table gives no row; further columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_groups, materialize
from .components import connected_components

#: Vectors that codebooks are fitted on, at most.
FIT_ROWS = 20_000
MOST_LISTS, SUBSPACES, CODES = 1024, 8, 256
#: Members of a list and queries that meet in one task.
BLOCK, CHUNK = 2048, 8192
_SLACK = 1e-6


def kmeans(x: np.ndarray, k: int, rounds: int = 8, seed: int = 7) -> np.ndarray:
    """Centroids by Lloyd's rounds; with fewer distinct rows than ``k``, fewer centroids."""
    x = np.unique(x, axis=0)
    rng = np.random.default_rng(seed)
    c = x[rng.permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        own = np.argmin((c**2).sum(1)[None, :] - 2 * x @ c.T, axis=1)
        n = np.bincount(own, minlength=len(c))
        order = np.argsort(own, kind="stable")
        sums = np.add.reduceat(x[order], np.concatenate([[0], np.cumsum(n)[:-1]]).clip(max=len(x) - 1), axis=0)
        c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], c)
    return c


@dataclass
class Codebooks:
    """Of one vector length: coarse centroids, and for each subspace its span and codewords."""

    coarse: np.ndarray
    spans: list[tuple[int, int]]
    words: list[np.ndarray]

    @classmethod
    def fit(cls, unit: np.ndarray, lists: int) -> Codebooks:
        coarse = kmeans(unit, lists)
        rest = unit - coarse[cls._nearest(unit, coarse)]
        cuts = np.linspace(0, unit.shape[1], min(SUBSPACES, unit.shape[1]) + 1).astype(int).tolist()
        spans = list(zip(cuts[:-1], cuts[1:], strict=True))
        return cls(coarse, spans, [kmeans(rest[:, a:b], CODES) for a, b in spans])

    @staticmethod
    def _nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
        return np.argmin((c**2).sum(1)[None, :] - 2 * x @ c.T, axis=1)

    def encode(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """List, codes and quantisation error of each vector."""
        own = self._nearest(unit, self.coarse)
        rest = unit - self.coarse[own]
        codes = np.stack([self._nearest(rest[:, a:b], w) for (a, b), w in zip(self.spans, self.words, strict=True)], axis=1)
        for m, ((a, b), w) in enumerate(zip(self.spans, self.words, strict=True)):
            rest[:, a:b] -= w[codes[:, m]]
        return own, codes.astype(np.uint8), np.sqrt((rest**2).sum(1))

    def probes(self, unit: np.ndarray, own: np.ndarray, distance: float) -> list[np.ndarray]:
        """Lists after the own one that can hold a vector within ``distance``; the own list comes first."""
        c = self.coarse
        score = (c**2).sum(1)[None, :] - 2 * unit @ c.T
        apart = np.sqrt(np.maximum(0, ((c[:, None, :] - c[None, :, :]) ** 2).sum(2)) if len(c) <= 256 else np.maximum(0, (c**2).sum(1)[:, None] + (c**2).sum(1)[None, :] - 2 * c @ c.T))
        near = score - score[np.arange(len(unit)), own][:, None] <= 2 * distance * apart[own] + _SLACK
        near &= np.arange(len(c))[None, :] > own[:, None]
        return [np.concatenate([[o], np.flatnonzero(row)]) for o, row in zip(own, near, strict=True)]

    def lookup(self, queries: np.ndarray, in_list: int, codes: np.ndarray) -> np.ndarray:
        """Approximate cosine of each query with each member of a list, from tables."""
        out = np.repeat((queries @ self.coarse[in_list])[:, None], len(codes), axis=1)
        for m, ((a, b), w) in enumerate(zip(self.spans, self.words, strict=True)):
            out += (queries[:, a:b] @ w.T)[:, codes[:, m]]
        return out


def unit_vectors(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1 in double precision; scaled by the largest part first, so that nothing overflows."""
    x = x.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def forest(links: np.ndarray, left: np.ndarray, right: np.ndarray) -> Iterator[tuple]:
    """Edges of a spanning forest of a bipartite link matrix; each row and column is looked at once."""
    todo = links.any(axis=1)
    free = np.ones(links.shape[1], bool)
    while todo.any():
        root = int(np.argmax(todo))
        todo[root] = False
        front = np.array([root])
        while len(front):
            reached = links[front] & free[None, :]
            cols = np.flatnonzero(reached.any(axis=0))
            yield from zip(left[front[np.argmax(reached[:, cols], axis=0)]].tolist(), right[cols].tolist(), strict=True)
            free[cols] = False
            back = links[:, cols] & todo[:, None]
            front = np.flatnonzero(back.any(axis=1))
            yield from zip(left[front].tolist(), right[cols[np.argmax(back[front], axis=1)]].tolist(), strict=True) if len(front) else ()
            todo[front] = False


_CODED = pa.schema([("cls", pa.int64()), ("label", pa.string()), ("dim", pa.int32()), ("size", pa.int64()), ("embedding", pa.list_(pa.float64())), ("list", pa.int32()), ("codes", pa.binary()), ("error", pa.float64()), ("probes", pa.list_(pa.int32()))])
_FOUND = "a long, b long, n long"


def near_embeddings(vectors: DataFrame, least: float = 0.98) -> DataFrame:
    """``vectors(vec_id, embedding, label)`` to vec_id, n_links, component_id, kept.

    Two vectors are linked if their labels are equal and their cosine is at least ``least``.
    """
    spark = vectors.sparkSession
    parts = F.col("embedding").cast("array<double>")
    bad = F.exists(parts, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    fits = F.col("label").isNotNull() & F.col("vec_id").isNotNull() & F.coalesce(~bad & F.exists(parts, lambda v: v != 0), F.lit(False))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.when(fits, F.col("label").cast("string")).alias("label"), F.when(fits, parts).alias("embedding"))
    # -0.0 and 0.0 are the same component
    rows = rows.withColumn("embedding", F.transform("embedding", lambda v: v + F.lit(0.0)))
    valid = materialize(rows.where("label IS NOT NULL"), "vectors")
    # Classes are numbered where they are written, as several can have the same smallest id.
    classes = valid.df.groupBy("label", "embedding").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("size"))
    classes = materialize(classes.withColumn("cls", F.monotonically_increasing_id()), "classes")
    total = classes.df.count()
    dims = [r["dim"] for r in classes.df.select(F.size("embedding").alias("dim")).distinct().collect()]
    books: dict[int, Codebooks] = {}
    for dim in dims:
        sample = classes.df.where(F.size("embedding") == dim).orderBy(F.xxhash64("rep", "label"), "embedding").limit(FIT_ROWS).select("embedding").toPandas()
        unit = unit_vectors(np.stack(sample["embedding"].to_numpy()))
        books[dim] = Codebooks.fit(unit, max(1, min(MOST_LISTS, int(math.sqrt(total) / 2), len(unit) // 8)))
    shared = spark.sparkContext.broadcast(books)
    distance = math.sqrt(2 - 2 * least)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = batch.to_pandas()
            dim = table["embedding"].map(len)
            for d, some in table.groupby(dim):
                for lo in range(0, len(some), 4096):
                    part = some.iloc[lo : lo + 4096]
                    unit = unit_vectors(np.stack(part["embedding"].to_numpy()))
                    own, codes, error = shared.value[d].encode(unit)
                    columns = [part["cls"], part["label"], [d] * len(part), part["size"], list(unit), own, [c.tobytes() for c in codes], error, shared.value[d].probes(unit, own, distance)]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _CODED.types, strict=True)], schema=_CODED)

    coded = materialize(classes.df.select("cls", "label", "size", "embedding").mapInArrow(code, "cls long, label string, dim int, size long, embedding array<double>, list int, codes binary, error double, probes array<int>"), "coded")
    # Blocks of each list's members and chunks of its queries, so that what meets in a task is bounded.
    cell = ["label", "dim", "list"]
    members = coded.df.groupBy(*cell).agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    asked = coded.df.select("label", "dim", F.explode("probes").alias("list")).groupBy(*cell).agg(F.ceil(F.count(F.lit(1)) / CHUNK).cast("int").alias("chunks"))
    cells = materialize(members.join(asked, cell).withColumn("size", (F.col("blocks") * BLOCK).cast("long")), "cells")
    deal = lambda n, salt: F.pmod(F.xxhash64("cls", F.lit(salt)), F.col(n)).cast("int")
    held = join_groups(coded.df.drop("probes").withColumnRenamed("size", "copies"), cells.df, cell, "size", total)
    held = held.withColumn("block", deal("blocks", 1)).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    asks = coded.df.select("cls", "label", "dim", F.col("size").alias("copies"), "embedding", F.col("list").alias("own"), F.explode("probes").alias("list"))
    asks = join_groups(asks, cells.df, cell, "size", total).withColumn("own_block", F.when(F.col("own") == F.col("list"), deal("blocks", 1)).otherwise(-1))
    asks = asks.withColumn("chunk", deal("chunks", 2)).withColumn("block", F.explode(F.sequence(F.greatest("own_block", F.lit(0)), F.col("blocks") - 1)))
    key = [*cell, "block", "chunk"]
    held = held.select(*key, "cls", "copies", "embedding", "codes", "error", F.lit(None).cast("int").alias("own_block"))
    asks = asks.select(*key, "cls", "copies", "embedding", F.lit(None).cast("binary").alias("codes"), F.lit(None).cast("double").alias("error"), "own_block")

    def search(group: tuple, table: pa.Table) -> pa.Table:
        _, dim, in_list, block, _ = (k.as_py() for k in group)
        rows = table.to_pandas()
        db, asking = rows[rows["codes"].notna()], rows[rows["codes"].isna()]
        found: list[tuple] = []
        if len(db) and len(asking):
            book = shared.value[dim]
            x, codes = np.stack(db["embedding"].to_numpy()), np.stack([np.frombuffer(c, np.uint8) for c in db["codes"]])
            cls, error, copies = (db[c].to_numpy() for c in ("cls", "error", "copies"))
            gained = np.zeros(len(db), np.int64)
            for lo in range(0, len(asking), 1024):
                some = asking.iloc[lo : lo + 1024]
                q, q_cls, q_copies = np.stack(some["embedding"].to_numpy()), some["cls"].to_numpy(), some["copies"].to_numpy()
                near = book.lookup(q, in_list, codes) + error[None, :] >= least - _SLACK
                # Within a block each pair meets twice, and each vector meets itself.
                near &= (some["own_block"].to_numpy() != block)[:, None] | (q_cls[:, None] < cls[None, :])
                i, j = np.nonzero(near)
                exact = np.concatenate([np.einsum("ij,ij->i", q[i[k : k + 65536]], x[j[k : k + 65536]]) for k in range(0, len(i), 65536)]) if len(i) else np.zeros(0)
                links = np.zeros(near.shape, bool)
                links[i[exact >= least], j[exact >= least]] = True
                if links.any():
                    gained += q_copies @ links
                    mine = links @ copies
                    found += [(int(a), None, int(n)) for a, n in zip(q_cls, mine, strict=True) if n]
                    found += [(a, b, 0) for a, b in forest(links, q_cls, cls)]
            found += [(int(a), None, int(n)) for a, n in zip(cls, gained, strict=True) if n]
        a, b, n = zip(*found, strict=True) if found else ((), (), ())
        return pa.table([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(n, pa.int64())], names=["a", "b", "n"])

    found = materialize(held.unionByName(asks).groupBy(*key).applyInArrow(search, _FOUND), "found")
    # Rows that share an id through different vectors are one node.
    placed = materialize(join_groups(valid.df, classes.df, ["label", "embedding"], "size", total).select("vec_id", "cls", "size"), "placed")
    several = placed.df.groupBy("vec_id").agg(F.min("cls").alias("a"), F.max("cls").alias("z")).where("a <> z").select("vec_id", "a")
    shared_ids = placed.df.join(several, "vec_id").where("a <> cls").select("a", F.col("cls").alias("b"))
    component = connected_components(found.df.where("b IS NOT NULL").select("a", "b").unionByName(shared_ids)).withColumnRenamed("node", "cls")
    counts = found.df.where("b IS NULL").groupBy(F.col("a").alias("cls")).agg(F.sum("n").alias("n"))
    done = classes.df.select("cls", "rep", "size").join(counts, "cls", "left").join(component, "cls", "left")
    done = materialize(done.select("cls", "rep", "size", (F.coalesce("n", F.lit(0)) + F.col("size") - 1).alias("n_links"), F.coalesce("component", "cls").alias("component")), "done").df
    least_ids = materialize(done.groupBy("component").agg(F.min("rep").alias("component_id"), F.count(F.lit(1)).alias("members")), "least").df
    named = materialize(join_groups(done, least_ids, ["component"], "members", total).select("cls", "size", "n_links", "component_id"), "named").df
    linked = materialize(join_groups(placed.df.drop("size"), named, ["cls"], "size", total).select("vec_id", "n_links", "component_id"), "linked").df
    for table in (valid, classes, coded, cells, found, placed):
        table.drop()
    alone = rows.where("label IS NULL").select("vec_id", F.lit(0).cast("long").alias("n_links"))
    alone = alone.join(linked.select("vec_id", "component_id").distinct(), "vec_id", "left").withColumn("component_id", F.coalesce("component_id", "vec_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
