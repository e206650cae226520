"""Operator 4: repeated runs of lines, by a suffix array over line sequences.

The corpus is a sequence of lines per document, and a line that occurs once ends every repeated run. So the strings of the suffix array are the stretches
of lines that occur again; each ends with a mark of its own, which sorts before all lines and by place (doc_id, line).
Lines are ordered by their ids (128-bit hashes). Prefix doubling orders suffixes by their first line, then by 2, 4, 8 ... lines: round k sorts by (rank by 2^k lines,
rank of the suffix 2^k lines on), and a suffix's rank is the place of the first suffix that is equal so far. Only suffixes that share their rank go on. Each sort is by ranges over
the distinct pairs, and ranks follow from a scan with one carried row a partition, so no group of equal suffixes meets in one task.

Where round k first tells two neighbours of the array apart, their longest common prefix has 2^k lines and what their tails share, which the ranks of earlier
rounds tell by halving. The suffixes that share their first L lines are an interval of the array: it begins at the last place before whose longest common prefix is
shorter than L. A second scan finds these beginnings for all runs at once, with a stack of at most L entries that partitions hand on.

For each line, the shortest run from it on and the shortest run up to it that have ``min_words``
words are looked up. If such a run's interval has an earlier suffix, the run is a later copy and its lines go; the
union of these runs over all lines is each maximal repeated run of ``min_words`` words, in full. A line has a word, so no such run has more
than ``min_words`` lines: doubling ends there, and suffixes that are still equal are in no order that matters. Earlier means a smaller doc_id, then an
earlier line. A copy that overlaps its original in the same document loses only what goes beyond the original.

Texts don't shuffle, but for documents that a Bloom filter can't rule out to lose lines.

Defined cases: lines without a word are no part of the sequence and go only inside a run that goes;
a null or empty text stays as it is; a null ``doc_id`` is smaller than others; rows equal in id and text
count as one document and are treated alike; an empty table gives no row; further columns are carried along, whatever their names.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from .bloom import build_filter, may_hold
from .common import join_groups, materialize
from .tokens import forget

#: Words that a repeated run needs.
MIN_WORDS = 50
#: Rows in a range that is sorted, about, and ranges at most.
RANGE_ROWS, MOST_RANGES = 50_000, 20_000

_LEAST_ID = -(1 << 63)
_SUFFIX = ["d", "h", "pos"]
_LINES = "d long, h long, pos int, id binary, ahead int, behind int"


def shortest_runs(words: list[int], min_words: int) -> tuple[list[int | None], list[int | None]]:
    """For each line the number of lines of the shortest run from it on, and up to it, with ``min_words`` words."""
    n = len(words)
    ahead: list[int | None] = [None] * n
    behind: list[int | None] = [None] * n
    end = total = 0
    for i in range(n):
        while end < n and total < min_words:
            total += words[end]
            end += 1
        if total < min_words:
            break
        ahead[i] = end - i
        total -= words[i]
    start = total = 0
    for i in range(n):
        total += words[i]
        while total - words[start] >= min_words:
            total -= words[start]
            start += 1
        if total >= min_words:
            behind[i] = i - start + 1
    return ahead, behind


def _sequence(min_words: int):
    types = [pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.int32(), pa.int32()]
    names = ["d", "h", "pos", "id", "ahead", "behind"]

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        out: list[list] = [[] for _ in types]
        for batch in batches:
            for d, h, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                split = [x for s in (text or "").split("\n") if (x := s.split())]
                ahead, behind = shortest_runs([len(x) for x in split], min_words)
                for pos, x in enumerate(split):
                    for column, value in zip(out, (d, h, pos, xxhash.xxh3_128_digest(" ".join(x)), ahead[pos], behind[pos]), strict=True):
                        column.append(value)
                if len(out[0]) > 20_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], names=names)
                    out = [[] for _ in types]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], names=names)

    return lines


def _shift(x: np.ndarray, first) -> np.ndarray:
    return np.concatenate([[first], x[:-1]]) if len(x) else x


_PAIR = ["g", "r2", "td", "th", "tpos", "c", "d", "h", "pos"]
_BEFORE = ["r2", "d", "h", "pos"]


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted pairs with what stands before them in this partition: the suffixes, and the pair before in the same group."""
    part, total, group, since, last = TaskContext.get().partitionId(), 0, None, -1, None
    for batch in batches:
        if not batch.num_rows:
            continue
        x = {n: batch.column(n).to_numpy(zero_copy_only=False) for n in _PAIR}
        at = total + np.cumsum(x["c"]) - x["c"]
        new = x["g"] != _shift(x["g"], x["g"][0] if group is None else group)
        begins = np.maximum.accumulate(np.where(new, np.arange(len(at)), -1))
        from_ = np.where(begins >= 0, at[begins], since)  # -1: in the partition's first group
        before = {n: _shift(x[n], -1 if last is None else last[n]) for n in _BEFORE}
        has = ~new
        has[0] &= last is not None
        total, group, since, last = int(at[-1] + x["c"][-1]), x["g"][-1], int(from_[-1]), {n: x[n][-1] for n in _BEFORE}
        columns = [pa.array(np.full(len(at), part, np.int32)), pa.array(at, pa.int64()), pa.array(from_, pa.int64()), pa.array(has), *(pa.array(before[n], batch.column(n).type) for n in _BEFORE)]
        yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in _PAIR), *columns], names=[*_PAIR, "part", "at", "from", "has", *(f"b{n}" for n in _BEFORE)])


_SCANNED = "g long, r2 long, td long, th long, tpos int, c long, d long, h long, pos int, part int, at long, from long, has boolean, br2 long, bd long, bh long, bpos int"
_CARRIED = "part int, offset long, start long, has0 boolean, cr2 long, cd long, ch long, cpos int"


def _small_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """Rows of the driver as a frame, through Arrow: else Spark would start further Python workers to read them."""
    fields = to_arrow_schema(StructType.fromDDL(schema))
    return spark.createDataFrame(pa.table([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(fields)], schema=fields))


def _ranges(rows: int) -> int:
    return min(MOST_RANGES, rows // RANGE_ROWS + 1)


def _placed(pairs: DataFrame, most: int) -> tuple[DataFrame, int, int]:
    """Pairs (g, r2, ...) of ``c`` suffixes, ``most`` at most, in order: ``place`` counts the suffixes of earlier pairs with the same g; the pair before comes along if g is the same.

    Also how many pairs have several suffixes, and how many come after a pair with the same g whose suffixes go on.
    """
    spark, order = pairs.sparkSession, ["g", "r2", "td", "th", "tpos"]
    ranged = pairs.repartitionByRange(_ranges(most), *order).sortWithinPartitions(*order).select(*_PAIR)
    scanned = materialize(ranged.mapInArrow(_scan, _SCANNED), "scanned").df
    ends = scanned.groupBy("part").agg(F.sum("c").alias("n"), F.min("g").alias("first"), F.max(F.struct("at", "g", "from", *_BEFORE)).alias("last"), F.count_if(F.col("c") > 1).alias("shared"), F.count_if(F.col("has") & (F.col("br2") >= 0)).alias("open")).collect()
    offset, start, last, carried = 0, 0, None, []
    n_shared = n_open = 0
    for e in sorted(ends, key=lambda e: e["part"]):  # one row a partition
        goes_on = last is not None and last["g"] == e["first"]
        start = start if goes_on else offset
        carried.append((e["part"], offset, start, goes_on, *((last[n] if goes_on else -1) for n in _BEFORE)))
        n_shared, n_open = n_shared + e["shared"], n_open + e["open"] + (goes_on and last["r2"] >= 0)
        last = e["last"]
        start = start if last["from"] < 0 else offset + last["from"]
        offset += e["n"]
    joined = scanned.join(F.broadcast(_small_table(spark, carried, _CARRIED)), "part")
    is_first = F.col("at") == 0
    place = F.col("offset") + F.col("at") - F.when(F.col("from") < 0, F.col("start")).otherwise(F.col("offset") + F.col("from"))
    before = [F.when(is_first, F.col(f"c{n}")).otherwise(F.col(f"b{n}")).alias(f"b{n}") for n in _BEFORE]
    return joined.select(*_PAIR, place.alias("place"), F.when(is_first, F.col("has0")).otherwise(F.col("has")).alias("has"), *before), n_shared, n_open


def _pairs(rows: DataFrame, g: Column, r2: Column, ended: Column) -> DataFrame:
    """Distinct (g, r2) with their numbers and one suffix of each; suffixes that end are pairs of their own, ordered by place."""
    of = lambda c: F.when(ended, F.col(c)).otherwise(0)
    keyed = rows.select(g.alias("g"), r2.alias("r2"), of("d").alias("td"), of("h").alias("th"), of("pos").cast("int").alias("tpos"), F.struct(*_SUFFIX).alias("s"))
    return keyed.groupBy("g", "r2", "td", "th", "tpos").agg(F.count(F.lit(1)).alias("c"), F.min("s").alias("s")).select("g", "r2", "td", "th", "tpos", "c", "s.*")


def suffix_array(lines: DataFrame, total: int, depth: int | None = None) -> tuple[DataFrame, DataFrame]:
    """``total`` rows of ``lines(d, h, pos, id)``, of which each id occurs more than once, to the suffix array and its longest common prefixes.

    The first frame has (d, h, pos, r): r is the place of the suffix that begins there. The second has (r, lcp): the lines that
    the suffix at r shares with the one before it. With a ``depth``, suffixes that share that many lines may have one place, that of the first.
    """
    few = _ranges(total)  # tasks that write a table of the rounds, whose rows are short
    ids = lines.groupBy("id").agg(F.count(F.lit(1)).alias("c"))
    # Ids are ordered by their bytes, seven at a time.
    seven = lambda k: F.conv(F.hex(F.substring("id", k, 7)), 16, 10).cast("long")
    rest = (seven(8), F.conv(F.hex(F.substring("id", 15, 2)), 16, 10).cast("int"))
    numbered = ids.select("id", F.lit(0).cast("long").alias("g"), seven(1).alias("r2"), rest[0].alias("td"), F.lit(0).cast("long").alias("th"), rest[1].alias("tpos"), "c", F.lit(0).cast("long").alias("d"), F.lit(0).cast("long").alias("h"), F.lit(0).alias("pos"))
    first, n_active, _ = _placed(numbered.drop("id"), total)
    named = materialize(numbered.select("id", "r2", "td", "tpos", "c").join(first.select("r2", "td", "tpos", F.col("place").alias("r")), ["r2", "td", "tpos"]).select("id", "c", "r").coalesce(few), "ids")
    # One table a round: each suffix's rank, and how many share it.
    level = materialize(join_groups(lines.select(*_SUFFIX, "id"), named.df, ["id"], "c", total).select(*_SUFFIX, "r", "c").coalesce(few), "ranks")
    bounds = [named.df.select("r", F.lit(0).alias("lcp"))]
    levels, splits, k = [], [], 0
    while (depth is None or 1 << k < depth) and n_active:
        levels.append(level)
        tails = level.df.select("d", "h", (F.col("pos") - (1 << k)).alias("pos"), F.col("r").alias("r2"))
        active = level.df.where("c > 1").select(*_SUFFIX, F.col("r").alias("r1"))
        pairs = materialize(active.join(tails, _SUFFIX, "left").withColumn("r2", F.coalesce("r2", F.lit(-1).cast("long"))).coalesce(few), "pairs")
        groups, n_active, n_open = _placed(_pairs(pairs.df, F.col("r1"), F.col("r2"), F.col("r2") < 0), total)
        groups = groups.withColumn("r", F.col("g") + F.col("place"))
        split = groups.where("has").select("r", F.lit(1 << k).alias("lcp"), (F.col("br2") >= 0).alias("open"), F.col("bd").alias("d1"), F.col("bh").alias("h1"), (F.col("bpos") + (1 << k)).alias("pos1"), F.col("d").alias("d2"), F.col("h").alias("h2"), (F.col("pos") + (1 << k)).alias("pos2"))
        bounds.append(split.where("NOT open").select("r", "lcp"))
        splits.append(split.where("open").drop("open") if n_open else None)
        columns = [*_SUFFIX, "r", "c"]
        after = level.df.where("c = 1").unionByName(groups.where("c = 1").select(columns))
        if n_active:
            shared = groups.where("c > 1").select(F.col("g").alias("r1"), "r2", "r", "c")
            after = after.unionByName(join_groups(pairs.df, shared, ["r1", "r2"], "c", total).select(columns))
        level = materialize(after.coalesce(few), "ranks")
        pairs.drop()
        k += 1
    # What tails share: fewer lines than 2^k, by halving.
    now_open: DataFrame | None = None
    for j in range(k - 1, -1, -1):
        opened = splits[j + 1] if j + 1 < k else None
        now_open = opened if now_open is None else now_open if opened is None else now_open.unionByName(opened)
        if now_open is None:
            continue
        left, right = (levels[j].df.select(F.col("d").alias(f"d{i}"), F.col("h").alias(f"h{i}"), F.col("pos").alias(f"pos{i}"), F.col("r").alias(f"r{i}")) for i in (1, 2))
        both = now_open.join(left, ["d1", "h1", "pos1"], "left").join(right, ["d2", "h2", "pos2"], "left")
        more = F.when(F.col("r1") == F.col("r2"), 1 << j).otherwise(0)
        now_open = materialize(both.select("r", (F.col("lcp") + more).alias("lcp"), "d1", "h1", (F.col("pos1") + more).alias("pos1"), "d2", "h2", (F.col("pos2") + more).alias("pos2")).coalesce(few), "open").df
    out = bounds[0]
    for more in [*bounds[1:], *([now_open.select("r", "lcp")] if now_open is not None else []), *(x for x in splits[:1] if x is not None)]:
        out = out.unionByName(more.select("r", "lcp"))
    for before in levels:
        before.drop()
    return level.df.select(*_SUFFIX, "r"), out


def _beginnings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted bounds (kind 0, n lines in common) and questions (kind 1, n lines) to where each question's interval begins; kind 2 hands the stack on."""
    part, stack, places = TaskContext.get().partitionId(), [], []
    types = [pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int64()]
    names = ["part", "r", "kind", "n", "begin"]

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x[i] for x in rows], t) for i, t in enumerate(types)], names=names)

    for batch in batches:
        out = []
        for r, kind, n in zip(*(batch.column(c).to_pylist() for c in ("r", "kind", "n")), strict=True):
            at = bisect_left(stack, n)  # entries that share fewer lines
            if kind == 0:
                stack[at:], places[at:] = [n], [r]
            else:
                out.append((part, r, 1, n, places[at - 1] if at else -1))
        yield batch_of(out)
    yield batch_of([(part, r, 2, n, -1) for n, r in zip(stack, places, strict=True)])


def interval_beginnings(bounds: DataFrame, questions: DataFrame, longest: int, most: int) -> DataFrame:
    """(r, n) of ``questions`` with ``begin``, the first place of the interval of suffixes that share n lines with the one at r."""
    spark = bounds.sparkSession
    rows = bounds.select("r", F.lit(0).alias("kind"), F.col("lcp").alias("n")).unionByName(questions.select("r", F.lit(1).alias("kind"), "n"))
    found = materialize(rows.repartitionByRange(_ranges(most), "r", "kind", "n").sortWithinPartitions("r", "kind", "n").mapInArrow(_beginnings, "part int, r long, kind int, n int, begin long"), "begins").df
    handed = found.groupBy("part").agg(F.collect_list(F.when(F.col("kind") == 2, F.struct("n", "r"))).alias("stack")).collect()  # a partition has as many entries as a run lines
    ends = {e["part"]: sorted((x["n"], x["r"]) for x in e["stack"]) for e in handed}
    stack, carried = [], [(-1, 0, 0)]
    for part in sorted(ends):
        for n in range(1, longest + 1):
            if (at := bisect_left(stack, n, key=lambda x: x[0])) > 0:
                carried.append((part, n, stack[at - 1][1]))
        if ends[part]:
            stack = [x for x in stack if x[0] < ends[part][0][0]] + ends[part]
    carry = F.broadcast(_small_table(spark, carried, "part int, n int, handed long"))
    return found.where("kind = 1").join(carry, ["part", "n"], "left").select("r", "n", F.when(F.col("begin") >= 0, F.col("begin")).otherwise(F.col("handed")).alias("begin"))


def later_copies(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """Runs that repeat an earlier run: d, h (a document's key), first, last (places among its lines with words)."""
    texts = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_LEAST_ID)).alias("d"), F.xxhash64(F.col("text").cast("string")).alias("h"), F.col("text").cast("string").alias("text"))
    lines = materialize(texts.mapInArrow(_sequence(min_words), _LINES), "lines")
    # Only lines that occur again are kept, whatever document they are in; equal rows give equal suffixes once.
    repeated = materialize(lines.df.groupBy("id").agg(F.count(F.lit(1)).alias("size")).where("size > 1"), "repeated")
    kept = materialize(join_groups(lines.df, repeated.df, ["id"], "size", lines.df.count()).drop("size").dropDuplicates(_SUFFIX), "kept")
    lines.drop()
    repeated.drop()
    about = kept.df.agg(F.count(F.lit(1)).alias("rows"), F.max(F.greatest("ahead", "behind")).alias("longest")).first()
    total, longest = about["rows"], about["longest"] or 0
    runs = kept.df.select("d", "h", F.col("pos").alias("first"), F.col("ahead").alias("n")).where("n IS NOT NULL")
    runs = runs.unionByName(kept.df.where("behind IS NOT NULL").select("d", "h", (F.col("pos") - F.col("behind") + 1).alias("first"), F.col("behind").alias("n"))).distinct()
    ranks, bounds = suffix_array(kept.df, total, longest)
    few = _ranges(total)
    named = materialize(runs.join(ranks.withColumnRenamed("pos", "first"), ["d", "h", "first"]).coalesce(few), "named")
    questions = materialize(named.df.groupBy("r", "n").agg(F.min(F.struct("d", "h", "first")).alias("origin"), F.count(F.lit(1)).alias("size")).coalesce(few), "questions")
    begins = materialize(interval_beginnings(bounds, questions.df, longest, 2 * total).coalesce(few), "begins")
    of = begins.df.join(questions.df, ["r", "n"])
    intervals = materialize(of.groupBy("begin", "n").agg(F.min("origin").alias("origin"), F.sum("size").alias("all"), F.count(F.lit(1)).alias("pairs")).where("all > 1").coalesce(few), "intervals")
    # From intervals to their (r, n), and to the runs.
    by_pair = materialize(join_groups(begins.df.join(questions.df.select("r", "n", "size"), ["r", "n"]), intervals.df, ["begin", "n"], "pairs", total).select("r", "n", "size", "origin").coalesce(few), "origins")
    copies = join_groups(named.df, by_pair.df, ["r", "n"], "size", total).where("origin <> struct(d, h, first)")
    same = (F.col("origin.d") == F.col("d")) & (F.col("origin.h") == F.col("h"))
    begin = F.when(same, F.greatest("first", F.col("origin.first") + F.col("n"))).otherwise(F.col("first"))
    copies = copies.select("d", "h", begin.alias("first"), (F.col("first") + F.col("n") - 1).alias("last")).where("first <= last").distinct()
    out = materialize(copies.coalesce(few), "copies")
    for table in (kept, named, questions, begins, intervals, by_pair):
        table.drop()
    return out.df


def without_lines(text: str, ranges: list[dict]) -> tuple[str, int]:
    """The text without the ranges of lines with words, and what is between these, and how many lines went."""
    lines, gone = text.split("\n"), 0
    at = [k for k, s in enumerate(lines) if s.split()]
    for r in ranges:
        for k in range(at[r["first"]], at[r["last"]] + 1):
            if lines[k] is not None:
                lines[k] = None
                gone += 1
    return "\n".join(x for x in lines if x is not None), gone


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs(doc_id, text, ...)`` to row (all columns of docs, text without later copies) and n_deleted (lines)."""
    copies = later_copies(docs, min_words)
    # Two ranges for each line of a document at most.
    per_doc = materialize(copies.groupBy("d", "h").agg(F.collect_list(F.struct("first", "last")).alias("ranges")), "ranges").df
    loses = docs.sparkSession.sparkContext.broadcast(build_filter(per_doc.select(F.xxhash64("d", "h").alias("k")), per_doc.count(), least=1))

    @F.arrow_udf("boolean")
    def may_lose(k: pa.Array) -> pa.Array:
        return pa.array(may_hold(k.to_numpy(zero_copy_only=False), loses.value))

    # 0 and the hash of no text are as good as any for a null: the row itself is kept.
    keyed = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_LEAST_ID)).alias("d"), F.xxhash64(F.col("text").cast("string")).alias("h"), F.col("text").cast("string").alias("text"), F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("row"))
    tested = keyed.withColumn("may", may_lose(F.xxhash64("d", "h")))
    # Always by a shuffle: the filter and the cut would else run in one task, each with a Python worker of its own.
    joined = tested.where("may").drop("may").join(per_doc.hint("merge"), ["d", "h"], "left").select("text", "ranges", "row")
    row_type = docs.drop("text").schema

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, gone = [], []
            for text, ranges in zip(batch.column("text"), batch.column("ranges"), strict=True):
                if not ranges.is_valid:
                    texts.append(text.as_py())
                    gone.append(0)
                else:
                    cut_text, n = without_lines(text.as_py(), ranges.as_py())
                    texts.append(cut_text)
                    gone.append(n)
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()), pa.array(gone, pa.int32()), batch.column("row")], names=["text", "n_deleted", "row"])

    lost = joined.mapInArrow(cut, StructType([StructField("text", StringType()), StructField("n_deleted", IntegerType()), StructField("row", row_type)]))
    whole = tested.where("NOT may").select("text", F.lit(0).alias("n_deleted"), "row")
    back = [F.col("text") if c == "text" else F.col("row").getField(c).alias(c) for c in docs.columns]
    return whole.unionByName(lost).select(F.struct(*back).alias("row"), "n_deleted")


#: The rows of (doc_id, n_deleted, text) in SQL for DuckDB, over a table ``documents`` without rows that share an id.
ORACLE_SQL = r"""
WITH t AS (
  SELECT row_number() OVER (ORDER BY doc_id NULLS FIRST, text) AS r, doc_id, text FROM (SELECT DISTINCT doc_id, text FROM documents WHERE text IS NOT NULL)
), all_lines AS (
  SELECT r, k, a[k] AS s, regexp_extract_all(a[k], '[^\s\x0b\x1c-\x1f\x{85}\p{Z}]+') AS words FROM (SELECT r, string_split(text, chr(10)) AS a, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS k FROM t)
), l AS (
  SELECT r, k, array_to_string(words, ' ') AS line, len(words) AS n, row_number() OVER w AS pos, sum(len(words)) OVER w AS upto FROM all_lines WHERE len(words) > 0 WINDOW w AS (PARTITION BY r ORDER BY k)
), runs AS (
  SELECT a.r, a.pos AS first, min(b.pos) AS last FROM l a JOIN l b ON a.r = b.r AND b.pos BETWEEN a.pos AND a.pos + 49 WHERE b.upto - a.upto + a.n >= 50 GROUP BY a.r, a.pos
  UNION SELECT b.r, max(a.pos), b.pos FROM l a JOIN l b ON a.r = b.r AND b.pos BETWEEN a.pos AND a.pos + 49 WHERE b.upto - a.upto + a.n >= 50 GROUP BY b.r, b.pos
), docs AS (SELECT r, list(line ORDER BY pos) AS lines, list(k ORDER BY pos) AS ks FROM l GROUP BY r
), named AS (
  SELECT r, first, last, min({'r': r, 'first': first}) OVER (PARTITION BY last - first, array_to_string(lines[first:last], chr(10))) AS o FROM runs JOIN docs USING (r)
), gone AS (
  SELECT DISTINCT r, unnest(range(ks[greatest(first, CASE WHEN o.r = r THEN o.first + last - first + 1 ELSE first END)], ks[last] + 1)) AS k
  FROM named JOIN docs USING (r) WHERE (o.r <> r OR o.first <> first) AND (o.r <> r OR o.first + last - first + 1 <= last)
), cut AS (
  SELECT r, count(gone.k) AS n_deleted, string_agg(s, chr(10) ORDER BY k) FILTER (WHERE gone.k IS NULL) AS text FROM all_lines LEFT JOIN gone USING (r, k) GROUP BY r
)
SELECT documents.doc_id, coalesce(n_deleted, 0)::INTEGER AS n_deleted, CASE WHEN documents.text IS NULL THEN NULL ELSE coalesce(cut.text, '') END AS text
FROM documents LEFT JOIN t ON documents.doc_id IS NOT DISTINCT FROM t.doc_id AND documents.text = t.text LEFT JOIN cut USING (r)
"""
