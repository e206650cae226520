"""Delimited files whose rows may be broken.

Files for which a column is named as malformed need repair: a row with too many cells has the surplus joined into that column
again, a row with too few takes in the physical rows that follow it. Taking in depends on what earlier rows
took, and a quoted cell can hold line ends, so a file's lines go through one task, in order and in batches: they are read in splits, dealt by file and
sorted by their place, which spills where a file is large. Files are read in parallel, all in one scan. ``read_clean``
takes Spark's own reader, without row numbers and rejects.
"""

from __future__ import annotations

import csv
import io
from collections.abc import Iterator, Sequence
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import strip
from ..spec import SourceConfig
from .files import _fs, discover

#: Where a row came from: the file's place in the order, and the row's number in it.
FILE, ROW = "_file", "_row"
_BATCH = 10_000


def repair(values: Column, width: int, malformed: int | None, delimiter: str) -> Column:
    """Join surplus cells into the ``malformed`` column (counted from 1); other rows stay as they are."""
    if malformed is None or malformed > width:
        return values
    after = width - malformed
    middle = F.array_join(F.slice(values, F.lit(malformed), F.size(values) - width + 1), delimiter)
    head = F.slice(values, 1, malformed - 1) if malformed > 1 else F.array().cast("array<string>")
    tail = F.slice(values, -after, after) if after else F.array().cast("array<string>")
    return F.when(F.size(values) > width, F.concat(head, F.array(middle), tail)).otherwise(values)


def repair_list(values: list[str], width: int, malformed: int | None, delimiter: str) -> list[str]:
    """The same for a list."""
    surplus = len(values) - width
    if malformed is None or malformed > width or surplus <= 0:
        return values
    k = malformed - 1
    return [*values[:k], delimiter.join(values[k : k + surplus + 1]), *values[k + surplus + 1 :]]


def logical_rows(rows: Iterator[tuple[int, list[str]]], width: int, malformed: int | None, delimiter: str) -> Iterator[tuple[int, list[str], bool]]:
    """(number, cells, whether the width is right). What a row took in is gone, also if that didn't mend it."""
    for number, cells in rows:
        cells = repair_list(cells, width, malformed, delimiter)
        while malformed is not None and len(cells) < width:
            more = next(rows, None)
            if more is None:
                break
            extra = more[1] or [""]
            cells = repair_list([*cells[:-1], f"{cells[-1] if cells else ''}\n{extra[0]}", *extra[1:]] if cells else list(extra), width, malformed, delimiter)
        yield number, cells, len(cells) == width


def header_of(spark: SparkSession, path: str, c: SourceConfig) -> list[str]:
    first = spark.read.option("encoding", c.character_encoding).text(path).limit(1).collect()
    if not first:
        return []
    line = first[0][0].removeprefix("﻿")
    cells = next(csv.reader([line], delimiter=c.delimiter), []) if len(c.delimiter) == 1 else line.split(c.delimiter)
    return [x.strip() for x in cells]


def _repaired(spark: SparkSession, paths: list[str], header: list[str], c: SourceConfig) -> DataFrame:
    """All rows of files with a column ``_ok``: whether the row has the header's width."""
    width, single = len(header), len(c.delimiter) == 1
    schema = pa.schema([(FILE, pa.int32()), (ROW, pa.int64()), ("_ok", pa.bool_()), ("_cells", pa.list_(pa.string()))])

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, str]]:
        for batch in batches:
            for order, raw in zip(batch.column("_order").to_pylist(), batch.column("value").to_pylist(), strict=True):
                value = raw.decode(c.character_encoding, "replace")
                if "\r" in value[:-1]:  # a line end of its own
                    yield from ((order, line) for line in io.StringIO(f"{value}\n", newline=""))
                else:
                    yield order, f"{value}\n"

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for order, own in groupby(lines(batches), key=lambda x: x[0]):
            own = (line.removeprefix("\ufeff") if k == 0 else line for k, (_, line) in enumerate(own))
            if single:
                physical = enumerate(csv.reader(own, delimiter=c.delimiter))
            else:
                physical = ((n, line.rstrip("\r\n").split(c.delimiter)) for n, line in enumerate(own))
            physical = ((n, [x.strip() for x in cells]) for n, cells in physical)
            if c.header_row == "all" or order == 0:
                next(physical, None)
            out: list[tuple] = []
            for n, cells, ok in logical_rows(physical, width, c.malformed_column, c.delimiter):
                out.append((order, n, ok, cells))
                if len(out) == _BATCH:
                    yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in out], schema=schema)
                    out = []
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in out], schema=schema)

    # Files of a source are in one directory, so their names, plain or as in a URI, tell them apart.
    names = {n: k for k, path in enumerate(paths) for n in (path.rpartition("/")[2], _fs(spark, path)[1].toUri().getRawPath().rpartition("/")[2])}
    order = spark.createDataFrame(list(names.items()), "name string, _order int")
    scan = spark.read.option("lineSep", "\n").option("encoding", c.character_encoding).text(paths)
    placed = scan.select(F.col("value").cast("binary").alias("value"), F.col("_metadata.file_name").alias("name"), F.col("_metadata.file_block_start").alias("_start"), F.monotonically_increasing_id().alias("_at"))
    dealt = placed.join(F.broadcast(order), "name").repartition("_order").sortWithinPartitions("_order", "_start", "_at")
    return dealt.select("_order", "value").mapInArrow(parse, f"{FILE} int, {ROW} long, _ok boolean, _cells array<string>")


def read_rows(spark: SparkSession, c: SourceConfig) -> tuple[DataFrame, DataFrame]:
    """(rows, rejects) of a source: strings named by the stripped header, with ``_file`` and ``_row``; rejects hold the cells of rows of another width."""
    paths = discover(spark, c.path)
    header = header_of(spark, paths[0], c)
    if not header:
        empty = spark.createDataFrame([], f"{FILE} int, {ROW} long")
        return empty, spark.createDataFrame([], f"{FILE} int, {ROW} long, _cells array<string>")
    rows = _repaired(spark, paths, header, c)
    good = rows.where("_ok").select(FILE, ROW, *[F.col("_cells")[k].alias(name) for k, name in enumerate(header)])
    return good, rows.where("NOT _ok").select(FILE, ROW, "_cells")


def read_clean(spark: SparkSession, paths: Sequence[str] | str, delimiter: str = ",", encoding: str = "utf-8") -> DataFrame:
    """Well-formed delimited files with a header, split by Spark's own reader: quoted line ends and doubled quotes are understood."""
    read = spark.read.option("header", True).option("sep", delimiter).option("encoding", encoding).option("multiLine", True).option("quote", '"').option("escape", '"')
    rows = read.csv(list(paths) if not isinstance(paths, str) else paths)
    return rows.select(*[strip(F.col(f"`{n}`")).alias(n.removeprefix("﻿").strip()) for n in rows.columns])
