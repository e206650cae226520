"""Queries on an index or any table of vectors: nearest neighbours, lookups, pages, counts.

A query is one plan over all routed collections. The best of a union are the best of the bests of its parts, so this gives what
asking each collection and merging would.
"""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass, field
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.predicates import metadata_column, where, where_document
from ..functions.vectors import METRICS
from ..sources import files

log = logging.getLogger("tessera")

#: Query vectors that are sent to every task at a time, about; rows of one scan and queries compared at a time.
MOST_QUERIES, _ROWS, _ASKED = 100_000, 4096, 256
#: Queries up to which expressions in generated code beat sending vectors to Python.
FEW_QUERIES = 8
INCLUDE_QUERY, INCLUDE_GET = ("metadata", "document", "distance"), ("metadata", "document")


@dataclass(frozen=True)
class Routing:
    """Which collections hold which models, as written by ``plans.lifecycle.routing``."""

    model_to_collections: Mapping[str, Mapping[str, Any]]
    collection_to_models: Mapping[str, Sequence[str]]
    metadata: Mapping[str, Any] = field(default_factory=dict)

    @classmethod
    def parse(cls, raw: Any) -> Routing:
        if not isinstance(raw, Mapping):
            raise ValueError("a routing is an object")
        if missing := {"model_to_collections", "collection_to_models", "metadata"} - set(raw):
            raise ValueError(f"a routing lacks {sorted(missing)}")
        return cls(raw["model_to_collections"], raw["collection_to_models"], raw["metadata"])

    def collections(self, models: Sequence[str] | None = None) -> list[str]:
        """The sorted collections of models, of all models if none are named; unknown ones have none."""
        if not models:
            return sorted(self.collection_to_models)
        return sorted({c for m in models for c in (self.model_to_collections.get(m) or {}).get("collections", ())})


def routed(index: DataFrame, routing: Routing | None, models: Sequence[str] | None = None, strict_models: bool = False) -> DataFrame:
    """Rows of the collections of ``models``. A collection may hold other models too; ``strict_models`` leaves these out."""
    if routing is not None:
        index = index.where(F.col("collection").isin(routing.collections(models)))
    return index.where(F.col("model_name").isin(list(models))) if strict_models and models else index


def filtered(rows: DataFrame, filters: Mapping[str, Any] | None, content: Mapping[str, Any] | None) -> DataFrame:
    if filters:
        rows = rows.where(where(filters, metadata_column(set(rows.columns))))
    return rows.where(where_document(content)) if content else rows


def _ranked(found: DataFrame, n: int, order: Sequence[Column | str]) -> DataFrame:
    """The first ``n`` of each query. Each task keeps ``n`` a query before rows are exchanged."""
    w = Window.partitionBy("query_idx").orderBy(*order)
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def nearest(rows: DataFrame, queries: DataFrame, n: int = 10, metric: str = "l2", id: str = "doc_id", vector: str = "embedding", ties: Sequence[str] = ()) -> DataFrame:
    """``queries(query_idx, query)`` against ``rows``: query_idx, rank, distance and all columns of rows but the vector.

    The queries go to every task, about ``MOST_QUERIES`` at a time, and rows are read once for each such part; a query without
    a vector finds nothing. For a handful the distance is an expression; else each task compares blocks of rows with all queries
    of a part and only sends on the ``n`` nearest of each block and query. Both order by distance, then ``ties``, then ``id``.
    """
    if metric not in METRICS:
        raise ValueError(f"metric is one of {sorted(METRICS)}")
    queries = queries.where(F.col("query").isNotNull())
    size = queries.count()
    order = ["distance", *ties, id]
    if size <= FEW_QUERIES:
        both = rows.crossJoin(F.broadcast(queries.select("query_idx", "query")))
        found = both.withColumn("distance", METRICS[metric](F.col(vector), F.col("query"))).drop("query", vector)
        return _ranked(found.where("distance IS NOT NULL"), n, order)
    parts = -(-size // MOST_QUERIES)
    found = None
    for part in range(parts):
        own = queries if parts == 1 else queries.where(F.pmod(F.xxhash64("query_idx"), F.lit(parts)) == part)
        one = _blockwise(rows, own, n, metric, vector, order[1:])
        found = one if found is None else found.unionByName(one)
    return _ranked(found, n, order)


def _blockwise(rows: DataFrame, queries: DataFrame, n: int, metric: str, vector: str, order: Sequence[str]) -> DataFrame:
    """The first ``n`` of each block of rows and query by distance and then ``order``, so that equally near rows are not taken at random."""
    table = queries.select("query_idx", "query").toPandas()
    vectors = np.stack(table["query"].to_numpy()).astype(np.float64) if len(table) else np.empty((0, 0))
    shared = rows.sparkSession.sparkContext.broadcast((table["query_idx"].to_numpy(), vectors))
    schema = rows.drop(vector).schema.add("query_idx", queries.schema["query_idx"].dataType).add("distance", "double")
    kept = [c for c in rows.columns if c != vector]

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, q = shared.value
        q2 = (q * q).sum(1)
        for batch in batches:
            for lo in range(0, batch.num_rows, _ROWS):
                some = batch.slice(lo, _ROWS)
                x = np.stack(some.column(vector).to_numpy(zero_copy_only=False)).astype(np.float64)
                x2, place = (x * x).sum(1), np.empty(len(x), np.int64)
                # nulls first, as Spark sorts
                place[pc.sort_indices(some.select(list(order)), sort_keys=[(c, "ascending") for c in order], null_placement="at_start").to_numpy()] = np.arange(len(x))
                for k in range(0, len(q), _ASKED):
                    i, j = _candidates(q[k : k + _ASKED], q2[k : k + _ASKED], x, x2, n, metric)
                    i += k
                    if metric == "l2":
                        exact = [((q[i[a : a + 65536]] - x[j[a : a + 65536]]) ** 2).sum(1) for a in range(0, len(i), 65536)]
                    else:
                        exact = [(q[i[a : a + 65536]] * x[j[a : a + 65536]]).sum(1) for a in range(0, len(i), 65536)]
                    exact = np.concatenate(exact)
                    if metric != "l2":
                        exact = 1 - exact / (np.sqrt(q2[i] * x2[j]) if metric == "cosine" else 1)
                    by = np.lexsort((place[j], exact, i))
                    i, j, exact = i[by], j[by], exact[by]
                    first = np.arange(len(i)) - np.searchsorted(i, i) < n
                    out = some.select(kept).take(pa.array(j[first]))
                    yield out.append_column("query_idx", pa.array(ids[i[first]])).append_column("distance", pa.array(exact[first]))

    return rows.where(F.col(vector).isNotNull()).mapInArrow(search, schema)


def _candidates(q: np.ndarray, q2: np.ndarray, x: np.ndarray, x2: np.ndarray, n: int, metric: str) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (query, row), by query, among them all rows that are not farther than the ``n``-th nearest by exact distance."""
    if n >= len(x):
        return np.repeat(np.arange(len(q)), len(x)), np.tile(np.arange(len(x)), len(q))
    d, slack = q @ x.T, 4 * np.finfo(np.float64).eps * (q.shape[1] + 8)  # of a product of unit vectors
    if metric == "l2":
        d, slack = q2[:, None] - 2 * d + x2[None, :], slack * (q2[:, None] + x2[None, :])
    elif metric == "cosine":
        d = 1 - d / np.sqrt(q2[:, None] * x2[None, :])
    else:
        d, slack = 1 - d, slack * (1 + np.sqrt(q2[:, None] * x2[None, :]))
    most = np.partition(d + slack, n - 1, axis=1)[:, n - 1 : n]
    return np.nonzero(~(d - slack > most))  # what is not a number stays, to be sorted last


def query(
    index: DataFrame,
    queries: DataFrame,
    n_results: int = 10,
    models: Sequence[str] | None = None,
    routing: Routing | None = None,
    filters: Mapping[str, Any] | None = None,
    content: Mapping[str, Any] | None = None,
    include: Sequence[str] = INCLUDE_QUERY,
    metric: str = "l2",
    strict_models: bool = False,
) -> DataFrame:
    """The ``n_results`` nearest documents of each query over all routed collections; ties by collection, then id."""
    rows = filtered(routed(index, routing, models, strict_models), filters, content)
    wanted = [c for c in ("collection", "doc_id", "embedding", "metadata", "document") if c in rows.columns and (c in ("collection", "doc_id", "embedding") or c in include)]
    found = nearest(rows.select(*wanted), queries, n_results, metric, ties=["collection"])
    return found.select("query_idx", "rank", "collection", "doc_id", *[c for c in ("distance", "metadata", "document") if c in include])


def get(
    index: DataFrame,
    ids: Sequence[str] | DataFrame | None = None,
    models: Sequence[str] | None = None,
    routing: Routing | None = None,
    filters: Mapping[str, Any] | None = None,
    content: Mapping[str, Any] | None = None,
    limit: int | None = None,
    offset: int = 0,
    include: Sequence[str] = INCLUDE_GET,
    per_collection: bool = False,
    id: str = "doc_id",
) -> DataFrame:
    """Documents by id and filters, in the order of collection and id; limit and offset count over all, or in each collection."""
    rows = filtered(routed(index, routing, models), filters, content)
    if isinstance(ids, DataFrame):
        rows = rows.join(ids.select(F.col(ids.columns[0]).alias(id)), id, "left_semi")
    elif ids is not None:
        rows = rows.where(F.col(id).isin(list(ids)))
    columns = [*[c for c in ("collection",) if c in rows.columns], id, *[c for c in include if c in rows.columns and c != id]]
    rows = rows.select(*columns)
    order = [c for c in ("collection", id) if c in columns]
    if limit is None and not offset:
        return rows
    if per_collection and "collection" in columns:
        w = Window.partitionBy("collection").orderBy(id)
        end = offset + limit if limit is not None else (1 << 62)
        return rows.withColumn("_n", F.row_number().over(w)).where((F.col("_n") > offset) & (F.col("_n") <= end)).drop("_n")
    page = rows.orderBy(*order).offset(offset)
    return page if limit is None else page.limit(limit)


def count(index: DataFrame, models: Sequence[str] | None = None, routing: Routing | None = None, filters: Mapping[str, Any] | None = None) -> DataFrame:
    """One row: the number of documents in the routed collections that pass the filters."""
    return filtered(routed(index, routing, models), filters, None).agg(F.count(F.lit(1)).alias("documents"))


def model_stats(index: DataFrame, model: str = "model_name") -> DataFrame:
    """Documents of each model; those without a name are counted as null."""
    return index.groupBy(F.nullif(F.col(model), F.lit("")).alias(model)).agg(F.count(F.lit(1)).alias("documents"))


def as_lists(found: Sequence[Row], n_queries: int) -> dict[str, list[list[Any]]]:
    """The rows of a query as parallel lists, one a query: a bounded number of rows for the caller of an API."""
    out: dict[str, list[list[Any]]] = {k: [[] for _ in range(n_queries)] for k in ("ids", "documents", "metadatas", "distances")}
    for r in found:
        row = r.asDict()
        out["ids"][r["query_idx"]].append(row["doc_id"])
        out["documents"][r["query_idx"]].append(row.get("document") or "")
        out["metadatas"][r["query_idx"]].append(row.get("metadata") or {})
        out["distances"][r["query_idx"]].append(row.get("distance", float("inf")))
    return out


class Client:
    """The query side of an index: query, get, count; a context manager that opens and closes it."""

    def __init__(self, spark: SparkSession, path: str, routing: Routing | Mapping[str, Any] | None = None, embedding_function=None) -> None:
        self.spark, self.path, self.embed = spark, path, embedding_function
        self.routing = Routing.parse(routing) if isinstance(routing, Mapping) else routing
        self.index: DataFrame | None = None

    def connect(self) -> Client:
        from .index import open_index

        self.index = open_index(self.spark, self.path)
        if self.index is None:
            raise FileNotFoundError(f"no index at {self.path}")
        return self

    def close(self) -> None:
        self.index = None

    __enter__ = connect

    def __exit__(self, *_) -> None:
        self.close()

    def _open(self) -> DataFrame:
        if self.index is None:
            raise RuntimeError("the client is not connected")
        return self.index

    def _rows(self, plan: Callable[[DataFrame], DataFrame], models: Sequence[str] | None = None) -> list[Row]:
        """The rows of a plan over all collections. If that fails, those of the plan over each collection, without collections that fail alone too."""
        index = self._open()
        try:
            return plan(index).collect()
        except (PySparkException, Py4JError) as e:
            log.error("asking each collection by itself: %s", str(e)[:500])
            unescape = self.spark.sparkContext._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.unescapePathName
            held = [unescape(d.removeprefix("collection=")) for d in files.listing(self.spark, self.path, directories=True) if d.startswith("collection=")]
            rows, failed = [], []
            for collection in held:
                if self.routing is not None and collection not in self.routing.collections(models):
                    continue
                try:
                    rows += plan(index.where(F.col("collection") == collection)).collect()
                except (PySparkException, Py4JError) as own:
                    log.error("collection %s failed: %s", collection, str(own)[:500])
                    failed.append(collection)
            if len(failed) == len(held):
                raise
            return rows

    def query(self, query_texts: Sequence[str] | None = None, query_embeddings: Sequence[Sequence[float]] | None = None, n_results: int = 10, **kwargs) -> dict[str, list[list[Any]]]:
        self._open()
        if query_embeddings is None:
            if not query_texts:
                raise ValueError("give texts or embeddings to look for")
            if self.embed is None:
                raise ValueError("texts need an embedding function")
            query_embeddings = self.embed(list(query_texts)).tolist()
        vectors = [(k, [float(x) for x in v]) for k, v in enumerate(query_embeddings)]
        if not vectors:
            raise ValueError("give texts or embeddings to look for")
        queries = self.spark.createDataFrame(vectors, "query_idx int, query array<double>")
        found = self._rows(lambda index: query(index, queries, n_results, routing=self.routing, **{**kwargs, "include": (*kwargs.get("include", INCLUDE_QUERY), "distance")}), kwargs.get("models"))
        best: list[Row] = []
        taken = [0] * len(vectors)
        for r in sorted(found, key=lambda r: (r["query_idx"], r["distance"], r["collection"], r["rank"])):
            if taken[r["query_idx"]] < n_results:
                taken[r["query_idx"]] += 1
                best.append(r)
        return as_lists(best, len(vectors))

    def get(self, **kwargs) -> DataFrame:
        return get(self._open(), routing=self.routing, **kwargs)

    def count(self, models: Sequence[str] | None = None, where: Mapping[str, Any] | None = None) -> int:
        return sum(r["documents"] for r in self._rows(lambda index: count(index, models, self.routing, where), models))
