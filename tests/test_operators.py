"""Row, document and search operators against plain Python."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.operators import batches, documents, rows, sampling, search
from tessera.operators.index import HashingEmbedding, append, delete, drop_filter, embed, open_index
from tessera.spec import TableSpec
from tessera.streaming.append import append_new, new_rows, windowed_counts


def test_project_and_missing(spark):
    df = spark.createDataFrame([("1", " NA "), ("2", "na"), ("3", "N/A"), ("4", None), ("5", "x")], "a string, b string")
    assert rows.project(df, {}).columns == ["a", "b"]
    out = rows.project(df, {"id": "a", "t": "b", "gone": "nope"})
    assert [r.id for r in rows.drop_missing(out, ["t"]).orderBy("id").collect()] == ["2", "5"]
    assert rows.drop_missing(out, ["gone"]).count() == rows.drop_missing(out, ["not there"]).count() == 0
    r = rows.remap(df, {"c": "a", "d": "c", "e": "zz"}).where("a = '1'").first()
    assert (r.c, r.d, r.e, r.b) == ("1", "1", None, " NA ")
    assert rows.blanks_to_null(spark.createDataFrame([(" ", 1)], "s string, n int")).first() == (None, 1)


def test_dedupe_keeps_the_first_and_is_idempotent(spark):
    df = spark.createDataFrame([("m", "a", 2), ("m", "a", 1), ("m", None, 3), ("m", "", 4), ("n", "a", 5)], "model string, v string, k int")
    out = rows.dedupe_rows(df, ["v"], ["k"], by=["model"])
    assert sorted(r.k for r in out.collect()) == [1, 3, 5]
    assert rows.dedupe_rows(df, ["v"], ["k"], by=["model"], seen=out).count() == 0


def test_roll_over(spark):
    df = spark.range(0, 25).withColumnRenamed("id", "k")
    got = rows.count_by(rows.roll_over(df, 10, ["k"], 3), "partition_name").orderBy("partition_name").collect()
    assert [tuple(r) for r in got] == [("partition_00003", 10), ("partition_00004", 10), ("partition_00005", 5)]
    assert rows.roll_over(df, 0, ["k"]).select("partition_name").distinct().count() == 1
    assert [r._n for r in rows.number_rows(df, ["k"]).orderBy("k").collect()] == list(range(25))


def test_top_with_rest(spark):
    df = spark.createDataFrame([("a", 5), ("b", 9), ("c", 5), ("d", 1)], "m string, n long")
    assert [tuple(r) for r in rows.top_with_rest(df, "m", "n", 2).collect()] == [("b", 9), ("a", 5), (None, 6)]
    assert [r.m for r in rows.top_with_rest(df, "m", "n", 0).collect()] == ["b", "a", "c", "d"]
    assert rows.top_with_rest(df, "m", "n", 9).count() == 4


SPEC = TableSpec.of_strings("Thing", ["id"], ["title", "body"], semantic_fields=("body", "title"), keyword_fields=("id", "title"))


def test_documents(spark):
    df = spark.createDataFrame([("1", "T", " text "), ("2", "", None), (None, "x", "y"), ("1", "T", "text")], "id string, title string, body string")
    out = documents.build_documents(df, SPEC, extra={"schema_version": 3}, source_path="s.csv")
    by_doc = {r.document: r for r in out.collect()}
    assert len(by_doc) == 2 and out.count() == 3 and documents.first_documents(out).count() == 2
    assert by_doc["text\nT"].metadata == {"model_name": "Thing", "source_path": "s.csv", "id": "1", "title": "T", "schema_version": "3", "has_sem": "true"}
    plain = next(r for r in out.collect() if not r.has_sem)
    assert plain.document == '{"body":null,"id":"2","title":null}' and plain.doc_id.startswith("Thing:") and "title" not in plain.metadata
    with pytest.raises(ValueError):
        documents.build_documents(df, SPEC, strict=True)


def test_typed_rows(spark):
    from pyspark.sql.types import BooleanType, DateType, IntegerType, StructField, StructType

    spec = TableSpec("N", StructType([StructField("n", IntegerType(), False), StructField("d", DateType()), StructField("b", BooleanType())]))
    df = spark.createDataFrame([("1", "2024-01-02", "true"), ("x", None, None), ("2", "soon", None), (" ", None, None), ("3", None, " ")], "n string, d string, b string")
    good, bad = documents.typed(df, spec)
    assert sorted(r.n for r in good.collect()) == [1, 3] and bad.count() == 3


def test_checked_rows(spark):
    from pyspark.sql.types import IntegerType, StringType, StructField, StructType

    def check(row):
        if row["v"] == "none":
            return None
        return {"n": int(row["v"]), "v": row["v"].upper()}

    df = spark.createDataFrame([("1",), ("x",), ("none",), (None,)], "v string")
    schema = StructType([StructField("n", IntegerType()), StructField("v", StringType())])
    assert [tuple(r) for r in documents.checked(df, check, schema).collect()] == [(1, "1")]


def test_retries():
    from tessera.operators.index import RateLimited, Retrying

    calls = []

    def limited(texts):
        calls.append(texts)
        if len(calls) < 3:
            raise RateLimited
        return np.zeros((len(texts), 2))

    assert Retrying(limited, 5, 0.0)(["a"]).shape == (1, 2) and len(calls) == 3
    calls.clear()
    with pytest.raises(RateLimited):
        Retrying(limited, 1, 0.0)(["a"])


def test_compaction_and_tokens(spark):
    big = "word " * 20
    df = spark.createDataFrame([("a", "x", "M"), ("b", big, "M"), ("c", "NEW-PAGE 7 RESETN3 RESET  N12 a *****   b" + "é" * 40, "Table")], "doc_id string, document string, model_name string")
    out = {r.doc_id: r for r in documents.compact(df, 60).collect()}
    assert (out["a"].compacted, out["a"].original_bytes) == (False, None)
    assert out["b"].compacted and out["b"].compaction_fallback and len(out["b"].document.encode()) <= 60 and out["b"].original_bytes == 100
    assert out["c"].document.startswith(" a b") and len(out["c"].document.encode()) <= 60
    cut = {r.doc_id: r for r in documents.limit_tokens(df, 10).collect()}
    assert not cut["a"].truncated and cut["b"].truncated and cut["b"].original_tokens == 20 and cut["b"].tokens <= 10 and cut["b"].truncation_strategy == "middle_out"
    by_chars = {r.doc_id: r for r in documents.limit_tokens(df, 30, "end", count=len).collect()}
    assert by_chars["b"].tokens <= 30 and by_chars["a"].truncation_strategy is None


def test_sample(spark):
    df = spark.range(100).select(F.col("id").alias("k"), (F.col("id") % 3).alias("g"))
    one = [tuple(r) for r in sampling.stable_sample(df, 4, ["g"], "k", 1).orderBy("g", "k").collect()]
    assert len(one) == 12 and one == [tuple(r) for r in sampling.stable_sample(df.repartition(7), 4, ["g"], "k", 1).orderBy("g", "k").collect()]
    assert one != [tuple(r) for r in sampling.stable_sample(df, 4, ["g"], "k", 2).orderBy("g", "k").collect()]
    with pytest.raises(ValueError):
        sampling.stable_sample(df, 0, ["g"], "k")


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(0, 40), max_size=40), st.integers(1, 5), st.integers(5, 30))
def test_batches_keep_their_limits(tokens, size, limit):
    out = batches.assign(tokens, size, limit, 35)
    assert [b is None for b in out] == [n > 35 for n in tokens]
    for b in {x for x in out if x is not None}:
        own = [n for n, x in zip(tokens, out, strict=True) if x == b]
        assert len(own) <= size and (sum(own) <= limit or len(own) == 1)


def test_batches_by_model(spark):
    data = [(i, "a" if i % 3 else "b", (i * 7) % 40) for i in range(60)]
    df = spark.createDataFrame(data, "k int, model_name string, tokens int")
    got = {r.k: r.batch_id for r in batches.pack_batches(df, "k", size=4, limit=60, most=38).collect()}
    for m in "ab":
        own = [d for d in data if d[1] == m]
        assert [got[d[0]] for d in own] == batches.assign([d[2] for d in own], 4, 60, 38)


ROUTING = search.Routing.parse(
    {
        "model_to_collections": {"Table": {"collections": ["c1", "c2"]}, "Field": {"collections": ["c2", "c3"]}, "Domain": {"collections": ["c3"]}},
        "collection_to_models": {"c1": ["Table"], "c2": ["Table", "Field"], "c3": ["Field", "Domain"]},
        "metadata": {},
    }
)


def test_routing_rules():
    assert ROUTING.collections() == ROUTING.collections([]) == ["c1", "c2", "c3"]
    assert ROUTING.collections(["Table"]) == ["c1", "c2"] and ROUTING.collections(["Table", "Domain"]) == ["c1", "c2", "c3"]
    assert ROUTING.collections(["Nope"]) == []
    for bad in ([], {"model_to_collections": {}}):
        with pytest.raises(ValueError):
            search.Routing.parse(bad)


@pytest.fixture(scope="module")
def index_frame(spark):
    rng = np.random.default_rng(3)
    data = [(f"c{k % 3 + 1}", f"d{k:03}", ["Table", "Field", "Domain"][k % 3], f"text {k}", rng.normal(size=8).tolist()) for k in range(300)]
    data += [("c1", "same", "Table", "x", data[0][4]), ("c2", "same", "Table", "x", data[0][4])]
    return spark.createDataFrame(data, "collection string, doc_id string, model_name string, document string, embedding array<double>")


@pytest.mark.parametrize("n_queries", [2, 20])
@pytest.mark.parametrize("metric", ["l2", "cosine", "ip"])
def test_query_is_the_merge_of_collections(spark, index_frame, n_queries, metric):
    data = index_frame.toPandas()
    qs = [(k, list(data["embedding"][k])) for k in range(n_queries)]
    queries = spark.createDataFrame(qs, "query_idx int, query array<double>")
    got = search.query(index_frame, queries, 5, ["Table"], ROUTING, include=["distance", "document"], metric=metric).orderBy("query_idx", "rank").collect()
    x = np.stack(data["embedding"])
    for k, q in qs:
        q = np.array(q)
        d = {"l2": ((x - q) ** 2).sum(1), "ip": 1 - x @ q, "cosine": 1 - x @ q / np.linalg.norm(x, axis=1) / np.linalg.norm(q)}[metric]
        merged = sorted((round(float(v), 9), c, i) for v, c, i in zip(d, data["collection"], data["doc_id"], strict=True) if c in ("c1", "c2"))[:5]
        own = [r for r in got if r.query_idx == k]
        assert [r.distance for r in own] == pytest.approx([v for v, _, _ in merged], abs=1e-6)
        assert [r["rank"] for r in own] == [1, 2, 3, 4, 5]
    assert {r.collection for r in got} <= {"c1", "c2"}


@pytest.mark.parametrize("n_queries", [2, 20])
@pytest.mark.parametrize("metric", ["l2", "cosine", "ip"])
def test_equally_near_rows_go_by_ties_and_id(spark, metric, n_queries):
    rng = np.random.default_rng(5)
    same, ids = rng.normal(size=8).tolist(), rng.permutation(400).tolist()
    data = [("b" if k % 2 else "a", f"{k:03}", same if k < 300 else (-k * np.array(same)).tolist()) for k in ids]
    rows = spark.createDataFrame(data, "c string, id string, embedding array<double>").coalesce(1)
    queries = spark.createDataFrame([(k, same) for k in range(n_queries)], "query_idx int, query array<double>")
    for ties, want in (([], [f"{k:03}" for k in range(5)]), (["c"], [f"{k:03}" for k in range(0, 10, 2)])):
        got = search.nearest(rows, queries, 5, metric, id="id", ties=ties).orderBy("query_idx", "rank").collect()
        assert [r.id for r in got] == want * n_queries


def test_more_queries_than_are_sent_at_a_time(spark, monkeypatch):
    rng = np.random.default_rng(6)
    x = rng.integers(-9, 9, (60, 4)).astype(float)
    rows = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "id long, embedding array<double>")
    asked = [(k, v.tolist()) for k, v in enumerate(x[:40])] + [(40, None)]
    monkeypatch.setattr(search, "MOST_QUERIES", 12)
    got = search.nearest(rows, spark.createDataFrame(asked, "query_idx long, query array<double>"), 3, id="id").orderBy("query_idx", "rank").collect()
    want = [(k, int(j)) for k in range(40) for j in np.lexsort((np.arange(60), ((x - x[k]) ** 2).sum(1)))[:3]]
    assert [(r.query_idx, r.id) for r in got] == want


def test_routing_does_not_filter_rows(spark, index_frame):
    assert search.count(index_frame, ["Table"], ROUTING).first().documents == 202
    assert search.routed(index_frame, ROUTING, ["Table"], strict_models=True).select("model_name").distinct().count() == 1
    assert search.count(index_frame, ["Nope"], ROUTING).first().documents == 0
    assert search.count(index_frame, None, ROUTING, {"model_name": "Table"}).first().documents == 102


def test_get(spark, index_frame):
    ids = ["d001", "d002", "zzz"]
    assert {r.doc_id for r in search.get(index_frame, ids).collect()} == {"d001", "d002"}
    listed = spark.createDataFrame([(i,) for i in ids], "i string")
    assert search.get(index_frame, listed).count() == 2
    assert [r.doc_id for r in search.get(index_frame, limit=3, offset=1, filters={"collection": "c1"}).collect()] == ["d003", "d006", "d009"]
    assert search.get(index_frame, limit=2, per_collection=True).count() == 6
    assert search.get(index_frame, content={"$contains": "text 29"}, include=["document"]).count() == 11


def test_index_and_client(spark, tmp_path):
    path = str(tmp_path / "index")
    assert open_index(spark, path) is None and delete(spark, path, {"model_name": "A"}) == 0
    docs = [(f"p{k % 2}", "A" if k % 3 else "B", f"d{k}", f"number {k} of many", "1") for k in range(20)]
    df = spark.createDataFrame(docs, "collection string, model_name string, doc_id string, document string, schema_version string").withColumn("partition_name", F.col("collection")).withColumn("metadata", F.create_map(F.lit("k"), F.col("doc_id")))
    full = embed(df, HashingEmbedding(256))
    append(spark, full.unionByName(full.limit(3)), path)
    append(spark, full, path)
    assert open_index(spark, path).count() == 20
    routing = {"model_to_collections": {"A": {"collections": ["p0", "p1"]}, "B": {"collections": ["p0"]}}, "collection_to_models": {"p0": ["A", "B"], "p1": ["A"]}, "metadata": {}}
    client = search.Client(spark, path, routing, HashingEmbedding(256))
    with pytest.raises(RuntimeError):
        client.count()
    with client:
        out = client.query(["number 7 of many", "number 4 of many"], n_results=2)
        assert [x[0] for x in out["ids"]] == ["d7", "d4"] and out["metadatas"][0][0] == {"k": "d7"} and out["distances"][0][0] < 1e-6
        assert client.query(query_embeddings=[[0.0] * 256], models=["Nope"])["ids"] == [[]]
        assert client.count() == 20 and client.count(["B"]) == 10 and client.count(where={"model_name": "B"}) == 7
        with pytest.raises(ValueError):
            client.query()
        assert client.get(limit=1).count() == 1
    plan = open_index(spark, path).where(F.col("collection").isin("p0"))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [collection" in plan.replace("isnotnull", "") or "collection" in plan.split("PartitionFilters")[1]
    assert delete(spark, path, drop_filter("A", ["p1"], [2])) == 0
    assert delete(spark, path, drop_filter("A", ["p1"], [1]), apply=False) == 7 and open_index(spark, path).count() == 20
    assert delete(spark, path, drop_filter("A", ["p1"], [1])) == 7
    assert delete(spark, path, {"doc_id": {"$in": ["d0", "d2"]}}) == 2
    left = open_index(spark, path)
    assert left.count() == 11 and left.where("doc_id = 'd4'").count() == 1


def test_a_collection_that_fails_leaves_the_others(spark, tmp_path):
    path = tmp_path / "index"
    docs = [(f"c {k % 3}", "A", f"d{k}", f"number {k}", "1", "p") for k in range(12)]
    df = spark.createDataFrame(docs, "collection string, model_name string, doc_id string, document string, schema_version string, partition_name string").withColumn("metadata", F.create_map(F.lit("k"), F.col("doc_id")))
    append(spark, embed(df, HashingEmbedding(32)), str(path))
    with search.Client(spark, str(path), None, HashingEmbedding(32)) as client:
        whole = client.query(["number 4"], n_results=12)
        assert len(whole["ids"][0]) == 12 and whole["ids"][0][0] == "d4" and client.count() == 12
        broken = next(path.glob("collection=c 1/model_name=A/*.parquet"))
        broken.write_bytes(b"broken" * 50)
        (broken.parent / f".{broken.name}.crc").unlink(missing_ok=True)
        left = client.query(["number 4"], n_results=12)
        assert left["ids"][0] == [d for d in whole["ids"][0] if int(d[1:]) % 3 != 1] and left["distances"][0] == sorted(left["distances"][0])
        for f in path.glob("*/*/*.parquet"):
            f.write_bytes(b"broken" * 50)
            (f.parent / f".{f.name}.crc").unlink(missing_ok=True)
        with pytest.raises(Exception, match="."):
            client.query(["number 4"])


def test_a_deletion_that_was_cut_off(spark, tmp_path):
    path = str(tmp_path / "index")
    docs = [("c/1", "A b", f"d{k}", "x", "1", "p") for k in range(6)]
    df = spark.createDataFrame(docs, "collection string, model_name string, doc_id string, document string, schema_version string, partition_name string").withColumn("metadata", F.create_map(F.lit("k"), F.col("doc_id")))
    append(spark, embed(df, HashingEmbedding(8)), path)
    directory = next((tmp_path / "index").glob("*/*"))
    aside = tmp_path / "index" / "_old-1" / directory.parent.name
    aside.mkdir(parents=True)
    directory.rename(aside / directory.name)  # moved aside, and nothing has taken its place
    assert open_index(spark, path) is None
    assert delete(spark, path, {"doc_id": "d3"}) == 1
    left = open_index(spark, path)
    assert {r.doc_id for r in left.collect()} == {"d0", "d1", "d2", "d4", "d5"} and left.first().collection == "c/1"
    assert not [p.name for p in (tmp_path / "index").iterdir() if p.name.startswith(("_old", "_rewrite"))]


def test_stream_appends_only_new_digests(spark, tmp_path):
    source, target, checkpoint = (str(tmp_path / x) for x in ("in", "out", "ck"))
    first = spark.createDataFrame([(1, "a"), (2, "b"), (2, "b")], "k int, v string")
    for more in (first, spark.createDataFrame([(2, "b"), (3, "c")], "k int, v string")):
        more.write.mode("append").parquet(source)
        append_new(new_rows(spark, source, first.schema, ["k", "v"], "M"), target, checkpoint).awaitTermination(120)
    assert sorted(r.k for r in spark.read.parquet(target).collect()) == [1, 2, 3]


def test_windowed_counts(spark):
    import datetime

    df = spark.createDataFrame([(datetime.datetime(2024, 1, 1, h, 30), "x", 1.0) for h in (1, 1, 2)], "ts timestamp, event_type string, value double")
    assert sorted(r.events for r in windowed_counts(df).collect()) == [1, 2]
