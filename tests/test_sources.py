"""Files with broken rows, and the JSON that describes partitions."""

import json

import pytest
from pyspark.sql import functions as F

from tessera.plans import lifecycle
from tessera.sources import delimited, files, metadata
from tessera.spec import IndexConfig, SourceConfig, TableSpec, active, index_stub, load_registry, parse_configs, parse_drop_config, source_stub

SPEC = TableSpec.of_strings("Contract", ["id", "title"], ["summary"], semantic_fields=("summary", "title"), keyword_fields=("id",))
REGISTRY = {"Contract": SPEC}


def write(path, text, encoding="utf-8"):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(text.encode(encoding) if isinstance(text, str) else text)
    return str(path)


def cells(df):
    return [tuple(r) for r in df.orderBy(delimited.FILE, delimited.ROW).drop(delimited.FILE, delimited.ROW).collect()]


def test_files_in_numeric_order(spark, tmp_path):
    for n in ("part2.csv", "part10.csv", "partx.csv"):
        write(tmp_path / n, "a\n")
    assert [p.rpartition("/")[2] for p in files.discover(spark, f"{tmp_path}/part<int>.csv")] == ["part2.csv", "part10.csv"]
    for missing in (f"{tmp_path}/none.csv", f"{tmp_path}/none<int>.csv"):
        with pytest.raises(FileNotFoundError):
            files.discover(spark, missing)


def test_surplus_cells_are_joined(spark, tmp_path):
    path = write(tmp_path / "a.csv", "id,txt,z\n1,a,b,9\n2,x,8\n3,only\n")
    good, bad = delimited.read_rows(spark, SourceConfig(path, malformed_column=2))
    assert cells(good) == [("1", "a,b", "9"), ("2", "x", "8")]
    assert [r._cells for r in bad.collect()] == [["3", "only"]]


def test_short_rows_take_in_what_follows(spark, tmp_path):
    path = write(tmp_path / "a.csv", "a,b,c\n1,x\ny,z\n2,p,q\n")
    good, _ = delimited.read_rows(spark, SourceConfig(path, malformed_column=2))
    assert cells(good) == [("1", "x\ny", "z"), ("2", "p", "q")]
    assert cells(delimited.read_rows(spark, SourceConfig(path))[0]) == [("2", "p", "q")]


def test_quotes_bom_encoding_and_headers(spark, tmp_path):
    write(tmp_path / "p1.csv", b'\xef\xbb\xbfid, t\n1,"say ""hi""\nyou"\n')
    write(tmp_path / "p2.csv", b"2,caf\xe9\n")
    good, _ = delimited.read_rows(spark, SourceConfig(f"{tmp_path}/p<int>.csv", header_row="first-only"))
    assert good.columns[2:] == ["id", "t"]
    assert cells(good) == [("1", 'say "hi"\nyou'), ("2", "caf�")]
    clean = delimited.read_clean(spark, f"{tmp_path}/p1.csv")
    assert [tuple(r) for r in clean.collect()] == [("1", 'say "hi"\nyou')]
    semi = write(tmp_path / "s.csv", "a||b\n1||2\n")
    assert cells(delimited.read_rows(spark, SourceConfig(semi, delimiter="||"))[0]) == [("1", "2")]
    empty = write(tmp_path / "e.csv", "")
    assert delimited.read_rows(spark, SourceConfig(empty))[0].count() == 0


def test_large_and_many_files(spark, tmp_path):
    """Quoted line ends and rows that go on across the splits of a file, and files that are one plan however many they are."""
    text = "id,txt,z\n" + "".join(f'{k},"a\n{k}",x\r\n' if k % 3 else f"{k},b\nc,x\n" for k in range(3000))
    path = write(tmp_path / "one" / "a.csv", text)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        good, bad = delimited.read_rows(spark, SourceConfig(path, malformed_column=2))
        assert cells(good) == [(str(k), f"a\n{k}" if k % 3 else "b\nc", "x") for k in range(3000)] and bad.count() == 0
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    for k in range(60):
        write(tmp_path / "many" / f"p {k}.csv", f"id,t\n{k},é\r{k}b,x\r".encode("latin-1"), None)
    rows, _ = delimited.read_rows(spark, SourceConfig(f"{tmp_path}/many/p <int>.csv", character_encoding="iso-8859-1"))
    assert cells(rows) == [r for k in range(60) for r in ((str(k), "é"), (f"{k}b", "x"))]
    assert "Union" not in rows._jdf.queryExecution().executedPlan().toString()


def test_repair_expression_is_the_list_function(spark):
    rows = [[str(k) for k in range(n)] for n in range(1, 7)]
    df = spark.createDataFrame([(k, r) for k, r in enumerate(rows)], "k int, v array<string>")
    for width in (2, 3, 4):
        for malformed in (None, 1, 2, width, width + 1):
            got = [r[0] for r in df.orderBy("k").select(delimited.repair(F.col("v"), width, malformed, ",")).collect()]
            assert got == [delimited.repair_list(r, width, malformed, ",") for r in rows]


def test_configurations():
    c = parse_configs({"Contract": {"path": "x.csv", "columns": {"id": "cid"}, "malformed_column": 2}}, REGISTRY)
    assert c["Contract"].columns == {"id": "cid"} and active(c) == ["Contract"]
    assert SourceConfig.parse("T", None).path == "" and SourceConfig.parse("T", "f.csv").path == "f.csv"
    for bad in ({"malformed_column": 0}, {"malformed_column": True}, {"header_row": "none"}, {"delimiter": ""}, {"columns": {"a": 1}}, 5):
        with pytest.raises(ValueError):
            SourceConfig.parse("T", bad)
    with pytest.raises(ValueError):
        IndexConfig.parse("T", {"truncation_strategy": "head"})
    with pytest.raises(ValueError):
        parse_configs({"Nope": None}, REGISTRY)
    assert set(source_stub(REGISTRY)["Contract"]["columns"]) == set(index_stub(REGISTRY)["Contract"]["columns"]) == {"id", "title", "summary"}
    assert parse_drop_config({"models": {"A": {"partitions": ["p"]}}})["A"] == {"partitions": ["p"], "schema_versions": [], "reason": None}
    for bad in ({}, {"models": {"A": {"partitions": []}}}, {"models": {"A": {"partitions": ["p"], "schema_versions": ["1"]}}}):
        with pytest.raises(ValueError):
            parse_drop_config(bad)


def test_registry(monkeypatch):
    import sys
    import types

    module = types.ModuleType("made_up_registry")
    module.ok, module.empty, module.bad = types.SimpleNamespace(all=REGISTRY), {}, {"A": 1}
    monkeypatch.setitem(sys.modules, "made_up_registry", module)
    assert load_registry("made_up_registry:ok.all") == REGISTRY
    with pytest.raises(ValueError):
        load_registry("made_up_registry")
    for target in ("empty", "bad"):
        with pytest.raises(TypeError):
            load_registry(f"made_up_registry:{target}")
    other = TableSpec.of_strings("Contract", ["title", "id"], ["summary"])
    assert other.signature() == SPEC.signature()
    assert TableSpec.of_strings("Contract", ["id"], ["title", "summary"]).signature() != SPEC.signature()


def state(count, started=True, complete=True, **more):
    return {"started": started, "complete": complete, "collection_count": count, "documents_indexed": count, "indexed_at": "2025-10-31T10:00:00"} | more


@pytest.fixture
def populated(tmp_path):
    for p, models in {
        "partition_00001": {"Table": state(1000), "Field": state(500, complete=False)},
        "partition_00002": {"Field": state(800), "Domain": state(300)},
        "partition_00003": {"EmptyModel": state(0), "NotStarted": state(100, started=False)},
    }.items():
        write(tmp_path / p / f"{p}_resume_state.json", json.dumps(models))
    return tmp_path


def test_routing(spark, populated):
    out = lifecycle.routing(spark, str(populated), str(populated / "routing.json"), "pre")
    assert out["model_to_collections"]["Field"] == {"collections": ["partition_00001", "partition_00002"], "total_documents": 1300, "partitions": ["partition_00001", "partition_00002"]}
    assert out["collection_to_models"] == {"partition_00001": ["Field", "Table"], "partition_00002": ["Domain", "Field"]}
    assert (out["metadata"]["total_collections"], out["metadata"]["total_models"], out["metadata"]["collection_prefix"]) == (3, 3, "pre")
    assert json.loads((populated / "routing.json").read_text())["metadata"]["total_models"] == 3


def test_routing_without_usable_states(spark, tmp_path):
    with pytest.raises(ValueError):
        lifecycle.routing(spark, str(tmp_path / "nowhere"))
    write(tmp_path / "p1" / "a_resume_state.json", "{broken")
    write(tmp_path / "p2" / "b_resume_state.json", "[1]")
    write(tmp_path / "p3" / "c_resume_state.json", json.dumps({"Table": "text", "Field": state("7"), "Ok": state(5)}))
    write(tmp_path / "p4" / "other.json", "{}")
    out = lifecycle.routing(spark, str(tmp_path))
    assert set(out["model_to_collections"]) >= {"Ok"} and "Table" not in out["model_to_collections"]
    assert out["metadata"]["total_collections"] == 1


def test_manifest(spark, tmp_path):
    assert metadata.load_manifest(spark, str(tmp_path / "none.json"))["partitions"] == []
    path = write(tmp_path / "m.json", json.dumps({"version": 2}))
    with pytest.raises(ValueError):
        metadata.load_manifest(spark, path)
    m = {"partitions": [{"name": "a", "path": "pa"}, {"name": "b", "path": "/abs", "stale": True}, {"name": "c", "path": "/abs/c", "config": "c.json"}]}
    assert metadata.live_partitions(m, "/base") == [("a", "/base/pa", None), ("c", "/abs/c", "/base/c.json")]


def test_status(spark, tmp_path):
    def partition(name, states=None, configured=(), errors=()):
        (tmp_path / name).mkdir()
        if states:
            write(tmp_path / name / f"{name}_resume_state.json", json.dumps(states))
        if configured:
            write(tmp_path / name / "index_config.json", json.dumps({m: {"path": "x"} for m in configured}))
        for k, e in enumerate(errors):
            write(tmp_path / name / "errors" / f"2025{k}.json", json.dumps(e))

    error = lambda row, model="A": {"timestamp": "t", "model": model, "rows": [{"row_index": row}], "resume_state": {"row_index": 1}, "exception": {"type": "E", "message": "m"}}
    partition("done", {"A": state(5)}, ["A"], [error(9)])
    partition("missing", {"A": state(5)}, ["A", "B"])
    partition("failed", {"A": state(5, complete=False, row_index=8)}, ["A"], [error(9)])
    partition("past", {"A": state(5, complete=False, row_index=10)}, ["A"], [error(9), error("4")])
    partition("past_unnamed", {"A": state(5, complete=False, row_index=10)}, [], [error(9, "")])
    partition("other_failed", {"A": state(5, complete=False, row_index=10)}, [], [error(9), error(3, "B")])
    partition("waiting", {"A": state(0, started=False, complete=False)}, ["A"])
    partition("not_configured", {"A": state(5, complete=False), "B": state(0, started=False, complete=False)}, ["B"])
    partition("nothing")
    got = {r["partition"]: r["status"] for r in lifecycle.partition_status(spark, str(tmp_path)).collect()}
    assert got == {
        "done": "finished", "missing": "started", "failed": "errored", "past": "started", "past_unnamed": "started",
        "other_failed": "errored", "waiting": "not_started", "not_configured": "not_started", "nothing": "not_started",
    }
    reports = metadata.error_reports(spark, str(tmp_path))
    assert [r["file"] for r in lifecycle.newest_errors(reports.where("partition = 'past'")).collect()] == ["20251.json", "20250.json"]
    assert lifecycle.unchanged({"complete": True, "source_signature": {"mtime": 1, "size": 2}}, {"mtime": 1, "size": 2})
    assert not lifecycle.unchanged({"complete": False}, None)
