"""Runs from files to the index, and the catalogue against SQL."""

import json
import types

import duckdb
import pandas as pd
import pytest

from tessera import cli
from tessera.operators.documents import build_documents
from tessera.operators.index import HashingEmbedding, RateLimited, Retrying, embed_requests, open_index
from tessera.plans import catalogue, lifecycle, prepare
from tessera.sources import files, metadata
from tessera.spec import SourceConfig, TableSpec

SF = "/root/testdata/sf0.001"

TABLE = TableSpec.of_strings("Table", ["id", "title"], ["summary"], semantic_fields=("summary", "title"), keyword_fields=("id",))
FIELD = TableSpec.of_strings("Field", ["name"], semantic_fields=("name",))


def write(path, text):
    path.write_text(text, encoding="utf-8")
    return str(path)


def data(spark, root):
    return spark.read.parquet(f"{root}/data")


def test_life_of_a_dataset(spark, tmp_path):
    root, registry = str(tmp_path / "out"), {"Table": TABLE, "Field": FIELD}
    t = write(tmp_path / "t.csv", 'tid,title,summary\n1,One,"a, b"\n2,Two,NA\n3,Three,c\n3,Three,c\n')
    f = write(tmp_path / "f.csv", "name\nx\ny\n")
    configs = {"Table": SourceConfig(t, {"id": "tid", "title": "title", "summary": "summary"}, drop_na_columns=("summary",)), "Field": SourceConfig(f)}
    m = prepare.run(spark, configs, registry, root, directory_size=3)
    assert [(p["name"], p["rows"]) for p in m["partitions"]] == [("partition_00001", 3), ("partition_00002", 1)]
    assert set(m["partitions"][0]["models"]) == {"Table", "Field"} and m["model_schemas"]["Table"]["version"] == 1
    # The same again adds nothing; a new row is a new partition.
    assert len(prepare.run(spark, configs, registry, root)["partitions"]) == 2
    write(tmp_path / "f.csv", "name\nx\ny\nz\n")
    m = prepare.run(spark, configs, registry, root)
    assert [p["rows"] for p in m["partitions"]] == [3, 1, 1] and len(m["runs"]) == 2
    # Into the index, one collection a partition.
    index, states = str(tmp_path / "index"), str(tmp_path / "states")
    counts = prepare.index_partitions(spark, f"{root}/manifest.json", root, registry, index, prefix="pre")
    assert sorted(tuple(r) for r in counts.collect()) == [("pre_partition_00001", "Field", 1), ("pre_partition_00001", "Table", 2), ("pre_partition_00002", "Field", 1), ("pre_partition_00003", "Field", 1)]
    prepare.index_partitions(spark, f"{root}/manifest.json", root, registry, index, prefix="pre")
    assert open_index(spark, index).count() == 5
    assert open_index(spark, index).where("model_name = 'Table'").first().metadata["partition_name"] == "partition_00001"
    assert prepare.write_states(spark, index, states) == 3
    routing = lifecycle.routing(spark, states)
    assert routing["model_to_collections"]["Field"]["total_documents"] == 3 and routing["metadata"]["total_collections"] == 3
    assert {r.status for r in lifecycle.partition_status(spark, states, root).collect()} == {"finished"}
    # Drops: plan, dry run, apply to manifest and index, undo.
    plan = lifecycle.plan_drop(spark, f"{root}/manifest.json", ["Field", "None"], before="2999-01-01", after="2001-01-01", reason="old")
    assert plan["models"] == {"Field": {"partitions": ["partition_00001", "partition_00002", "partition_00003"], "schema_versions": [1], "reason": "old"}}
    assert lifecycle.plan_drop(spark, f"{root}/manifest.json", ["Field"], before="2001-01-01")["models"] == {}
    assert len(lifecycle.plan_drop(spark, f"{root}/manifest.json", ["Field"], before="no date")["models"]) == 1
    assert len(lifecycle.apply_drop(spark, plan, f"{root}/manifest.json")) == 3
    assert not metadata.load_manifest(spark, f"{root}/manifest.json")["drops"]
    assert lifecycle.apply_drop_to_index(spark, plan, index, apply=True) == {"Field": 3}
    lifecycle.apply_drop(spark, plan, f"{root}/manifest.json", apply=True, performed_by="me")
    m = metadata.load_manifest(spark, f"{root}/manifest.json")
    assert m["drops"][0]["performed_by"] == "me" and m["partitions"][2]["models"]["Field"]["drop_reason"] == "old"
    assert lifecycle.plan_drop(spark, f"{root}/manifest.json", ["Field"])["models"] == {}
    assert lifecycle.undo_drop(spark, f"{root}/manifest.json", "Field", ["partition_00001"]) == 1
    # A changed field: the source is read anew, others' rows are carried over, the old partitions are stale.
    changed = {"Table": TableSpec.of_strings("Table", ["id"], ["title", "summary"], semantic_fields=("summary",)), "Field": FIELD}
    with pytest.raises(ValueError):
        prepare.run(spark, {"Field": configs["Field"]}, changed, root)
    m = prepare.run(spark, configs, changed, root)
    assert m["model_schemas"]["Table"]["version"] == 2
    old, new = m["partitions"][0], m["partitions"][-1]
    assert old["stale"] and old["stale_reason"] == "schema-change" and old["replaced_by"] == [new["name"]]
    assert new["replaces"] == ["partition_00001"] and {k: v["rows"] for k, v in new["models"].items()} == {"Table": 2, "Field": 1}
    assert lifecycle.delete_stale(spark, f"{root}/manifest.json", index) == ["partition_00001"]
    assert open_index(spark, index) is None or open_index(spark, index).where("partition_name = 'partition_00001'").isEmpty()


def fails_on(word, limited=0):
    """An embedding that fails for texts with a word, and is limited at first. Classes made here are sent to workers whole."""

    class FailsOn:
        limits = limited

        def __call__(self, texts):
            if self.limits:
                self.limits -= 1
                raise RateLimited()
            if any(word in t for t in texts):
                raise ConnectionError("service is down")
            return HashingEmbedding(8)(texts)

    return FailsOn()


def test_index_command(spark, tmp_path, monkeypatch, capsys):
    import sys

    module = types.ModuleType("registry_of_index_command")
    module.REGISTRY = {"Table": TABLE, "Field": FIELD}
    module.down, module.up = fails_on("three"), fails_on("nothing")
    monkeypatch.setitem(sys.modules, "registry_of_index_command", module)
    monkeypatch.setattr(cli, "session", lambda: spark)
    root, index, states = (str(tmp_path / x) for x in ("out", "index", "states"))
    t = write(tmp_path / "t.csv", "id,title,summary\n" + "".join(f"{k},T{k},{w} words\n" for k, w in enumerate(["one", "two", "three", "four", "five", "six"])))
    f = write(tmp_path / "f.csv", "name\nx\ny\n")
    prepare.run(spark, {"Table": SourceConfig(t), "Field": SourceConfig(f)}, module.REGISTRY, root)

    def call(*args):
        code = cli.main(["index", "--model", "registry_of_index_command:REGISTRY", "--log-no-console", "--partition-manifest", f"{root}/manifest.json", "--output-root", root, "--index", index, "--collection-prefix", "pre", *args])
        return code, json.loads(capsys.readouterr().out or "null")

    assert call("--resume")[0] == 1 and call("--embedding", "registry_of_index_command:down", "--batch-size", "1")[0] == 1
    code, _ = call("--partition-out-dir", states, "--embedding", "registry_of_index_command:down", "--batch-size", "1")
    assert code == 0
    state = json.loads((tmp_path / "states" / "partition_00001" / "pre_partition_00001_resume_state.json").read_text())
    assert state["Field"]["complete"] and not state["Table"]["complete"] and state["Table"]["collection_count"] < 6
    report = metadata.error_reports(spark, states).collect()
    assert [(r.partition, r.model, r.exception_type, r.exception_message) for r in report] == [("partition_00001", "Table", "ConnectionError", "service is down")]
    found = json.loads(next((tmp_path / "states" / "partition_00001" / "errors").glob("*.json")).read_text())
    assert found["batch"] == {"size": 1, "token_total": 3} and found["rows"][0]["document"].startswith("three") and "Traceback" in found["exception"]["traceback"]
    assert {r.status for r in lifecycle.partition_status(spark, states, root).collect()} == {"errored"}
    # Only what is missing is asked for again, and nothing once all is there.
    code, out = call("--partition-out-dir", states, "--embedding", "registry_of_index_command:up", "--resume")
    assert code == 0 and out == [{"collection": "pre_partition_00001", "model_name": "Field", "documents": 2}, {"collection": "pre_partition_00001", "model_name": "Table", "documents": 6}]
    assert {r.status for r in lifecycle.partition_status(spark, states, root).collect()} == {"finished"}
    module.never = fails_on("")
    assert call("--partition-out-dir", states, "--embedding", "registry_of_index_command:never", "--resume")[0] == 0
    assert lifecycle.partition_status(spark, states, root).first().status == "finished"
    # A stale partition goes, whatever its collection is called.
    m = metadata.load_manifest(spark, f"{root}/manifest.json")
    m["partitions"][0]["stale"] = True
    files.write_json(spark, f"{root}/manifest.json", m)
    assert call("--delete-stale") == (0, [])
    assert open_index(spark, index) is None and metadata.load_manifest(spark, f"{root}/manifest.json")["partitions"][0]["deleted"]


def test_requests(spark):
    df = spark.createDataFrame([(k, f"text {k}" + (" bad" if k == 7 else ""), 10 if k else 400_000) for k in range(12)], "doc_id int, document string, tokens int").coalesce(1)
    out = {r.doc_id: r for r in embed_requests(df, Retrying(fails_on("bad", limited=1), first_seconds=0), size=3, limit=1000).collect()}
    assert out[0].failure.type == "ValueError" and out[0].embedding is None
    assert all(out[k].embedding and not out[k].failure for k in range(1, 7)) and out[1].request == out[3].request != out[4].request
    assert [(out[k].embedding, out[k].failure.type) for k in (7, 8, 9)] == [(None, "ConnectionError")] * 3
    assert all(out[k].embedding is None and out[k].failure is None for k in (10, 11))


def test_rows_that_a_validator_refuses_are_left_out(spark):
    def check(row):
        if row["name"] == "bad":
            raise ValueError("bad")
        return None if row["name"] == "none" else {"name": row["name"].upper()}

    spec = TableSpec.of_strings("Field", ["name"], semantic_fields=("name",), check=check)
    df = spark.createDataFrame([("a", 1), ("bad", 2), ("none", 3)], "name string, p int")
    assert [(r.document, r.p) for r in build_documents(df, spec, carry=["p"]).collect()] == [("A", 1)]


def test_error_report(spark, tmp_path):
    path = prepare.write_error_report(spark, str(tmp_path), "p1", "A/B", "upsert", [{"row_index": 4}], ValueError("no"), {"row_index": 2})
    assert "A_B" in path
    r = metadata.error_reports(spark, str(tmp_path)).first()
    assert (r.partition, r.model, r.exception_type, r.exception_message, r.max_row) == ("p1", "A/B", "ValueError", "no", 4)


def test_commands(spark, tmp_path, monkeypatch, capsys):
    import sys

    module = types.ModuleType("registry_for_commands")
    module.REGISTRY = {"Table": TABLE}
    monkeypatch.setitem(sys.modules, "registry_for_commands", module)
    monkeypatch.setattr(cli, "session", lambda: spark)
    model = ["--model", "registry_for_commands:REGISTRY", "--log-no-console"]
    config, root, index = tmp_path / "c.json", str(tmp_path / "out"), str(tmp_path / "index")

    def call(*args):
        code = cli.main([*args, *model])
        return code, json.loads(capsys.readouterr().out or "null")

    assert call("new-config", str(config))[0] == 0 and call("new-config", str(config))[0] == 1
    stub = json.loads(config.read_text())
    stub["Table"]["path"] = write(tmp_path / "t.csv", "id,title,summary\n1,One,cats\n2,Two,dogs\n")
    config.write_text(json.dumps(stub))
    assert call("prepare", "--config", str(config), "--output-root", root) == (0, {"partitions": ["partition_00001"], "rows": 2})
    code, out = call("index", "--partition-manifest", f"{root}/manifest.json", "--output-root", root, "--index", index, "--partition-out-dir", str(tmp_path / "st"), "--e2e-sample-size", "1", "--e2e-output", str(tmp_path / "audit"))
    assert code == 0 and out == [{"collection": "partition_00001", "model_name": "Table", "documents": 2}]
    assert spark.read.json(str(tmp_path / "audit")).count() == 1
    assert call("display", "--index", index)[1] == [{"model_name": "Table", "documents": 2}]
    assert call("status", "--partition-out-dir", str(tmp_path / "st"))[1] == {"partition_00001": "finished"}
    assert call("generate-query-config", "--partition-out-dir", str(tmp_path / "st"), "--output", str(tmp_path / "r.json"))[1]["metadata"]["total_models"] == 1
    assert call("query", "dogs\nTwo", "--index", index, "--routing", str(tmp_path / "r.json"), "--n-results", "1")[1]["documents"] == [["dogs\nTwo"]]
    plan = tmp_path / "plan.json"
    assert call("plan-drop", "--manifest", f"{root}/manifest.json", "--models", "Table", "--output", str(plan))[0] == 0
    assert call("apply-drop", "--config", str(plan), "--index", index, "--manifest", f"{root}/manifest.json")[1]["documents"] == {"Table": 2}
    assert call("apply-drop", "--config", str(plan), "--index", index, "--apply")[0] == 0
    assert open_index(spark, index) is None


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def rows_of(frame):
    def plain(v):
        if v is pd.NA:
            return None
        if hasattr(v, "tolist"):
            v = v.tolist()
        if isinstance(v, list):
            return [plain(x) for x in v]
        return None if v is None or v != v else round(float(v), 5) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)

    return sorted(repr([plain(v) for v in r]) for r in frame[sorted(frame.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_catalogue(spark, db, name):
    got = catalogue.QUERIES[name](spark, SF).toPandas()
    if name in catalogue.ORACLES:
        expected = db.sql(catalogue.ORACLES[name]).df()
        assert sorted(got.columns) == sorted(expected.columns)
        assert rows_of(got) == rows_of(expected)
    else:
        assert len(got)
