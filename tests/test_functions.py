"""Scalar functions against plain Python."""

import datetime

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.functions import text as tf
from tessera.functions import truncate as tr
from tessera.functions.predicates import where, where_document

TEXTS = ["", " a ", "\x1cx y ", "é" * 10, "日本語 text", "a. b! c?  d", "NA", "x\n\ny ", "one"]


def col(spark, values, f, name="t"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, {name} string")
    return [r[0] for r in df.orderBy("i").select(f(F.col(name))).collect()]


def test_strip_is_unicode(spark):
    assert col(spark, TEXTS, tf.strip) == [t.strip() for t in TEXTS]
    assert col(spark, [" ", "", None, "a"], tf.blank_to_null) == [None, None, None, "a"]


def test_byte_trim_cuts_no_character(spark):
    for n in range(1, 14):
        expected = [t if len(t.encode()) <= n else t.encode()[:n].decode(errors="ignore").rstrip() for t in TEXTS]
        assert col(spark, TEXTS, lambda c, n=n: tf.byte_trim(c, n)) == expected


def test_row_digest_counts_nulls(spark):
    import hashlib

    df = spark.createDataFrame([("a", None, "b"), ("a", "b", None)], "x string, y string, z string")
    got = [r[0] for r in df.select(tf.row_digest(F.col("x"), F.col("y"), F.col("z"))).collect()]
    assert got == [hashlib.sha1("␟".join(v).encode()).hexdigest() for v in (["a", "", "b"], ["a", "b", ""])]


def test_tokens_and_sentences(spark):
    assert col(spark, [*TEXTS, None], tf.token_count) == [*(len(t.split()) if "\x1c" not in t else 2 for t in TEXTS[:1]), *[len(__import__("re").findall(r"\S+", t, __import__("re").A)) for t in TEXTS[1:]], 0]
    assert col(spark, ["a. b! c?  d", "..", ""], tf.sentences) == [["a.", "b!", "c?", "d"], [".."], []]


def test_names(spark):
    assert col(spark, ["My Table!", "--", "a_b"], tf.slug) == ["my-table", "config", "a-b"]
    assert col(spark, ["a/b c.yaml"], tf.safe_filename) == ["a_b_c.yaml"]
    assert col(spark, ["x/coll_1_resume_state.json", "x/other.json"], tf.collection_of_state_file) == ["coll_1", None]
    df = spark.range(1)
    row = df.select(tf.partition_name(F.lit(7)), tf.collection_name(F.lit("p"), "pre"), tf.thousands(F.lit(1234567)), tf.reduction_percent(F.lit(200), F.lit(50))).first()
    assert list(row) == ["partition_00007", "pre_p", "1,234,567", 75.0]
    assert tf.human_bytes(1536) == "1.5 KB"


def test_dates_and_integers(spark):
    assert col(spark, ["2024-01-02", "2024-01-02T03:04:05", "soon", None], tf.date_or_null)[:3] == [datetime.datetime(2024, 1, 2), datetime.datetime(2024, 1, 2, 3, 4, 5), None]
    assert col(spark, ["12", " 7 ", "x", "1.5", None], tf.int_or_null) == [12, 7, None, None, None]


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab .!?\n", max_size=300), st.integers(1, 40), st.sampled_from([*tr.STRATEGIES, "no such"]))
def test_truncation_fits(text, budget, strategy):
    out, n, cut = tr.truncate_text(text, budget, strategy)
    assert cut == (tr.count_words(text) > budget)
    assert n == tr.count_words(out)
    if not cut:
        assert out == text
    elif budget > 3:
        assert n <= budget


def test_truncation_keeps_what_it_says():
    words = " ".join(f"w{i}" for i in range(100))
    assert tr.truncate_text(words, 10, "end")[0].startswith("w0 w1") and tr.truncate_text(words, 10, "end")[0].endswith(tr.AFTER)
    assert tr.truncate_text(words, 10, "start")[0].startswith(tr.BEFORE) and tr.truncate_text(words, 10, "start")[0].endswith("w99")
    both = tr.truncate_text(words, 10, "middle_out")[0]
    assert both.startswith("w0") and tr.BETWEEN in both and both.endswith("w99")
    prose = " ".join(f"This is sentence {i}." for i in range(40))
    kept = tr.truncate_text(prose, 30, "sentences")[0]
    assert kept.startswith("This is sentence 0.") and kept.endswith("This is sentence 39.") and tr.count_words(kept) <= 30
    assert tr.token_budget() == 7781


def test_truncate_column(spark):
    df = spark.createDataFrame([("a b c d e f g h", "end"), ("x", "end"), (None, "start")], "t string, s string")
    got = [tuple(r[0]) for r in df.select(tr.truncate(F.col("t"), 5, F.col("s"))).collect()]
    assert got == [(*tr.truncate_text("a b c d e f g h", 5, "end"), 8), ("x", 1, False, 1), ("", 0, False, 0)]
    assert [r[0] for r in df.select(tr.truncate_end_words(F.col("t"), 5)).collect()] == [tr.truncate_text("a b c d e f g h", 5, "end")[0], "x", None]


def test_predicates(spark):
    df = spark.createDataFrame([(1, "a"), (2, None), (3, "b")], "n int, k string")
    ids = lambda f: [r.n for r in df.where(where(f)).orderBy("n").collect()]
    assert ids({}) == [1, 2, 3]
    assert ids({"k": "a"}) == [1]
    assert ids({"k": {"$ne": "a"}}) == [2, 3]
    assert ids({"k": {"$nin": ["a"]}}) == [2, 3]
    assert ids({"$or": [{"n": {"$gte": 3}}, {"$and": [{"k": {"$in": ["a"]}}, {"n": {"$lt": 2}}]}]}) == [1, 3]
    assert ids({"n": {"$gt": 1, "$lte": 2}}) == [2]
    for bad in ({"$xor": []}, {"k": {"$like": "a"}}, {"$and": []}):
        with pytest.raises(ValueError):
            where(bad)
    docs = spark.createDataFrame([("the cat",), ("a dog",)], "document string")
    assert [r[0] for r in docs.where(where_document({"$or": [{"$contains": "cat"}, {"$regex": "^x"}]})).collect()] == ["the cat"]
    assert [r[0] for r in docs.where(where_document({"$not_contains": "cat"})).collect()] == ["a dog"]


def test_suggested_strategy(spark):
    long = "x\n" * 60 + "field parameter"
    f = lambda m, fields: col(spark, ["a Table here", long], lambda c: tf.suggest_strategy(c, m, fields))
    assert f("Other", ["title"]) == ["end", "middle_out"]
    assert f("Other", ["help_text"]) == ["end", "sentences"]
    assert f("Table", ["help_text"]) == ["end", "end"]
