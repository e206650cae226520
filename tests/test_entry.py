"""The driver's contract."""

import __spark_entry__ as entry
from tessera.plans import catalogue


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["query_idx", "rank", "collection", "doc_id", "distance"]
    asked = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").where("vec_id % 50 = 0").count()
    assert df.count() == 10 * asked


def test_names():
    assert set(catalogue.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(catalogue.ORACLES) <= set(catalogue.QUERIES)
