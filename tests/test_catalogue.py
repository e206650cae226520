"""Registered queries against their SQL."""

import duckdb
import pytest

from tessera.plans import catalogue

SF = "/root/testdata/sf0.01"


def by_sql(name, *tables):
    with duckdb.connect() as db:
        for t in tables:
            db.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
        return sorted(db.execute(catalogue.ORACLES[name]).fetchall())


@pytest.mark.parametrize("name", ["knn_topk_l2", "knn_filtered", "knn_cosine", "knn_multi_collection_merge"])
def test_searches_for_every_50th_vector(spark, name):
    got = catalogue.QUERIES[name](spark, SF)
    rows = sorted(tuple(r) for r in got.collect())
    assert {r[0] for r in rows} == set(range(0, 500, 50)) and len(rows) == 100
    want = by_sql(name, "embeddings")
    assert [r[:-1] for r in rows] == [r[:-1] for r in want]
    assert [r[-1] for r in rows] == pytest.approx([r[-1] for r in want], abs=2e-6)


def test_ranges_of_values_reach_the_whole_table(spark):
    got = sorted(tuple(r) for r in catalogue.QUERIES["where_range"](spark, SF).collect())
    assert got == by_sql("where_range", "documents", "labels")
    assert min(got) <= (10,) and max(got) > (800,)
