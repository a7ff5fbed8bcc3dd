"""Every registered query with a SQL twin, on the smallest tables."""

import math
import os

import pytest

from strokeloom import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(v):
    return "nan" if isinstance(v, float) and math.isnan(v) else v


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_twin(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted((repr([plain(r[c]) for c in columns]) for r in df.collect()))
    rel = duck.sql(catalog.ORACLE_SQL[name])
    at = [rel.columns.index(c) for c in columns]
    assert sorted(rel.columns) == columns
    assert got == sorted(repr([plain(r[k]) for k in at]) for r in rel.fetchall())


def test_one_exchange_and_one_sort_for_all_windows(spark):
    plan = catalog.QUERIES["trajectory_features_8d"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and plan.count("Sort [") == 1


def test_only_needed_columns_are_read(spark):
    plan = catalog.QUERIES["stroke_ids"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    schema = plan[plan.index("ReadSchema") :]
    assert "value" not in schema and "props" not in schema


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
