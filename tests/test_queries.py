"""Every registered query against its SQL on the given tables."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from scorespark.plans import feature_queries, marks_queries, model_queries, oracle
from scorespark.session import scratch_dir, staging

QUERIES = {**marks_queries.QUERIES, **feature_queries.QUERIES, **model_queries.QUERIES}
ORACLE = oracle.ORACLE
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()
# no pairing of all rows with all rows, no Python in the data path
FORBIDDEN = ["CartesianProduct", "BroadcastNestedLoopJoin", "EvalPython", "InPandas"]


@pytest.fixture(scope="module")
def con(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def comparable(rows):
    return sorted(
        [tuple("nan" if isinstance(v, float) and math.isnan(v) else v for v in r) for r in rows], key=repr
    )


def test_every_query_has_its_sql():
    assert set(ORACLE) == set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_against_sql(spark, sf, con, name):
    df = QUERIES[name](spark, sf)
    plan = df._jdf.queryExecution().toString()
    assert not [p for p in FORBIDDEN if p in plan]
    columns = sorted(df.columns)
    cursor = con.execute(f"SELECT {', '.join(columns)} FROM ({ORACLE[name]})")
    assert comparable(df.select(*columns).collect()) == comparable(cursor.fetchall())


def test_a_block_leaves_no_staged_table(spark, sf):
    folder = scratch_dir(spark)
    with staging(spark):
        QUERIES["marks_wide"](spark, sf).count()
    before = set(os.listdir(folder)) if os.path.isdir(folder) else set()
    with staging(spark):
        for name in ("ols_cv", "tree_predictions", "csv_round_trip", "roc_curve"):
            assert QUERIES[name](spark, sf).collect()
        assert len(set(os.listdir(folder)) - before) > 4
    assert set(os.listdir(folder)) == before


def test_entry(spark, sf):
    assert entry.entry(spark).columns == ["subject", "average"]
