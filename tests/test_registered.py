"""Registered queries against their SQL, and the plans of those that matter at scale."""

import duckdb
import pytest

from __spark_entry__ import entry, oracle_sql, queries
from check import TABLES, rows_of

SF = "/root/testdata/sf0.001"
# Seconds each, as they write whole stores: check.py runs them, test_index.py tests the same functions.
SLOW = {"scan_files", "scan_trees", "ingest_trees", "reindex_trees", "ingest_store", "store_postings", "reindex_store", "reindex_raw_namespace", "stream_reindexed", "stream_late_events",
        "sync_apply", "sync_report", "sync_registry", "hybrid_over_store", "hybrid_over_indexes"}
SQL = oracle_sql()


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(set(SQL) - SLOW))
def test_against_sql(spark, con, name):
    df = queries()[name](spark, SF)
    cursor = con.execute(SQL[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    assert rows_of(df.columns, df.collect()) == rows_of(columns, cursor.fetchall())


def test_every_sql_has_a_query():
    assert set(SQL) <= set(queries())


def test_entry(spark):
    assert entry(spark).count() > 0


def plan_of(df):
    return df._jdf.queryExecution().explainString(
        df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def test_plans(spark):
    run = queries()
    # The only exchange is the one that spreads the single input file.
    assert "hashpartitioning" not in plan_of(run["postings"](spark, SF))
    topk = plan_of(run["vector_topk_hits"](spark, SF))
    assert "WindowGroupLimit" in topk and "CartesianProduct" not in topk and "BroadcastNestedLoopJoin" not in topk
    for name in run:
        if name.startswith(("fts", "hybrid")):
            plan = plan_of(run[name](spark, SF))
            assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    listing = plan_of(run["list_files"](spark, SF))
    assert "embedding" not in listing
