"""Every registered query against its SQL, and rules its plan must keep."""

import re

import duckdb
import pytest

import __spark_entry__ as entry
import workload
from check import TABLES, rows_of

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = workload.QUERIES, workload.ORACLES
# A plan with one of these multiplies rows or leaves the JVM.
FORBIDDEN = re.compile(r"CartesianProduct|BroadcastNestedLoopJoin|BatchEvalPython|ArrowEvalPython|InPandas")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def test_every_query_has_its_sql():
    assert set(QUERIES) == set(ORACLES) and len(QUERIES) > 110
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLES) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, db, name):
    df = QUERIES[name](spark, SF)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not FORBIDDEN.search(plan), plan
    got, want = df.toArrow(), db.sql(ORACLES[name]).to_arrow_table()
    assert sorted(got.column_names) == sorted(want.column_names)
    assert rows_of(got) == rows_of(want)


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize(
    "name, partial",
    [("dedup_ticks", 1), ("upsert_latest", 1), ("liquid_contracts", 1), ("screen_options", 1), ("block_prints_top10", 1), ("busiest_sample", 1)],
)
def test_groups_are_pruned_before_the_shuffle(spark, name, partial):
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"WindowGroupLimit.*Partial", plan)) == partial


def test_feature_table_has_three_exchanges(spark):
    plan = QUERIES["feature_table"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"Exchange hashpartitioning", plan)) == 3


def test_scans_read_only_what_they_need(spark):
    plan = QUERIES["cluster_events"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    read = re.search(r"FileScan parquet \[([^\]]*)\]", plan).group(1)
    assert {c.split("#")[0] for c in read.split(",")} == {
        "l_suppkey", "l_quantity", "l_extendedprice", "l_returnflag", "l_shipdate",
    }
