"""Physical plans when no table is small enough to broadcast, as on very large data."""

from __future__ import annotations

import re

import pytest

import __spark_entry__ as driver
from varve.plans import variants
from varve.sources import standin


@pytest.fixture()
def nothing_is_small(spark):
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")
    yield
    spark.conf.set(key, before)


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def exchanges(text: str) -> list[str]:
    return re.findall(r"Exchange (\w+)", text)


@pytest.mark.parametrize("name", list(driver.queries()))
def test_no_pair_joins_and_no_single_task_windows(spark, tiny, nothing_is_small, name):
    text = plan_of(driver.queries()[name](spark, tiny))
    for operator in ("CartesianProduct", "BroadcastNestedLoopJoin", "BroadcastHashJoin"):
        assert operator not in text, text
    # a window over everything would be fed by one partition
    lines = [line.strip() for line in text.splitlines()]
    for i, line in enumerate(lines):
        if re.search(r"\bWindow \[", line):
            below = next((n for n in lines[i + 1:] if "Exchange" in n), "")
            assert "SinglePartition" not in below, text


def scans(text: str, table: str) -> list[str]:
    return [line for line in text.splitlines() if "FileScan" in line and f"{table}.parquet" in line]


@pytest.mark.parametrize("name, table, column", [
    ("q01", "lineitem", "l_shipdate"), ("q03", "orders", "o_orderdate"),
    ("q04", "orders", "o_orderdate"), ("q06", "lineitem", "l_shipdate"),
    ("q14", "lineitem", "l_shipdate"), ("q15", "lineitem", "l_shipdate"),
])
def test_date_ranges_reach_the_reader(spark, tiny, name, table, column):
    text = plan_of(variants.run(name, standin.load(spark, tiny)))
    for scan in scans(text, table):
        pushed = scan.split("PushedFilters:")[1]
        assert re.search(rf"(Less|Greater)Than\w*\({column}", pushed), scan


@pytest.mark.parametrize("name, lineitem_scans", [("q01", 1), ("q18", 1), ("q21", 1), ("q17", 1)])
def test_big_table_is_read_as_often_as_needed(spark, tiny, name, lineitem_scans):
    text = plan_of(variants.run(name, standin.load(spark, tiny)))
    assert len(scans(text, "lineitem")) <= lineitem_scans
    for scan in scans(text, "lineitem"):
        assert "l_tax" in scan if name == "q01" else "l_tax" not in scan


@pytest.mark.parametrize("name, table", [("tpch_q15", "lineitem"), ("scd2_from_log", "events")])
def test_results_used_twice_are_computed_once(spark, tiny, nothing_is_small, name, table):
    df = driver.queries()[name](spark, tiny)
    df.collect()
    final = plan_of(df).split("== Initial Plan ==")[0]
    assert len(scans(final, table)) <= 1 and "ReusedExchange" in final, final


def test_gold_shuffles(spark, small, nothing_is_small):
    """No exchange for the distinct count: it reuses the partitioning of the last join."""
    df = driver.queries()["gold_revenue_by_nation_year"](spark, small)
    keys = re.findall(r"Exchange hashpartitioning\(([^)]*?), \d+\)", plan_of(df))
    bare = [re.sub(r"#\d+L?", "", k) for k in keys]
    assert sorted(bare) == sorted([
        "nation, order_year", "o_orderkey", "l_orderkey", "o_custkey", "c_custkey", "c_nationkey",
        "n_nationkey",
    ])


def test_moved_rows_are_dealt_to_as_many_tasks_as_they_need(spark, tiny):
    text = plan_of(driver.queries()["fingerprint_xx"](spark, tiny))
    assert "REBALANCE_PARTITIONS_BY_NONE" in text and "REPARTITION_BY_NUM" not in text, text
