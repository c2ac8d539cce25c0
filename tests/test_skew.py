"""All queries on tables where one key holds a third of the rows and some keys are NULL."""

from __future__ import annotations

import duckdb
import pytest

import __spark_entry__ as driver
from tests import oracle

# What replaces the given columns: every third row gets the hot key, a few get none.
EDITS = {
    "lineitem": """REPLACE (
        CASE WHEN rn % 3 = 0 THEN 5 WHEN rn % 101 = 1 THEN NULL ELSE l_orderkey END AS l_orderkey,
        CASE WHEN rn % 3 = 0 THEN 7 WHEN rn % 103 = 1 THEN NULL ELSE l_partkey END AS l_partkey,
        CASE WHEN rn % 3 = 0 THEN 3 WHEN rn % 107 = 1 THEN NULL ELSE l_suppkey END AS l_suppkey)""",
    "orders": """REPLACE (
        CASE WHEN rn % 3 = 0 THEN 11 WHEN rn % 97 = 1 THEN NULL ELSE o_custkey END AS o_custkey)""",
    "events": """REPLACE (
        CASE WHEN rn % 3 = 0 THEN 2 WHEN rn % 89 = 1 THEN NULL ELSE user_id END AS user_id)""",
    "customer": """REPLACE (
        CASE WHEN rn % 3 = 0 THEN 6 ELSE c_nationkey END AS c_nationkey,
        CASE WHEN rn % 41 = 1 THEN NULL ELSE c_mktsegment END AS c_mktsegment)""",
}


@pytest.fixture(scope="module")
def skewed(tiny, tmp_path_factory):
    out = tmp_path_factory.mktemp("skewed")
    con = duckdb.connect()
    for table in oracle.GIVEN:
        source = f"read_parquet('{tiny}/{table}.parquet')"
        if table in EDITS:
            source = f"""(SELECT * EXCLUDE (rn) {EDITS[table]}
                          FROM (SELECT *, row_number() OVER () AS rn FROM {source}))"""
        con.execute(f"COPY (SELECT * FROM {source}) TO '{out}/{table}.parquet' (FORMAT parquet)")
    return str(out)


@pytest.fixture(scope="module")
def con(skewed):
    return oracle.connect(skewed)


@pytest.mark.parametrize("name", [n for n in driver.queries() if n in driver.oracle_sql()])
def test_query_under_skew(spark, skewed, con, name):
    oracle.assert_same(driver.queries()[name](spark, skewed), con, driver.oracle_sql()[name])
