"""Generated tables: counts, keys, relations, determinism; and the 22 queries on them."""

from __future__ import annotations

import duckdb
import pytest
from pyspark.sql import functions as F

from tests import oracle
from varve import schema
from varve.operators import quality
from varve.plans import tpch, tpch_sql
from varve.sources import generator
from varve.sources.standin import Tables

SF = 0.01


@pytest.fixture(scope="module")
def raw(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("raw"))
    manifest = generator.generate(spark, SF, root, chunks=2)
    return root, {r.table_name: (r.rows, r.files) for r in manifest.collect()}


@pytest.fixture(scope="module")
def tables(spark, raw):
    layout = schema.Layout(SF, raw[0])
    return Tables(lambda t: spark.read.parquet(layout.raw_path(t)))


@pytest.fixture(scope="module")
def con(raw):
    con = duckdb.connect()
    layout = schema.Layout(SF, raw[0])
    for t in schema.tables():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{layout.raw_path(t)}/*.parquet'")
    return con


def test_manifest_and_files(raw, tables):
    _, manifest = raw
    assert manifest["lineitem"] == (60_175, 2) and manifest["region"] == (5, 1)
    for name, df in tables.items():
        assert df.count() == manifest[name][0] == schema.expected_rows(name, SF)
        assert len(df.inputFiles()) == manifest[name][1]
        assert quality.schema_matches(df, name)


def test_keys_and_relations_hold(tables):
    named = dict(tables.items())
    keys = quality.key_reports(named).collect()
    assert all(r.pk_unique and r.pk_not_null for r in keys), keys
    orphans = quality.orphan_reports(
        named, (*schema.FOREIGN_KEYS, *schema.EXTRA_FOREIGN_KEYS)
    ).collect()
    assert all(r.orphans == 0 for r in orphans), orphans
    offered = tables.partsupp.select("ps_partkey", "ps_suppkey")
    unknown = tables.lineitem.join(
        offered, [F.col("l_partkey") == F.col("ps_partkey"),
                  F.col("l_suppkey") == F.col("ps_suppkey")], "left_anti")
    assert unknown.count() == 0


def test_lines_per_order(tables):
    per_order = tables.lineitem.groupBy("l_orderkey").agg(
        F.count("*").alias("n"), F.min("l_linenumber").alias("lo"), F.max("l_linenumber").alias("hi")
    )
    low, high, orders = per_order.agg(F.min("n"), F.max("n"), F.count("*")).first()
    assert 1 <= low < high <= 8 and orders == 15_000
    assert per_order.where("lo <> 1 OR hi <> n").count() == 0


def test_same_rows_whatever_the_number_of_files(spark, tables):
    from varve.operators.reconcile import difference

    again = generator.Generator(spark, SF, chunks=5).table("lineitem")
    assert difference(tables.lineitem, again).isEmpty()


@pytest.mark.parametrize("name", list(tpch.PLANS))
def test_query_with_specification_parameters(spark, tables, con, name):
    """The DataFrame plan, the SQL text on Spark and the SQL text on DuckDB agree."""
    sql = tpch_sql.text(name)
    plan = tpch.run(name, tables)
    rows = oracle.assert_same(plan, con, sql)
    if name in ("q01", "q05", "q09", "q12", "q18", "q21", "q22"):
        assert rows > 0
    for t in tpch_sql.table_names(name):
        getattr(tables, t).createOrReplaceTempView(t)
    oracle.assert_same(tpch_sql.run_sql(spark, name), con, sql)
