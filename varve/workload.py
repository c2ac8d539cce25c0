"""The batch workload end to end: raw, bronze, silver, gold, quality, dimension, queries.

Each step is a plain function that reads the tables of the step before and writes its own,
so any scheduler can call them; ``run`` calls them in order.
"""

from __future__ import annotations

import uuid
from collections.abc import Mapping
from functools import reduce

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from varve import schema
from varve.operators import layers, quality, reconcile, scd2, suite
from varve.plans import gold, tpch, tpch_sql
from varve.schema import Layout
from varve.sources import changes, generator, tables
from varve.sources.dimension_store import DimensionStore
from varve.sources.standin import Tables

GOLD_TABLE = "revenue_by_nation_year"


def build_raw(spark: SparkSession, layout: Layout, chunks: int | None = None) -> DataFrame:
    """Generate the raw files; returns the manifest."""
    return generator.generate(spark, layout.scale_factor, layout.raw_root, chunks)


def _publish(spark, layout: Layout, database: str, name: str, df: DataFrame, comment: str,
             properties: dict[str, str]) -> None:
    tables.refresh(
        spark, df, layout.name(database, name), location=layout.location(database, name),
        comment=comment, properties=properties, table_format=layout.table_format,
    )


def _counts(spark, layout: Layout, database: str, names: list[str]) -> DataFrame:
    return layers.row_counts({n: tables.table(spark, layout, database, n) for n in names})


def build_bronze(spark: SparkSession, layout: Layout, batch_id: str | None = None) -> DataFrame:
    """Raw files with lineage columns; returns the row counts."""
    tables.ensure_database(spark, layout, layout.bronze)
    batch = batch_id or uuid.uuid4().hex[:12]
    for name in schema.tables():
        _publish(
            spark, layout, layout.bronze, name,
            layers.add_lineage(tables.raw(spark, layout, name), batch),
            f"{name}: raw files with lineage columns", {"varve.layer": "bronze"},
        )
    return _counts(spark, layout, layout.bronze, schema.tables())


def build_silver(spark: SparkSession, layout: Layout) -> DataFrame:
    """Bronze conformed to the declared schema; returns the row counts."""
    tables.ensure_database(spark, layout, layout.silver)
    for name in schema.tables():
        _publish(
            spark, layout, layout.silver, name,
            layers.conform(tables.table(spark, layout, layout.bronze, name), name),
            f"{name}: declared columns and types", {"varve.layer": "silver"},
        )
    return _counts(spark, layout, layout.silver, schema.tables())


def silver(spark: SparkSession, layout: Layout) -> Tables:
    return Tables(lambda t: tables.table(spark, layout, layout.silver, t))


def build_gold(spark: SparkSession, layout: Layout) -> DataFrame:
    """The revenue aggregate; returns its fingerprint."""
    tables.ensure_database(spark, layout, layout.gold)
    t = silver(spark, layout)
    _publish(
        spark, layout, layout.gold, GOLD_TABLE,
        gold.revenue_by_nation_year(t.orders, t.lineitem, t.customer, t.nation),
        "Net revenue per customer nation and order year", {"varve.layer": "gold"},
    )
    return quality.fingerprint(tables.table(spark, layout, layout.gold, GOLD_TABLE))


def check_quality(spark: SparkSession, layout: Layout) -> DataFrame:
    """Row counts, keys, relations and schemas of silver as a check list."""
    named = dict(silver(spark, layout).items())
    return quality.quality_checks(
        named, quality.expected_counts(layout.scale_factor, named)
    )


def silver_fingerprints(spark: SparkSession, layout: Layout) -> DataFrame:
    return quality.fingerprints(dict(silver(spark, layout).items()))


def run_incremental(spark: SparkSession, root: str) -> dict:
    """Feed the change batches one by one, then check that repeating the last is harmless."""
    store = DimensionStore(spark, root, changes.SCHEMA)
    applied: list[int] = []
    for batch_id in changes.BATCHES:
        store.ingest(batch_id, changes.batch_frame(spark, batch_id))
        applied += store.apply_pending()
    dimension = store.dimension()
    last = max(changes.BATCHES)
    again = scd2.apply_changes(dimension, store.batch(last), store.spec)
    refused = not store.ingest(last, changes.batch_frame(spark, last))
    return {
        "applied_batches": applied,
        "replay_idempotent": reconcile.difference(again, dimension).isEmpty(),
        "reingest_refused": refused,
        "dimension": dimension,
    }


def incremental_replay(store: DimensionStore, batches: Mapping[int, DataFrame]) -> DataFrame:
    """Feed batches one by one, then all of them again; one row for each batch.

    ``added`` and ``refused_again`` tell what the store did with a batch the first and the
    second time, ``applied`` and ``applied_again`` whether it was folded into the dimension.
    ``versions`` and ``current_versions`` count the dimension after the batch, and
    ``unlike_log`` the rows by which the dimension at the end differs from one built from the
    whole log at once. Rows of the dimension never pass through the driver.
    """
    facts = []
    for batch_id, rows in sorted(batches.items()):
        added = store.ingest(batch_id, rows)
        applied = batch_id in store.apply_pending()
        counted = store.dimension().agg(
            F.count(F.lit(1)).alias("versions"), F.count_if("is_current").alias("current_versions")
        )
        facts.append((batch_id, added, applied, counted))
    refused = {b: not store.ingest(b, rows) for b, rows in batches.items()}
    repeated = store.apply_pending()
    rebuilt = reconcile.difference(store.dimension(), scd2.from_log(store.log(), store.spec))
    unlike = rebuilt.count()

    def row(batch_id: int, added: bool, applied: bool, counted: DataFrame) -> DataFrame:
        known = {
            "batch_id": F.lit(batch_id).cast("int"), "added": F.lit(added), "applied": F.lit(applied),
            "refused_again": F.lit(refused[batch_id]), "applied_again": F.lit(batch_id in repeated),
        }
        return counted.select(
            *[value.alias(name) for name, value in known.items()], "*", F.lit(unlike).cast("bigint").alias("unlike_log")
        )

    return reduce(DataFrame.unionByName, [row(*f) for f in facts])


def run_queries(
    spark: SparkSession, layout: Layout, repeats: int = 1, names: list[str] | None = None
) -> DataFrame:
    """Run the 22 queries over silver; one record per query and repeat."""
    t = silver(spark, layout)
    chosen = names or list(tpch.PLANS)
    return suite.run_suite(
        spark, {n: (lambda n=n: tpch.run(n, t)) for n in chosen}, repeats
    )


def check_queries(spark: SparkSession, layout: Layout, names: list[str] | None = None) -> DataFrame:
    """Verdict per query: the DataFrame plan against the SQL text, both over silver."""
    t = silver(spark, layout)
    chosen = names or list(tpch.PLANS)

    def table(name: str) -> str:
        return layout.name(layout.silver, name)

    def stored(df: DataFrame, name: str) -> DataFrame:
        return tables.result_rows(df, name).select(*nothing.columns)  # runs the query

    nothing = spark.createDataFrame([], "query STRING, ordinal BIGINT, cells ARRAY<STRING>")
    results, outcomes = nothing, []
    for n in chosen:
        try:
            results = results.unionByName(stored(tpch.run(n, t), n))
            outcomes.append((n, True, None))
        except PySparkException as error:  # a query that fails has that verdict
            outcomes.append((n, False, f"{type(error).__name__}: {error}"))
    reference = [stored(tpch_sql.run_sql(spark, n, table), n) for n in chosen]
    return suite.verdicts(
        spark.createDataFrame(outcomes, "query STRING, success BOOLEAN, error STRING"),
        results, reduce(DataFrame.unionByName, reference, nothing),
        referenced=spark.createDataFrame([(n,) for n in chosen], "query STRING"),
    )


def run(spark: SparkSession, layout: Layout, incremental_root: str, repeats: int = 1) -> dict:
    """Every step in order. The values are small DataFrames and facts about each step."""
    return {
        "raw": build_raw(spark, layout),
        "bronze": build_bronze(spark, layout),
        "silver": build_silver(spark, layout),
        "gold": build_gold(spark, layout),
        "quality": check_quality(spark, layout),
        "fingerprints": silver_fingerprints(spark, layout),
        "incremental": run_incremental(spark, incremental_root),
        "queries": run_queries(spark, layout, repeats),
    }


def readability(spark: SparkSession, layout: Layout) -> DataFrame:
    """One check row: can every table of the workload be read?"""
    names = [layout.name(d, t) for d in (layout.bronze, layout.silver) for t in schema.tables()]
    names.append(layout.name(layout.gold, GOLD_TABLE))
    failed = tables.unreadable(spark, names)
    status = quality.FAIL if failed else quality.PASS
    detail = f"{len(names) - len(failed)} of {len(names)} tables read" + "".join(
        f"; {name}: {error}" for name, error in failed
    )
    return quality.check_rows(spark, [("readable", "Tables can be read", status, detail)])


def same_content(left: DataFrame, right: DataFrame) -> DataFrame:
    """Check rows from two runs' fingerprints."""
    compared = quality.fingerprint_diff(left, right)
    return quality.check(
        compared, "fingerprints", "Content equal in both runs", ~F.col("equal"), F.col("table_name")
    )
