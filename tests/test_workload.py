"""All layers on generated data, written as catalog tables with locations."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tests.test_scd2 import GOLDEN
from varve import schema, workload
from varve.operators import layers, quality, reconcile, scd2
from varve.schema import Layout
from varve.sources import changes, tables
from varve.sources.dimension_store import DimensionStore

SF = 0.001


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    base = tmp_path_factory.mktemp("workload")
    layout = Layout(SF, str(base / "raw"), table_root=str(base / "tables"))
    workload.build_raw(spark, layout, chunks=2)
    bronze = {r.table_name: r.rows for r in workload.build_bronze(spark, layout, "b1").collect()}
    silver = {r.table_name: r.rows for r in workload.build_silver(spark, layout).collect()}
    fingerprint = workload.build_gold(spark, layout).first()
    return layout, bronze, silver, fingerprint


def test_counts_stay_the_same_through_the_layers(built):
    layout, bronze, silver, fingerprint = built
    assert bronze == silver
    assert silver["orders"] == 1500 and silver["region"] == 5
    assert fingerprint.rows > 100 and fingerprint.columns == sorted(fingerprint.columns)


def test_bronze_lineage_and_table_metadata(spark, built):
    layout = built[0]
    bronze = tables.table(spark, layout, layout.bronze, "orders")
    row = bronze.select(layers.SOURCE_FILE, layers.BATCH_ID, layers.INGESTED_AT).first()
    assert "/orders/part-" in row[0] and row[1] == "b1" and row[2] is not None
    name = layout.name(layout.bronze, "orders")
    facts = {r.col_name: r.data_type for r in spark.sql(f"DESCRIBE TABLE EXTENDED {name}").collect()}
    assert facts["Comment"].startswith("orders") and "varve.layer=bronze" in facts["Table Properties"]
    assert facts["Location"].endswith("/tables/tpch_sf0_001_bronze/orders")
    by_path = tables.at_location(spark, layout.location(layout.silver, "orders"))
    assert by_path.count() == 1500


def test_silver_equals_raw_and_quality_passes(spark, built):
    layout = built[0]
    raw = {t: layers.conform(tables.raw(spark, layout, t), t) for t in schema.tables()}
    diff = workload.same_content(quality.fingerprints(raw), workload.silver_fingerprints(spark, layout))
    assert diff.first().status == quality.PASS
    checks = workload.check_quality(spark, layout).unionByName(workload.readability(spark, layout))
    assert {r.key: r.status for r in checks.collect()} == {
        "row_counts": "PASS", "primary_keys": "PASS", "foreign_keys": "PASS", "schemas": "PASS",
        "readable": "PASS",
    }
    assert quality.overall(checks).first().status == quality.PASS


def test_refresh_overwrites_and_matches_by_name(spark, built):
    layout = built[0]
    name = layout.name(layout.silver, "region")
    before = spark.table(name).collect()
    shuffled = spark.createDataFrame(before).select("r_comment", "r_name", "r_regionkey")
    tables.refresh(spark, shuffled.where("r_regionkey < 3"), name)
    assert spark.table(name).count() == 3
    with pytest.raises(ValueError, match="missing columns"):
        tables.refresh(spark, shuffled.drop("r_name"), name)
    tables.append(spark, shuffled.where("r_regionkey >= 3"), name)
    assert sorted(spark.table(name).collect()) == sorted(before)


def test_create_if_missing_quotes_its_texts(spark, built, tmp_path):
    layout = built[0]
    name = layout.name(layout.silver, "notes")
    for _ in range(2):
        tables.create_if_missing(
            spark, name, "a INT", location=str(tmp_path / "notes"), comment="it's here",
            properties={"varve.k": "v'w"},
        )
    assert tables.exists(spark, name) and spark.table(name).columns == ["a"]
    facts = {r.col_name: r.data_type for r in spark.sql(f"DESCRIBE EXTENDED {name}").collect()}
    assert facts["Comment"] == "it's here"
    assert tables.unreadable(spark, [name, "no_such_table"])[0][0] == "no_such_table"
    with tables.temp_view(spark.range(3), "short_lived") as view:
        assert spark.table(view).count() == 3
    assert not spark.catalog.tableExists("short_lived")


def test_incremental_run_and_rerun(spark, tmp_path):
    root = str(tmp_path / "dim")
    first = workload.run_incremental(spark, root)
    assert first["applied_batches"] == [1, 2, 3]
    assert first["replay_idempotent"] and first["reingest_refused"]
    assert [tuple(r) for r in scd2.snapshot(first["dimension"]).collect()] == GOLDEN
    second = workload.run_incremental(spark, root)
    assert second["applied_batches"] == []
    assert [tuple(r) for r in scd2.snapshot(second["dimension"]).collect()] == GOLDEN


def test_store_survives_a_crash_between_log_and_apply(spark, tmp_path):
    store = DimensionStore(spark, str(tmp_path / "dim"), changes.SCHEMA)
    assert store.dimension() is None
    for b in (1, 2):
        store.ingest(b, changes.batch_frame(spark, b))
    # nothing was applied yet: the next run picks both up
    assert store.apply_pending() == [1, 2]
    # a half-written step without its commit row is ignored, then replaced
    store.ingest(3, changes.batch_frame(spark, 3))
    junk = scd2.from_log(changes.feed(spark)).where("customer_id = 1")
    junk.write.partitionBy("is_current").parquet(str(tmp_path / "dim/versions/batch_id=3"))
    assert store.dimension().count() == 9
    assert store.apply_pending() == [3]
    assert [tuple(r) for r in scd2.snapshot(store.dimension()).collect()] == GOLDEN
    assert store.log().count() == 14
    store.ingest(0, changes.batch_frame(spark, 1))
    with pytest.raises(ValueError, match="arrived after"):
        store.apply_pending()


def test_queries_run_and_match_their_sql(spark, built):
    layout = built[0]
    names = ["q01", "q06", "q13", "q17"]
    records = workload.run_queries(spark, layout, repeats=2, names=names).collect()
    assert len(records) == 8 and all(r.success for r in records)
    assert {r.query: r.row_count for r in records}["q06"] == 1
    verdicts = workload.check_queries(spark, layout, names).collect()
    assert {r["query"]: r.verdict for r in verdicts} == {n: "PASSED" for n in names}


def test_a_query_that_fails_gets_that_verdict(spark, built, monkeypatch):
    plans = {"q06": workload.tpch.PLANS["q06"], "q13": lambda t, **_: t.orders.select("no_such_column")}
    monkeypatch.setattr(workload.tpch, "PLANS", plans)
    made = {r["query"]: r for r in workload.check_queries(spark, built[0], ["q06", "q13"]).collect()}
    assert made["q06"].verdict == "PASSED" and made["q13"].verdict == "FAILED"
    assert "no_such_column" in made["q13"].reason


def test_incremental_replay(spark, tmp_path):
    store = DimensionStore(spark, str(tmp_path / "dim"), changes.SCHEMA)
    batches = {b: changes.batch_frame(spark, b) for b in changes.BATCHES}
    first = workload.incremental_replay(store, batches).collect()
    assert [(r.batch_id, r.added, r.applied, r.refused_again, r.applied_again) for r in first] == [
        (b, True, True, True, False) for b in changes.BATCHES
    ]
    assert [r.unlike_log for r in first] == [0, 0, 0] and first[-1].versions == len(GOLDEN)
    again = workload.incremental_replay(store, batches).collect()
    assert not any(r.added or r.applied for r in again)


def test_gold_reconciles(spark, built):
    layout = built[0]
    gold = tables.table(spark, layout, layout.gold, workload.GOLD_TABLE)
    assert reconcile.summary(gold, gold.repartition(3)).first().equal
    changed = gold.withColumn("orders", F.col("orders") + F.when(F.col("nation") == "PERU", 1).otherwise(0))
    assert reconcile.summary(gold, changed).first().only_left > 0
