"""Streams end with the same tables as the batch functions, also when run again."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tests.test_scd2 import GOLDEN
from varve import schema
from varve.operators import scd2
from varve.operators.reconcile import difference
from varve.sources import changes
from varve.sources.dimension_store import DimensionStore
from varve.streaming import ingest


def test_bronze_takes_each_file_once(spark, tmp_path):
    landing, target, progress = (str(tmp_path / n) for n in ("in", "out", "progress"))
    spark.range(10).coalesce(1).write.parquet(landing)

    def run(batch_id):
        stream = ingest.read_files(spark, landing, "id BIGINT", max_files=1)
        return ingest.to_bronze(stream, target, progress, batch_id)

    run("s1")
    spark.range(10, 15).coalesce(1).write.mode("append").parquet(landing)
    run("s2")
    run("s3")
    out = spark.read.parquet(target)
    assert {r._batch_id: r["count"] for r in out.groupBy("_batch_id").count().collect()} == {
        "s1": 10, "s2": 5}
    assert out.select("_source_file").distinct().count() == 2


def test_silver_sets_bad_rows_aside(spark, tmp_path):
    landing = str(tmp_path / "in")
    rows = [("1", " A "), ("two", "B"), ("3", None)]
    spark.createDataFrame(rows, "r_regionkey STRING, r_name STRING").write.parquet(landing)
    fields = schema.struct("region").fields[:2]
    stream = ingest.read_files(spark, landing, "r_regionkey STRING, r_name STRING")
    ingest.to_silver(stream, fields, str(tmp_path / "good"), str(tmp_path / "bad"), str(tmp_path / "p"))
    good = spark.read.parquet(str(tmp_path / "good")).select("r_regionkey", "r_name")
    assert sorted(map(tuple, good.collect())) == [(1, "A"), (3, None)]
    assert spark.read.parquet(str(tmp_path / "bad")).first()._rescued == [("r_regionkey", "two")]


def _feed(spark, path, *batches):
    for b in batches:
        changes.batch_frame(spark, b).coalesce(1).write.mode("append").parquet(path)


def test_dimension_from_a_stream_of_change_files(spark, tmp_path):
    landing, progress = str(tmp_path / "in"), str(tmp_path / "progress")
    store = DimensionStore(spark, str(tmp_path / "dim"), changes.SCHEMA)

    def run(checkpoint=progress):
        ingest.to_dimension(ingest.read_files(spark, landing, changes.SCHEMA), store, checkpoint)

    _feed(spark, landing, 1)
    run()
    assert store.applied() == [1]
    # two batches arrive in one micro-batch, and are applied in order
    _feed(spark, landing, 2, 3)
    run()
    assert [tuple(r) for r in scd2.snapshot(store.dimension()).collect()] == GOLDEN
    # a lost checkpoint delivers everything again; the log refuses it
    run(str(tmp_path / "fresh"))
    assert store.applied() == [1, 2, 3]
    batch = scd2.from_log(changes.feed(spark))
    assert difference(store.dimension(), batch).isEmpty()


def test_change_batches_cut_over_micro_batches(spark, tmp_path):
    landing = str(tmp_path / "in")
    changes.feed(spark).repartition(5).write.parquet(landing)
    store = DimensionStore(spark, str(tmp_path / "dim"), changes.SCHEMA)
    stream = ingest.read_files(spark, landing, changes.SCHEMA, max_files=1)
    ingest.to_dimension(stream, store, str(tmp_path / "progress"))
    assert [tuple(r) for r in scd2.snapshot(store.dimension()).collect()] == GOLDEN
    # new rows for an applied batch would be lost
    late = changes.batch_frame(spark, 2).where("customer_id = 2").withColumn("customer_id", F.lit(9).cast("bigint"))
    late.coalesce(1).write.mode("append").parquet(landing)
    with pytest.raises(Exception, match="which was applied"):
        ingest.to_dimension(stream, store, str(tmp_path / "progress"))


def test_a_row_in_two_parts_changes_a_run_once(spark, tmp_path):
    """Runs take the log as it lies: no exchange makes its rows distinct, and a row twice is one change."""
    spec = scd2.Spec(sequence=("effective_date", "seq"), many_per_batch=True)
    feed = changes.feed(spark).withColumn("seq", F.col("batch_id").cast("bigint"))
    store = DimensionStore(spark, str(tmp_path / "dim"), f"{changes.SCHEMA}, seq BIGINT", spec)
    for part in ("a", "b"):
        store.add_part(feed, part)
    store.close_parts()
    assert "Exchange" not in store._pending(1)._jdf.queryExecution().executedPlan().toString()
    assert store._pending(1).count() == 2 * store.batch(1).count()
    assert store.apply_pending() == [1, 2, 3]
    assert [tuple(r) for r in scd2.snapshot(store.dimension()).collect()] == GOLDEN


def test_change_files_grow_in_number_with_the_orders(spark, tiny, tmp_path, monkeypatch):
    from varve.plans import queries_more

    monkeypatch.setattr(queries_more, "_scratch", lambda _: str(tmp_path))
    monkeypatch.setattr(queries_more, "_FEED_ROWS", 100)
    dim = queries_more._stream_dimension(spark, tiny)
    feed = spark.read.parquet(str(tmp_path / "feed"))
    assert len(feed.inputFiles()) == 15 and feed.count() == 1500
    assert len(list((tmp_path / "progress" / "commits").glob("[0-9]*"))) == 3
    log = queries_more._order_steps(spark, tiny)
    assert difference(dim, scd2.from_log(log, queries_more._STEP_SPEC)).isEmpty()
