"""Golden versions of the change feed, and random logs against a plain row-by-row fold."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from varve.operators import ordered, scd2
from varve.sources import changes

# id, name, segment, city, valid_from, valid_to, is_current
GOLDEN = [
    (1, "Ada", "BUILDING", "Copenhagen", "2024-01-01", None, True),
    (2, "Grace", "MACHINERY", "Aarhus", "2024-01-01", "2024-02-01", False),
    (2, "Grace", "MACHINERY", "Copenhagen", "2024-02-01", "2024-03-01", False),
    (2, "Grace", "AUTOMOBILE", "Copenhagen", "2024-03-01", None, True),
    (3, "Linus", "AUTOMOBILE", "Odense", "2024-01-01", None, True),
    (4, "Margaret", "HOUSEHOLD", "Aalborg", "2024-01-01", None, True),
    (5, "Edsger", "FURNITURE", "Esbjerg", "2024-01-01", "2024-02-01", False),
    (5, "Edsger", "FURNITURE", "Roskilde", "2024-02-01", None, True),
    (6, "Barbara", "BUILDING", "Vejle", "2024-01-01", "2024-02-01", False),
    (6, "Barbara", "BUILDING", "Kolding", "2024-03-01", None, True),
    (7, "Ken", "MACHINERY", "Horsens", "2024-02-01", "2024-03-01", False),
    (7, "Kenneth", "MACHINERY", "Horsens", "2024-03-01", None, True),
]


def rows(df):
    return [tuple(r) for r in scd2.snapshot(df).collect()]


def folded(spark, log, batches):
    return scd2.fold(scd2.empty(spark, log), log, batches)


def test_golden_batch_by_batch(spark):
    log = changes.feed(spark)
    assert rows(folded(spark, log, changes.BATCHES)) == GOLDEN


@pytest.mark.parametrize("sampled", [1, 3, 32])
def test_golden_from_log(spark, monkeypatch, sampled):
    """Chunks of one row, of a few and of all."""
    monkeypatch.setattr(ordered, "SAMPLED", sampled)
    assert rows(scd2.from_log(changes.feed(spark))) == GOLDEN


def test_replaying_the_latest_batch_changes_nothing(spark):
    log = changes.feed(spark)
    dim = folded(spark, log, [1, 2, 3])
    again = scd2.apply_changes(dim, log.where("batch_id = 3"))
    assert rows(again) == GOLDEN


def test_hash_comparison_gives_the_same_versions(spark):
    spec = scd2.Spec(compare_hashes=True)
    log = changes.feed(spark)
    assert rows(scd2.fold(scd2.empty(spark, log, spec), log, [1, 2, 3], spec)) == GOLDEN


def _batch(spark, data, batch=1, day="2024-05-01"):
    return spark.createDataFrame(
        [(batch, dt.date.fromisoformat(day), *row) for row in data], changes.SCHEMA
    )


def test_two_changes_for_a_key_are_refused(spark):
    batch = _batch(spark, [("U", 1, "a", "b", "c"), ("U", 1, "a", "b", "d")])
    with pytest.raises(Exception, match="two changes for one key"):
        scd2.apply_changes(scd2.empty(spark, batch), batch).collect()


def test_stale_change_is_refused(spark):
    first = _batch(spark, [("U", 1, "a", "b", "c")])
    dim = scd2.apply_changes(scd2.empty(spark, first), first)
    late = _batch(spark, [("U", 1, "a", "b", "x")], 2, "2024-04-01")
    with pytest.raises(Exception, match="dated before"):
        scd2.apply_changes(dim, late).collect()


def test_null_attributes_make_versions(spark):
    # the stored hash cannot tell these two apart, the columns can
    one = _batch(spark, [("U", 1, "a", None, "b")])
    dim = scd2.apply_changes(scd2.empty(spark, one), one)
    two = _batch(spark, [("U", 1, "a", "b", None)], 2, "2024-06-01")
    assert [r[2:] for r in rows(scd2.apply_changes(dim, two))] == [
        (None, "b", "2024-05-01", "2024-06-01", False),
        ("b", None, "2024-06-01", None, True),
    ]
    assert dim.collect()[0].record_hash == two.select(
        scd2.record_hash(("name", "segment", "city"))).first()[0]


def test_unknown_delete_and_empty_batch(spark):
    batch = _batch(spark, [("D", 9, "a", "b", "c")])
    assert rows(scd2.apply_changes(scd2.empty(spark, batch), batch)) == []
    dim = folded(spark, changes.feed(spark), [1, 2, 3])
    assert rows(scd2.apply_changes(dim, batch.where("false"))) == GOLDEN


def brute(log_rows):
    """Row-by-row fold of (batch, day, op, id, name, segment, city), ordered per key."""
    dim = []
    for _, day, op, key, *attrs in sorted(log_rows, key=lambda r: (r[1], r[0])):
        open_row = next((r for r in dim if r[0] == key and r[6]), None)
        if open_row and (op == "D" or open_row[1:4] != attrs):
            open_row[5], open_row[6] = day.isoformat(), False
        if op == "U" and not (open_row and open_row[1:4] == attrs):
            dim.append([key, *attrs, day.isoformat(), None, True])
    return sorted(map(tuple, dim), key=lambda r: (r[0], r[4]))


@pytest.mark.parametrize("seed", range(3))
def test_random_logs(spark, monkeypatch, seed):
    rng = random.Random(seed)
    log = []
    for batch in range(1, 7):
        day = dt.date(2024, 1, 1) + dt.timedelta(days=batch)
        for key in rng.sample(range(12), 7):
            attrs = [rng.choice(["x", "y", None]) for _ in range(3)]
            log.append((batch, day, rng.choice("UUUD"), key, *attrs))
    frame = spark.createDataFrame(log, changes.SCHEMA)
    expected = brute(log)
    assert rows(folded(spark, frame, range(1, 7))) == expected
    assert rows(scd2.from_log(frame)) == expected
    monkeypatch.setattr(ordered, "SAMPLED", 2)
    assert rows(scd2.from_log(frame)) == expected


RUNS = scd2.Spec(sequence=("effective_date", "seq"), many_per_batch=True)


@pytest.mark.parametrize("seed", range(2))
def test_batches_with_several_changes_of_a_key(spark, seed):
    rng = random.Random(seed)
    log = []
    for seq in range(60):
        day = dt.date(2024, 1, 1) + dt.timedelta(days=seq // 3)
        attrs = [rng.choice(["x", "y", None]) for _ in range(3)]
        log.append((seq // 15 + 1, day, rng.choice("UUUD"), rng.randrange(4), *attrs, seq))
    frame = spark.createDataFrame(log, changes.SCHEMA + ", seq BIGINT")
    # days tie, so the sequence stands in for the batch in the plain fold, and versions are a bag
    expected = brute([(seq, *row) for _, *row, seq in log])
    by_batch = scd2.fold(scd2.empty(spark, frame, RUNS), frame, range(1, 5), RUNS)
    for dim in (by_batch, scd2.from_log(frame, RUNS)):
        assert sorted(map(str, rows(dim))) == sorted(map(str, expected))
    with pytest.raises(Exception, match="dated before"):
        late = frame.where("batch_id = 1").withColumn("op", F.lit("U"))
        scd2.apply_changes(by_batch, late, RUNS).collect()


def test_every_order_is_a_change_of_the_dimension(spark, tiny):
    """A customer's orders of one period all make versions, in each form."""
    import __spark_entry__ as driver

    names = ("scd2_snapshot", "scd2_apply_batches", "scd2_store", "stream_scd2")
    assert len({driver.queries()[n](spark, tiny).count() for n in names}) == 1


def test_as_of_and_log_lookup(spark):
    log = changes.feed(spark)
    dim = scd2.from_log(log)
    day = scd2.as_of(dim, "2024-02-15").select("customer_id", "city").collect()
    assert sorted(map(tuple, day)) == [
        (1, "Copenhagen"), (2, "Copenhagen"), (3, "Odense"), (4, "Aalborg"), (5, "Roskilde"),
        (7, "Horsens"),
    ]
    asked = spark.createDataFrame([(2,), (9,)], "batch_id INT")
    assert sorted(map(tuple, scd2.log_contains(log, asked).collect())) == [(2, True), (9, False)]


def test_one_hot_key_is_spread_over_tasks(spark):
    hot = spark.range(3000).select(
        F.col("id").cast("int").alias("batch_id"),
        F.expr("date_add(DATE '2020-01-01', CAST(id AS INT))").alias("effective_date"),
        F.lit("U").alias("op"), F.lit(1).cast("bigint").alias("customer_id"),
        F.lit("n").alias("name"), F.lit("s").alias("segment"),
        (F.col("id") / 2).cast("int").cast("string").alias("city"),
    )
    dim = scd2.from_log(hot)
    assert dim.count() == 1500
    assert dim.where("is_current").count() == 1
    chunks = ordered.split_chunks(hot, ["customer_id"], ["batch_id"])
    sizes = dict(map(tuple, chunks.groupBy(ordered.CHUNK).count().collect()))
    assert max(sizes.values()) < 1500
    assert sorted(sizes) == list(range(len(sizes)))


def test_hot_key_among_others(spark):
    """A key that holds most rows is cut into chunks, of which two rows each meet; the others are left whole."""
    log = spark.range(4000).select(
        F.lit(1).alias("batch_id"), F.expr("date_add(DATE '2020-01-01', CAST(id AS INT))").alias("effective_date"),
        F.when(F.col("id") % 5 == 0, "D").otherwise("U").alias("op"),
        F.when(F.col("id") % 3 == 0, F.col("id")).otherwise(1).alias("customer_id"),
        F.lit("n").alias("name"), F.lit(None).cast("string").alias("segment"), (F.col("id") / 40).cast("int").cast("string").alias("city"),
    )
    dim = scd2.from_log(log)
    chunks = ordered.split_chunks(log, ["customer_id"], ["effective_date", "batch_id"]).cache()
    held = dict(map(tuple, chunks.groupBy("customer_id").agg(F.countDistinct(ordered.CHUNK)).collect()))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert 1 < held[1] <= 4 * parts and sum(n > 1 for n in held.values()) <= 4 * parts
    assert chunks.groupBy("customer_id", ordered.CHUNK).count().agg(F.max("count")).first()[0] < 2000
    expected = brute([tuple(r) for r in log.collect()])
    assert sorted(map(str, rows(dim))) == sorted(map(str, expected))


def test_as_of_join(spark):
    """Facts meet the version of their day, also where nothing is valid and on a hot or NULL key."""
    rng = random.Random(3)
    first = dt.date(2020, 1, 1)
    log = [(1, first + dt.timedelta(days=3 * k + 1), rng.choice("UUD"), rng.choice([1, 1, 1, 2, None]), rng.choice("xyz"), None, "c") for k in range(300)]
    dim = scd2.from_log(spark.createDataFrame(log, changes.SCHEMA)).cache()
    facts = [(k, rng.choice([1, 1, 1, 2, 9, None]), rng.choice([None, first + dt.timedelta(days=rng.randrange(-50, 1100))])) for k in range(500)]
    frame = spark.createDataFrame(facts, "id INT, who BIGINT, day DATE")
    versions = [r.asDict() for r in dim.collect()]
    want = {}
    for k, who, day in facts:
        own = [v for v in versions if day and v["customer_id"] == who and v["valid_from"] <= day and (v["valid_to"] is None or day < v["valid_to"])]
        assert len(own) < 2
        want[k] = own[0] if own else None
    for days in (1, 64, 5000):
        joined = scd2.as_of_join(frame, dim, F.col("who"), F.col("day"), bucket_days=days)
        assert {r.id: r.version.asDict() if r.version else None for r in joined.collect()} == want
    assert scd2.as_of_join(frame.where("day IS NULL"), dim, F.col("who"), F.col("day")).where("version IS NULL").count() == sum(d is None for _, _, d in facts)
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_a_log_without_long_keys_is_shuffled_once(spark):
    """Split points in keys of few rows are dropped, so nothing has to be linked; a long key is still cut."""
    log = spark.range(4000).select(
        F.lit(1).alias("batch_id"), F.expr("date_add(DATE '2020-01-01', CAST(id AS INT))").alias("effective_date"),
        F.lit("U").alias("op"), (F.col("id") % 400).alias("customer_id"),
        F.lit("n").alias("name"), F.lit("s").alias("segment"), F.col("id").cast("string").alias("city"),
    )
    order = ["effective_date", "batch_id"]
    assert ordered.split_points(log, ["customer_id"], order) == {}
    dim = scd2.from_log(log)
    plan = dim._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1 and plan.count("+- Sort [") == 1, plan
    assert dim.count() == 4000 and dim.where("is_current").count() == 400
    long = log.withColumn("customer_id", F.when(F.col("customer_id") < 200, -1).otherwise(F.col("customer_id")))
    assert set(ordered.split_points(long, ["customer_id"], order)) == {("-1",)}
    left = ordered.split_chunks(long, ["customer_id"], order).where(f"{ordered.CHUNK} IS NULL")
    assert left.count() == 2000 and left.where("customer_id = -1").isEmpty()
