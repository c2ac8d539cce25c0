"""Checks must fail on broken data, and fingerprints must notice any change."""

from __future__ import annotations

import hashlib

import pytest
import xxhash
from pyspark.sql import functions as F

from varve import schema
from varve.functions.encoding import row_text
from varve.operators import layers, quality


def test_dictionary_facts():
    assert len(schema.tables()) == 8
    assert schema.expected_rows("region", 10) == 5
    assert schema.expected_rows("orders", 1) == 1_500_000
    assert schema.expected_rows("lineitem", 0.01) == 60_175
    assert schema.expected_rows("lineitem", 3) is None
    assert schema.expected_rows("part", 0.001) == 200
    with pytest.raises(KeyError):
        schema.expected_rows("nothing", 1)
    for table, keys in schema.PRIMARY_KEYS.items():
        assert set(keys) <= set(schema.struct(table).names)
    for r in (*schema.FOREIGN_KEYS, *schema.EXTRA_FOREIGN_KEYS):
        assert r.child_column in schema.struct(r.child).names
        assert r.parent_column in schema.struct(r.parent).names
    assert [schema.scale_tag(s) for s in (1, 10.0, 0.1)] == ["sf1", "sf10", "sf0_1"]
    layout = schema.Layout(0.1, "/raw/", catalog="cat", table_root="/t/")
    assert layout.raw_path("part") == "/raw/sf0_1/part"
    assert layout.name(layout.bronze, "part") == "cat.tpch_sf0_1_bronze.part"
    assert layout.location(layout.gold, "x") == "/t/tpch_sf0_1_gold/x"
    assert schema.Layout(1, "/raw").location("a", "b") is None


def test_keys_with_duplicates_and_nulls(spark):
    df = spark.createDataFrame(
        [(1, 1), (1, 1), (1, 2), (None, 1), (None, 1), (2, None)], "a INT, b INT"
    )
    row = quality.key_report(df, ["a", "b"]).first().asDict()
    assert row == {
        "rows": 6, "distinct_pk": 2, "null_pk": 3, "duplicate_keys": 1,
        "pk_unique": False, "pk_not_null": False,
    }
    # one NULL alone also breaks uniqueness, without any duplicate
    row = quality.key_report(df.where("b = 2 OR b IS NULL"), ["a", "b"]).first()
    assert (row.pk_unique, row.duplicate_keys, row.null_pk) == (False, 0, 1)
    empty = quality.key_report(df.where("false"), ["a"]).first()
    assert (empty.rows, empty.pk_unique, empty.pk_not_null) == (0, True, True)


def test_orphans_appear_when_a_parent_goes(spark):
    child = spark.createDataFrame([(1,), (1,), (2,), (None,), (3,)], "k INT")
    parent = spark.createDataFrame([(1,), (3,), (None,)], "p INT")
    row = quality.orphan_report(child, "k", parent, "p").first()
    assert (row.orphans, row.null_children) == (2, 1)
    row = quality.orphan_report(child, "k", parent.where("p = 3"), "p").first()
    assert row.orphans == 4
    row = quality.orphan_report(child.where("false"), "k", parent, "p").first()
    assert (row.orphans, row.null_children) == (0, 0)


def test_xxhash_of_text_matches_the_library(spark):
    df = spark.createDataFrame([("alpha",), ("beta",), (None,)], "t STRING")
    expected = 0
    for t in ("alpha", "beta"):
        unsigned = xxhash.xxh64(t.encode(), seed=42).intdigest()
        expected += unsigned - 2**64 if unsigned >= 2**63 else unsigned
    expected += 42  # a NULL leaves the seed as it is
    row = quality.fingerprint(df).first()
    assert (row.rows, int(row.hash_sum)) == (3, expected)


def test_md5_fingerprint_by_hand(spark):
    df = spark.createDataFrame([("ab", 1, "x"), (None, 2, "y")], "t STRING, n INT, _meta STRING")
    texts = ["v1:1v2:ab", "v1:2n"]
    assert [r[0] for r in df.select(row_text(df)).collect()] == texts
    expected = sum(int(hashlib.md5(t.encode()).hexdigest()[:15], 16) for t in texts)
    assert int(quality.fingerprint_md5(df).first().hash_sum) == expected
    with pytest.raises(TypeError, match="DECIMAL"):
        quality.fingerprint_md5(df.withColumn("d", F.lit(1.5)))


def test_timestamps_keep_their_text_in_any_zone(spark):
    from varve.functions.encoding import timestamp_text

    # neither hour exists on these days in Berlin and Los Angeles
    texts = ["2024-03-31 02:30:00.100000", "2024-03-10 02:30:07.000000", "1969-12-31 23:59:59.999999"]
    df = spark.createDataFrame([(t,) for t in texts], "t STRING").selectExpr(
        "t", "CAST(t AS TIMESTAMP_NTZ) AS ts")
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        for zone in ("Europe/Berlin", "America/Los_Angeles"):
            spark.conf.set("spark.sql.session.timeZone", zone)
            got = df.select("t", timestamp_text(F.col("ts"), " ").alias("x")).collect()
            assert all(r.t == r.x for r in got)
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


@pytest.mark.parametrize("method", [quality.fingerprint, quality.fingerprint_md5])
def test_fingerprints_ignore_order_and_metadata_only(spark, method):
    df = spark.range(100).select("id", F.concat(F.lit("n"), "id").alias("name"))
    same = df.orderBy(F.desc("id")).repartition(7).withColumn("_batch_id", F.lit("x"))
    assert method(df).first() == method(same).first()
    for other in (df.where("id <> 5"), df.union(df.where("id = 5")),
                  df.withColumn("name", F.when(F.col("id") == 5, "other").otherwise(F.col("name")))):
        assert method(df).first().hash_sum != method(other).first().hash_sum


def test_md5_tells_null_positions_apart(spark):
    a = spark.createDataFrame([("a", None)], "x STRING, y STRING")
    b = spark.createDataFrame([(None, "a")], "x STRING, y STRING")
    assert quality.fingerprint(a).first().hash_sum == quality.fingerprint(b).first().hash_sum
    assert quality.fingerprint_md5(a).first().hash_sum != quality.fingerprint_md5(b).first().hash_sum


def test_schema_report_and_match(spark):
    good = spark.createDataFrame([], schema.struct("region"))
    assert quality.schema_matches(good, "region")
    assert not quality.schema_matches(good.select("r_name", "r_regionkey", "r_comment"), "region")
    df = spark.createDataFrame([("1", "AFRICA"), ("one", None)], "r_regionkey STRING, r_name STRING")
    rows = {r.column_name: r for r in quality.schema_report(df, "region").collect()}
    assert (rows["r_regionkey"].actual_type, rows["r_regionkey"].matches) == ("string", False)
    assert rows["r_regionkey"].uncastable == 1
    assert rows["r_name"].matches and rows["r_name"].uncastable == 0
    assert rows["r_comment"].actual_type is None and rows["r_comment"].uncastable is None


def test_conform_trims_casts_and_drops(spark):
    df = spark.createDataFrame(
        [("7", "  ASIA ", "c", "gone")], "r_regionkey STRING, r_name STRING, r_comment STRING, x STRING"
    )
    out = layers.conform(df, "region")
    assert quality.schema_matches(out, "region") and out.first() == (7, "ASIA", "c")
    bad = df.withColumn("r_regionkey", F.lit("seven"))
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        layers.conform(bad, "region").collect()
    good, rescued = layers.split_conforming(df.union(bad), schema.struct("region").fields)
    assert [tuple(r) for r in good.collect()] == [(7, "ASIA", "c")]
    row = rescued.first()
    assert (row.r_regionkey, row.r_name, row._rescued) == (None, "ASIA", [("r_regionkey", "seven")])


def test_check_list(spark):
    counts = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "table_name STRING, rows BIGINT")
    report = quality.count_report(counts, {"a": F.lit(1), "b": F.lit(5), "c": F.lit(None)})
    assert {r.table_name: r.status for r in report.collect()} == {"a": "PASS", "b": "FAIL", "c": "SKIP"}
    mismatch = F.col("rows") != F.col("expected_rows")
    made = quality.check(report, "k", "t", mismatch, F.col("table_name"))
    assert made.first() == ("k", "t", "FAIL", "b")
    unknown = quality.check(report.where("table_name = 'c'"), "k", "t", mismatch, F.col("table_name"))
    assert unknown.first().status == "SKIP"
    both = made.unionByName(unknown).unionByName(quality.check_rows(spark, [("x", "x", "PASS", "")]))
    assert quality.overall(both).first() == ("FAIL", 1, 1, 1)


def test_profile_of_each_kind(spark):
    df = spark.createDataFrame([(1, "abc"), (2, None)], "n INT, s STRING").withColumn(
        "d", F.to_date(F.lit("1970-01-03"))
    )
    rows = {r.column_name: (r.measure, r.rows, float(r.total)) for r in quality.column_profile(df).collect()}
    assert rows == {"n": ("value", 2, 3.0), "s": ("length", 2, 3.0), "d": ("day", 2, 4.0)}


def test_lines_without_a_published_count_are_held_against_the_orders(spark):
    counts = spark.createDataFrame([("lineitem", 3)], "table_name STRING, rows LONG")
    unknown = {"lineitem": F.lit(None).cast("bigint")}
    status = lambda low, high: quality.count_report(
        counts, unknown, {"lineitem": (F.lit(low), F.lit(high))}
    ).first().status
    assert status(1, 7) == "PASS" and status(4, 28) == "FAIL" and status(0, 0) == "FAIL"
    assert quality.count_report(counts, unknown).first().status == "SKIP"
