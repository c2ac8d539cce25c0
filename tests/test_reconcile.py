"""Comparisons against plain Python on small data, and under skew."""

from __future__ import annotations

import random
from collections import Counter
from decimal import Decimal

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from varve.functions.tolerant import Tolerance, values_equal
from varve.operators import ordered, reconcile

LENIENT = Tolerance(lenient_text=True)


@pytest.mark.parametrize("a, b, equal", [
    ("25.522005853257337", "25.522006", True),
    ("55909065222.827692", "55909065222.83", True),
    ("1.00", "1.02", False), ("1.00", "1.01", True),
    (" ABC ", "ABC", True), ("ABC", "ABD", False),
    (None, "NULL", True), (None, " ", True), (None, None, True), (None, "0", False),
    ("", "NULL", False), ("1d", "1", False), ("1e2", "100", True), ("x", "1", False),
])
def test_text_values(spark, a, b, equal):
    df = spark.createDataFrame([(a, b)], "a STRING, b STRING")
    got = df.select(values_equal(F.col("a"), F.col("b"), T.StringType(), LENIENT)).first()[0]
    assert got is equal


@pytest.mark.parametrize("a, b, equal", [
    ("1.00", "1.01", True), ("1.00", "1.0101", False), (None, None, True), (None, "1", False),
    ("-100000000.10", "-100000000.15", True), ("0.001", "-0.001", True),
])
def test_number_values(spark, a, b, equal):
    df = spark.createDataFrame([(a, b)], "a STRING, b STRING").selectExpr(
        "CAST(a AS DECIMAL(20,4)) a", "CAST(b AS DECIMAL(20,4)) b")
    kind = df.schema["a"].dataType
    assert df.select(values_equal(F.col("a"), F.col("b"), kind, Tolerance())).first()[0] is equal


def test_strict_text_is_exact(spark):
    df = spark.createDataFrame([("a ", "a"), (None, "NULL"), (None, None)], "a STRING, b STRING")
    got = df.select(values_equal(F.col("a"), F.col("b"), T.StringType(), Tolerance())).collect()
    assert [r[0] for r in got] == [False, False, True]


def test_difference_counts_copies(spark):
    a = spark.createDataFrame([(1, None)] * 3 + [(2, "x")], "k INT, v STRING")
    b = spark.createDataFrame([(None, 1)] + [("x", 2)] * 2 + [("z", 3)], "v STRING, k INT")
    got = {tuple(r) for r in reconcile.difference(a, b).collect()}
    assert got == {(1, None, 2, 0), (2, "x", 0, 1), (3, "z", 0, 1)}
    total = reconcile.summary(a, b).first()
    assert tuple(total) == (4, 4, 2, 2, False)
    assert reconcile.summary(a, a.repartition(2)).first().equal
    assert reconcile.summary(a.where("false"), a.where("false")).first().equal
    with pytest.raises(ValueError, match="columns differ"):
        reconcile.difference(a, b.drop("v"))
    assert reconcile.schema_difference(a, a.withColumn("k", F.col("k").cast("long"))) == [
        "k: int / bigint"
    ]


def test_compare_by_key(spark):
    a = spark.createDataFrame([(1, 1.0, "x"), (2, 2.0, "y"), (None, 3.0, "z"), (4, 4.0, None)],
                              "k INT, v DOUBLE, t STRING")
    b = spark.createDataFrame([(1, 1.009, "x"), (2, 2.5, "q"), (None, 3.0, "z"), (5, 4.0, None)],
                              "k INT, v DOUBLE, t STRING")
    got = {tuple(r) for r in reconcile.compare_by_key(a, b, ["k"]).collect()}
    assert got == {(2, "differs", "v,t"), (4, "left only", ""), (5, "right only", "")}
    with pytest.raises(Exception, match="not unique"):
        reconcile.compare_by_key(a.union(a), b, ["k"]).collect()


def brute_pairs(left, right):
    """Sort both sides of each group and pair by position."""
    out = Counter()
    for g in {r[0] for r in left + right}:
        a = sorted(r[1:] for r in left if r[0] == g)
        b = sorted(r[1:] for r in right if r[0] == g)
        for i in range(max(len(a), len(b))):
            x = a[i] if i < len(a) else None
            y = b[i] if i < len(b) else None
            if x is None:
                out[(g, None, None, *y, "right only")] += 1
            elif y is None:
                out[(g, *x, None, None, "left only")] += 1
            elif any(abs(p - q) > max(Decimal("0.01"), Decimal("1e-9") * abs(q))
                     for p, q in zip(x, y, strict=True)):
                out[(g, *x, *y, "differs")] += 1
    return out


@pytest.mark.parametrize("seed, chunk, block", [(0, None, 7), (1, "floor(v)", 3), (2, "floor(v)", 100)])
def test_compare_sorted(spark, seed, chunk, block):
    rng = random.Random(seed)

    def rows(n):
        # one group and one value hold most rows
        return [(rng.choice("aaaab"), Decimal(rng.choice([1, 1, 1, 150, 151, 230])) / 100,
                 Decimal(rng.randint(0, 3)) / 100) for _ in range(n)]

    left, right = rows(60), rows(55)
    kind = "g STRING, v DECIMAL(10,2), w DECIMAL(10,2)"
    result = reconcile.compare_sorted(
        spark.createDataFrame(left, kind), spark.createDataFrame(right, kind),
        chunk=F.expr(chunk) if chunk else None, block=block,
    )
    got = Counter()
    for r in result.collect():
        got[(r.g, r.left_v, r.left_w, r.right_v, r.right_w, r.status)] += r.copies
    assert got == brute_pairs(left, right)


def test_compare_sorted_of_equal_sides_and_exact_columns_only(spark):
    a = spark.range(50).selectExpr("CAST(id % 5 AS INT) AS k", "CAST(id AS DOUBLE) AS v")
    assert reconcile.compare_sorted(a, a.repartition(3)).isEmpty()
    k = a.select("k")
    assert reconcile.compare_sorted(k, k).isEmpty()
    only = reconcile.compare_sorted(k, k.union(spark.createDataFrame([(9,)], "k INT")))
    assert [tuple(r) for r in only.collect()] == [(9, "right only", 1)]


def test_running_totals_and_neighbours(spark):
    rng = random.Random(5)
    data = [(None if rng.random() < 0.1 else "h" if rng.random() < 0.7 else f"k{rng.randint(0, 3)}",
             i, rng.randint(1, 9)) for i in range(300)]
    df = spark.createDataFrame(data, "k STRING, at INT, n INT")
    expected = {}
    seen: dict = {}
    for k, at, n in data:
        total, before = seen.get(k, (0, None))
        expected[at] = (total, before)
        seen[k] = (total + n, n)
    sums = {k: total for k, (total, _) in seen.items()}
    for chunks in (ordered.range_chunks(df, ["k"], ["at"], 6),
                   ordered.chunked(df, F.floor(F.col("at") / 10))):
        totals = ordered.running_before(chunks, ["k"], ["at"], {"total": "n"}, {"all": "n"})
        out = ordered.previous(totals, ["k"], ["at"], "n", "prev").collect()
        assert {r["at"]: (r.total, r.prev and r.prev.value) for r in out} == expected
        assert all(r["all"] == sums[r.k] for r in out)
        after = ordered.following(chunks, ["k"], ["at"], "at", "next").where("k = 'h'").collect()
        hot = sorted(at for k, at, _ in data if k == "h")
        assert {r["at"]: r.next and r.next.value for r in after} == dict(
            zip(hot, [*hot[1:], None], strict=True))


def test_median(spark):
    import statistics

    rng = random.Random(3)
    data = [(rng.choice("ab"), round(rng.random() * 20, 1)) for _ in range(101)] + [("a", None), ("c", 2.0)]
    df = spark.createDataFrame(data, "k STRING, v DOUBLE")
    got = {r.k: r.m for r in ordered.median(df, ["k"], "v", F.floor("v"), "m").collect()}
    for k in "abc":
        assert got[k] == pytest.approx(statistics.median(v for g, v in data if g == k and v is not None))


def stored(spark, *queries):
    rows = [(q, i, cells) for q, lines in queries for i, cells in enumerate(lines)]
    return spark.createDataFrame(rows, "query STRING, ordinal INT, cells ARRAY<STRING>")


def test_compare_results(spark):
    actual = stored(
        spark, ("same", [["x", "1.00"]]), ("ties", [["x", "1.00"], ["y", "1.00"]]),
        ("short", [["x"]]), ("wide", [["x", "y"]]), ("off", [["a", "1"], ["b", "2"]]),
        ("blank", [[None, "NULL"]]), ("extra", [["1"]]),
    )
    expected = stored(
        spark, ("same", [["x ", "1.005"]]), ("ties", [["y", "1"], ["x", "1"]]),
        ("short", [["x"], ["y"]]), ("wide", [["x"]]), ("off", [["a", "1"], ["b", "3"]]),
        ("lost", [["z"]]),
    )
    got = {r["query"]: (r.equal, r.reason) for r in reconcile.compare_results(actual, expected).collect()}
    assert got == {
        "same": (True, "equal"),
        "ties": (True, "equal (ignoring order of tied rows)"),
        "short": (False, "row count 1 != 2"),
        "wide": (False, "column count 2 != 1"),
        "off": (False, "first difference at row 1"),
        "blank": (True, "equal (single NULL row)"),
        "extra": (False, "row count 1 != 0"),
        "lost": (False, "row count 0 != 1"),
    }
