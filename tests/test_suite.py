"""Suite records, stored results, verdicts, JSON readers, roll-ups and rule checks."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from varve.operators import coverage, suite
from varve.sources import answers, tables


def test_run_suite_records_success_and_failure(spark):
    records = suite.run_suite(
        spark,
        {"ok": "SELECT id FROM range(7)", "built": lambda: spark.range(3),
         "bad": "SELECT nothing FROM nowhere", "late": "SELECT CAST('x' AS INT) FROM range(3)"},
        repeats=2,
    )
    rows = records.collect()
    assert [(r["query"], r.repeat, r.success, r.row_count) for r in rows] == [
        ("ok", 1, True, 7), ("ok", 2, True, 7), ("built", 1, True, 3), ("built", 2, True, 3),
        ("bad", 1, False, None), ("late", 1, False, None),
    ]
    assert rows[0].columns == ["id"] and rows[0].error is None
    assert "TABLE_OR_VIEW_NOT_FOUND" in rows[4].error and "stacktrace" not in rows[4].error
    summary = suite.run_summary(records).first()
    assert (summary.engine, summary.queries, summary.succeeded) == ("spark", 4, 2)
    assert summary.total_s > 0


def test_stored_rows(spark):
    df = spark.sql("""SELECT * FROM VALUES (2, DATE'2024-01-02', 1.50BD, NULL, TIMESTAMP_NTZ'2024-01-02 03:04:05'),
                      (1, DATE'2024-01-01', 2.00BD, true, NULL) AS t(a, d, m, b, ts) ORDER BY a""")
    rows = tables.result_rows(df, "q1").orderBy("ordinal").collect()
    assert [r.cells for r in rows] == [
        ["1", "2024-01-01", "2.00", "true", None],
        ["2", "2024-01-02", "1.50", None, "2024-01-02T03:04:05.000000"],
    ]
    assert rows[0].columns == ["a", "d", "m", "b", "ts"] and rows[0]["query"] == "q1"
    many = tables.result_rows(spark.range(60_000).repartition(7), "r")
    assert many.count() == 60_000 and many.agg(F.max("ordinal"), F.countDistinct("ordinal")).first() == (59_999, 60_000)


def test_results_are_stored_and_compared(spark, tmp_path):
    place = str(tmp_path / "results")
    tables.store_result(spark.range(3), "a", place)
    tables.store_result(spark.range(5), "a", place)
    tables.store_result(spark.range(2).selectExpr("id", "id / 3 AS x"), "b", place)
    stored = tables.stored_results(spark, place)
    assert {r["query"]: r["count"] for r in stored.groupBy("query").count().collect()} == {"a": 5, "b": 2}
    outcomes = suite.run_suite(spark, {"a": lambda: spark.range(5), "b": lambda: spark.range(2)})
    assert {r.verdict for r in suite.verdicts(outcomes, stored, stored).collect()} == {"PASSED"}


def frame(spark, rows):
    return spark.createDataFrame(rows, "query STRING, ordinal INT, cells ARRAY<STRING>")


def test_verdicts_and_best_reference(spark):
    published = frame(spark, [("a", 0, ["1"])])
    preferred = frame(spark, [("a", 0, ["9"]), ("b", 0, ["2"])])
    other = frame(spark, [("b", 0, ["8"]), ("c", 0, ["3"])])
    reference = suite.best_reference(published, preferred, other)
    assert {(r["query"], r.cells[0]) for r in reference.collect()} == {("a", "1"), ("b", "2"), ("c", "3")}
    results = frame(spark, [("a", 0, ["1.001"]), ("b", 0, ["3"]), ("d", 0, ["4"])])
    outcomes = spark.createDataFrame(
        [("a", True, None), ("b", True, None), ("c", False, "Boom: no"), ("d", True, None),
         ("e", True, None)], "query STRING, success BOOLEAN, error STRING")
    asked = reference.select("query").union(spark.createDataFrame([("e",)], "query STRING"))
    made = suite.verdicts(outcomes, results, reference, referenced=asked)
    assert {r["query"]: (r.verdict, r.reason) for r in made.collect()} == {
        "a": ("PASSED", "equal"),
        "b": ("FAILED", "first difference at row 0"),
        "c": ("FAILED", "Boom: no"),
        "d": ("PASSED", "ran; no reference to compare"),
        "e": ("PASSED", "equal"),
    }
    assert {r.verdict: r.queries for r in suite.verdict_counts(made).collect()} == {
        "PASSED": 3, "FAILED": 2}


def test_json_readers(spark, tmp_path):
    (tmp_path / "q06.json").write_text(json.dumps({
        "platform": "p", "engine": "spark", "query": "q06", "success": True, "durations_s": [0.5, 0.7],
        "duration_s": 0.6, "row_count": 2, "columns": ["a", "b"],
        "rows": [[1.5, "x"], [None, True]], "environment": {"cpus": 8},
    }, indent=1))
    head = answers.results(spark, str(tmp_path / "q06.json")).first()
    assert (head["query"], head.row_count, head.durations_s) == ("q06", 2, [0.5, 0.7])
    rows = answers.rows(spark, str(tmp_path / "q06.json")).orderBy("ordinal").collect()
    assert [r.cells for r in rows] == [["1.5", "x"], [None, "true"]]

    (tmp_path / "run.json").write_text(json.dumps({
        "platform": "p", "engine": "spark", "scale_factor": 1, "repeats": 3,
        "queries": {"q01": {"variant": "canonical", "success": True, "duration_s": 1.5, "row_count": 4,
                            "error": None},
                    "q02": {"variant": "canonical", "success": False, "error": "x"}},
    }))
    run = answers.run_summary(spark, str(tmp_path / "run.json"))
    assert {(r["query"], r.success, r.duration_s) for r in run.collect()} == {
        ("q01", True, 1.5), ("q02", False, None)}

    (tmp_path / "quality.json").write_text(json.dumps({
        "tables": {"region": {"rows": 5, "expected_rows": 5, "pk_unique": True, "pk_not_null": True,
                              "schema": [["r_regionkey", "int"]], "schema_matches": True,
                              "fingerprint": {"rows": 5, "hash_sum": "-12", "columns": ["a"]}}},
        "foreign_keys": [{"child": "a.b", "parent": "c.d", "orphans": 0}],
    }))
    quality = answers.quality_tables(spark, str(tmp_path / "quality.json")).first()
    assert (quality.table_name, quality.rows, quality.hash_sum) == ("region", 5, "-12")
    assert answers.quality_relations(spark, str(tmp_path / "quality.json")).first().child == "a.b"


def test_coverage_rollup(spark):
    data = [("g", "NATIVE", True), ("g", "WORKAROUND", True), ("g", "MISSING", True),
            ("g", "MISSING", False), ("g", "NOT_ASSESSED", True), ("h", "NOT_ASSESSED", False)]
    df = spark.createDataFrame(data, "g STRING, s STRING, r BOOLEAN")
    rows = {r.g: r for r in coverage.coverage_rollup(df, "g", F.col("s"), F.col("r")).collect()}
    g = rows["g"]
    assert (g.native, g.missing, g.not_assessed, g.total, g.covered) == (1, 2, 1, 4, 2)
    assert (g.outcome_coverage, g.native_parity, g.required_covered, g.required_total) == (0.5, 0.25, 2, 3)
    assert rows["h"].total == 0 and rows["h"].outcome_coverage is None


def test_rule_violations(spark):
    df = spark.createDataFrame([("a", "x"), ("a", "y"), (None, "x"), ("b", None), ("a", "z")],
                               "k STRING, s STRING")
    out = coverage.rule_violations(df, required=["k", "s"], allowed={"s": ["x", "y"]}, unique=[["k"]])
    assert {tuple(r) for r in out.collect()} == {
        ("required", "k", None, 1), ("required", "s", None, 1), ("allowed", "s", "z", 1),
        ("unique", "k", None, 2),
    }
    clean = coverage.rule_violations(df.where("s = 'x'"), allowed={"s": ["x"]}, unique=[["k", "s"]])
    assert clean.isEmpty()


@pytest.mark.parametrize("kind, ids", [("left_semi", [1]), ("left_anti", [2, None])])
def test_membership_with_nulls(spark, kind, ids):
    from varve.operators.joins import exists_in, missing_from

    a = spark.createDataFrame([(1,), (2,), (None,)], "a INT")
    b = spark.createDataFrame([(1,), (1,), (None,)], "b INT")
    op = exists_in if kind == "left_semi" else missing_from
    assert [r.a for r in op(a, b, a="b").orderBy(F.col("a").asc_nulls_last()).collect()] == ids


@pytest.mark.parametrize("members", [[], [1], [1, None], [None]])
def test_not_in_follows_sql(spark, members):
    from varve.operators.joins import not_in

    a = spark.createDataFrame([(1,), (2,), (None,)], "a INT")
    b = spark.createDataFrame([(m,) for m in members], "b INT")
    a.createOrReplaceTempView("not_in_a")
    b.createOrReplaceTempView("not_in_b")
    sql = spark.sql("SELECT a FROM not_in_a WHERE a NOT IN (SELECT b FROM not_in_b)")
    assert sorted(map(str, sql.collect())) == sorted(map(str, not_in(a, "a", b, "b").collect()))
