"""Run a suite of queries and judge its results, with every outcome as data."""

from __future__ import annotations

import datetime as dt
import time
from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from varve.functions.tolerant import Tolerance
from varve.operators import ordered
from varve.operators.reconcile import compare_results

RECORD = (
    "engine STRING, query STRING, repeat INT, success BOOLEAN, duration_s DOUBLE, "
    "row_count BIGINT, columns ARRAY<STRING>, error STRING, started TIMESTAMP"
)

PASSED, FAILED = "PASSED", "FAILED"


def _attempt(build: Callable[[], DataFrame]) -> tuple:
    """Run a query to the end without moving its rows anywhere; count them on the way."""
    begin = time.perf_counter()
    try:
        df = build()
        seen = Observation()
        df.observe(seen, F.count(F.lit(1)).alias("rows")).write.format("noop").mode(
            "overwrite"
        ).save()
        return True, round(time.perf_counter() - begin, 4), seen.get["rows"], df.columns, None
    except Exception as error:  # the failure is the measurement
        message, *_ = str(error).split("\n\nJVM stacktrace:")
        text = f"{type(error).__name__}: {message}"
        return False, round(time.perf_counter() - begin, 4), None, None, text


def run_suite(
    spark: SparkSession,
    queries: Mapping[str, str | Callable[[], DataFrame]],
    repeats: int = 1,
    engine: str = "spark",
) -> DataFrame:
    """One record per query and repeat. A query is SQL text or a function building it.

    Planning and execution are timed together. A failing query is recorded and ends its
    own repeats only.
    """
    records = []
    for name, query in queries.items():
        build = (lambda text=query: spark.sql(text)) if isinstance(query, str) else query
        for repeat in range(1, repeats + 1):
            started = dt.datetime.now(dt.timezone.utc)
            outcome = _attempt(build)
            records.append((engine, name, repeat, *outcome, started))
            if not outcome[0]:
                break
    return spark.createDataFrame(records, RECORD)


def query_medians(records: DataFrame, chunk: Column | None = None) -> DataFrame:
    """``(engine, query, duration_s)``: exact median over the repeats that succeeded."""
    rule = F.floor("duration_s") if chunk is None else chunk
    return ordered.median(
        records.where("success"), ["engine", "query"], "duration_s", rule, "duration_s"
    )


def run_summary(records: DataFrame, chunk: Column | None = None) -> DataFrame:
    """Per engine: queries run, queries whose every repeat succeeded, total of medians."""
    outcome = records.groupBy("engine", "query").agg(F.every("success").alias("success"))
    counts = outcome.groupBy("engine").agg(
        F.count(F.lit(1)).alias("queries"), F.count_if("success").alias("succeeded")
    )
    failed = outcome.where(~F.col("success")).select("engine", "query")
    medians = query_medians(records, chunk).join(failed, ["engine", "query"], "left_anti")
    totals = medians.groupBy("engine").agg(
        F.sum(F.col("duration_s").cast("decimal(28,6)")).cast("decimal(38,6)").alias("total_s")
    )
    return counts.join(totals, "engine", "left").select("engine", "queries", "succeeded", "total_s")


def best_reference(published: DataFrame, *runs: DataFrame) -> DataFrame:
    """Expected rows per query: published answers, else the first run that has the query.

    All frames hold ``(query, ordinal, cells)``.
    """
    columns = ["query", "ordinal", "cells"]
    chosen = published.select(*columns)
    for run in runs:
        known = chosen.select("query").distinct()
        chosen = chosen.unionByName(run.select(*columns).join(known, "query", "left_anti"))
    return chosen


def verdicts(
    outcomes: DataFrame, results: DataFrame, reference: DataFrame,
    referenced: DataFrame | None = None, tolerance: Tolerance = Tolerance(lenient_text=True),
) -> DataFrame:
    """``(query, verdict, reason)`` for every query of ``outcomes (query, success, error)``.

    A query passes when it ran and its rows match the reference; one that ran and has no
    reference passes with that reason, since there is nothing to hold against it. Queries
    whose reference is an empty answer have no reference rows: name them in ``referenced``.
    """
    compared = compare_results(results, reference, tolerance)
    known = (reference if referenced is None else referenced).select("query").distinct()
    merged = outcomes.join(compared, "query", "left").join(
        known.withColumn("__ref", F.lit(True)), "query", "left"
    )
    # neither side has rows: two empty answers
    reason = (
        F.when(~F.col("success"), F.coalesce(F.col("error"), F.lit("failed")))
        .when(F.col("__ref").isNull(), "ran; no reference to compare")
        .otherwise(F.coalesce(F.col("reason"), F.lit("equal")))
    )
    passed = F.col("success") & (F.col("__ref").isNull() | F.coalesce("equal", F.lit(True)))
    return merged.select(
        "query", F.when(passed, PASSED).otherwise(FAILED).alias("verdict"),
        reason.alias("reason"),
    )


def verdict_counts(frame: DataFrame) -> DataFrame:
    return frame.groupBy("verdict").agg(F.count(F.lit(1)).alias("queries"))
