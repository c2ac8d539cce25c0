"""Readers for stored results, run summaries and quality reports in JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fields of the stored JSON documents.
_RESULT = (
    "source STRING, platform STRING, engine STRING, engine_version STRING, query STRING, "
    "scale_factor DOUBLE, variant STRING, success BOOLEAN, duration_s DOUBLE, "
    "durations_s ARRAY<DOUBLE>, row_count BIGINT, error STRING, timestamp STRING, "
    "columns ARRAY<STRING>, rows ARRAY<ARRAY<STRING>>"
)
_SUMMARY = (
    "platform STRING, engine STRING, scale_factor DOUBLE, repeats INT, queries MAP<STRING, "
    "STRUCT<variant: STRING, success: BOOLEAN, duration_s: DOUBLE, row_count: BIGINT, "
    "error: STRING>>"
)
_QUALITY = (
    "tables MAP<STRING, STRUCT<rows: BIGINT, expected_rows: BIGINT, pk_unique: BOOLEAN, "
    "pk_not_null: BOOLEAN, schema_matches: BOOLEAN, fingerprint: STRUCT<rows: BIGINT, "
    "hash_sum: STRING, columns: ARRAY<STRING>>>>, "
    "foreign_keys ARRAY<STRUCT<child: STRING, parent: STRING, orphans: BIGINT>>"
)


def _documents(spark: SparkSession, path: str | list[str], schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path, multiLine=True)


def results(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """One row per stored query result or published answer, without its rows."""
    return _documents(spark, path, _RESULT).drop("rows")


def rows(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """The rows of stored results: ``(query, engine, ordinal, columns, cells)``."""
    return _documents(spark, path, _RESULT).select(
        "query", "engine", "columns", F.posexplode("rows").alias("ordinal", "cells")
    )


def run_summary(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """One row per query of a run summary."""
    return _documents(spark, path, _SUMMARY).select(
        "platform", "engine", "scale_factor", "repeats", F.explode("queries").alias("query", "q")
    ).select("platform", "engine", "scale_factor", "repeats", "query", "q.*")


def quality_tables(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """One row per table of a stored quality report."""
    return _documents(spark, path, _QUALITY).select(
        F.explode("tables").alias("table_name", "t")
    ).select("table_name", "t.rows", "t.expected_rows", "t.pk_unique", "t.pk_not_null",
             "t.schema_matches", F.col("t.fingerprint.hash_sum").alias("hash_sum"))


def quality_relations(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """One row per foreign key of a stored quality report."""
    return _documents(spark, path, _QUALITY).select(F.inline("foreign_keys"))
