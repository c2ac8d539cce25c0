"""Bronze and silver: lineage columns on raw files, then the declared schema."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from varve import schema

# Names of the lineage columns.
SOURCE_FILE, BATCH_ID, INGESTED_AT = "_source_file", "_batch_id", "_ingested_at"


def add_lineage(df: DataFrame, batch_id: str) -> DataFrame:
    """Raw columns plus source file, batch and ingestion time.

    ``df`` must be a file scan, batch or streaming: only that has ``_metadata``.
    """
    return df.select(
        "*",
        F.col("_metadata.file_path").alias(SOURCE_FILE),
        F.lit(batch_id).alias(BATCH_ID),
        F.current_timestamp().alias(INGESTED_AT),
    )


def _trimmed(column: Column, field: T.StructField) -> Column:
    return F.trim(column) if isinstance(field.dataType, T.StringType) else column


def conform(df: DataFrame, table: str) -> DataFrame:
    """The table's declared columns, cast, with strings trimmed; anything else is dropped.

    Casts are strict: in ANSI mode one bad value fails the job. ``split_conforming`` keeps
    the good rows and returns the others instead.
    """
    return df.select(
        *[_trimmed(F.col(f.name).cast(f.dataType), f).alias(f.name)
          for f in schema.struct(table).fields]
    )


RESCUED = "_rescued"


def _try_conform(df: DataFrame, fields: list[T.StructField]) -> DataFrame:
    """All declared columns with NULL for bad values, and a map of the bad raw values."""
    raw = {f.name: F.col(f.name).cast("string") for f in fields}
    tried = {f.name: F.col(f.name).try_cast(f.dataType) for f in fields}
    bad = F.filter(
        F.array(*[
            F.when(F.col(f.name).isNotNull() & tried[f.name].isNull(),
                   F.struct(F.lit(f.name).alias("column"), raw[f.name].alias("value")))
            for f in fields
        ]),
        lambda entry: entry.isNotNull(),
    )
    return df.select(
        *[_trimmed(tried[f.name], f).alias(f.name) for f in fields], bad.alias(RESCUED)
    )


def split_conforming(df: DataFrame, fields: list[T.StructField]) -> tuple[DataFrame, DataFrame]:
    """(rows that conform, rows with at least one value that cannot be cast).

    Rescued rows keep their castable columns, plus ``_rescued``: the column name and raw
    text of each value that failed. Works on batch and streaming DataFrames.
    """
    tried = _try_conform(df, fields)
    good = F.size(RESCUED) == 0
    return tried.where(good).drop(RESCUED), tried.where(~good)


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """One row per table: ``(table_name, rows)``."""
    counts = [
        df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("table_name"), "rows")
        for name, df in tables.items()
    ]
    return reduce(DataFrame.unionByName, counts)

