"""Catalog tables: scans, full refreshes, appends and checks that they can be read."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from itertools import accumulate

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from varve.functions.encoding import timestamp_text
from varve.schema import Layout
from varve.session import ensure_checkpoint_dir


def raw(spark: SparkSession, layout: Layout, table: str) -> DataFrame:
    """Raw parquet files of a table."""
    return spark.read.parquet(layout.raw_path(table))


def table(spark: SparkSession, layout: Layout, database: str, name: str) -> DataFrame:
    return spark.table(layout.name(database, name))


def at_location(spark: SparkSession, location: str, table_format: str = "parquet") -> DataFrame:
    """A table read by storage location instead of through the catalog."""
    return spark.read.format(table_format).load(location)


@contextmanager
def temp_view(df: DataFrame, name: str) -> Iterator[str]:
    """A temporary view that exists inside the ``with`` block only."""
    df.createOrReplaceTempView(name)
    try:
        yield name
    finally:
        df.sparkSession.catalog.dropTempView(name)


def ensure_database(spark: SparkSession, layout: Layout, database: str) -> None:
    spark.sql(f"CREATE SCHEMA IF NOT EXISTS {layout.name(database, '')}")


def exists(spark: SparkSession, name: str) -> bool:
    return spark.catalog.tableExists(name)


def _quoted(text: str) -> str:
    escaped = text.replace("\\", "\\\\").replace("'", "\\'")
    return f"'{escaped}'"


def _clauses(
    location: str | None, comment: str | None, properties: dict[str, str] | None
) -> str:
    parts = []
    if location:
        parts.append(f"LOCATION {_quoted(location)}")
    if comment:
        parts.append(f"COMMENT {_quoted(comment)}")
    if properties:
        pairs = ", ".join(f"{_quoted(k)} = {_quoted(v)}" for k, v in sorted(properties.items()))
        parts.append(f"TBLPROPERTIES ({pairs})")
    return " ".join(parts)


def create_if_missing(
    spark: SparkSession, name: str, columns: str, *, location: str | None = None,
    comment: str | None = None, properties: dict[str, str] | None = None,
    table_format: str = "parquet",
) -> None:
    """An empty table from DDL columns, unless it exists."""
    spark.sql(
        f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING {table_format} "
        f"{_clauses(location, comment, properties)}"
    )


def _aligned(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """The frame's columns in the table's order; a missing or extra one is an error."""
    target = spark.table(name).columns
    if sorted(target) != sorted(df.columns):
        missing = sorted(set(target) - set(df.columns))
        extra = sorted(set(df.columns) - set(target))
        raise ValueError(f"{name}: missing columns {missing}, unexpected columns {extra}")
    return df.select(*target)


def refresh(
    spark: SparkSession, df: DataFrame, name: str, *, location: str | None = None,
    comment: str | None = None, properties: dict[str, str] | None = None,
    table_format: str = "parquet",
) -> None:
    """Replace a table's rows: created on the first write, overwritten afterwards.

    Comment and properties are set at creation. ``df`` must not read the same table.
    """
    if exists(spark, name):
        _aligned(spark, df, name).write.insertInto(name, overwrite=True)
        return
    spark.sql(
        f"CREATE TABLE {name} USING {table_format} "
        f"{_clauses(location, comment, properties)} AS SELECT * FROM {{df}}",
        df=df,
    )


def append(spark: SparkSession, df: DataFrame, name: str) -> None:
    """Add rows, matching columns by name."""
    _aligned(spark, df, name).write.insertInto(name, overwrite=False)


def unreadable(spark: SparkSession, names: Iterable[str]) -> list[tuple[str, str]]:
    """Tables whose first row cannot be read, with the error."""
    failures = []
    for name in names:
        try:
            spark.table(name).limit(1).collect()
        except Exception as error:  # the failure is the finding
            failures.append((name, str(error)))
    return failures


def _stored_text(field: T.StructField):
    column = F.col(f"`{field.name}`")
    if isinstance(field.dataType, (T.TimestampType, T.TimestampNTZType)):
        return timestamp_text(column, "T")
    return column.cast("string")


def result_rows(df: DataFrame, query: str) -> DataFrame:
    """A query result as storable rows ``(query, ordinal, columns, cells)``.

    Decimals and dates become text, NULL stays NULL. All rows are numbered in the order of
    the result, each partition on its own from where the ones before it end. The rows are
    written to the checkpoint folder first: numbers hold only while partitions stay.
    """
    ensure_checkpoint_dir(df.sparkSession)
    cells = F.array(*[_stored_text(f) for f in df.schema.fields])
    place = F.monotonically_increasing_id()
    rows = df.select(cells.alias("cells"), place.alias("place")).checkpoint().select(
        "cells", F.shiftright("place", 33).alias("part"),
        F.col("place").bitwiseAND((1 << 33) - 1).alias("number"),
    )
    # one number per partition comes to the driver, as many as the result has tasks
    counts = sorted((r.part, r["count"]) for r in rows.groupBy("part").count().collect())
    ends = accumulate(count for _, count in counts)
    starts = df.sparkSession.createDataFrame(
        [(part, end - count) for (part, count), end in zip(counts, ends)], "part BIGINT, start BIGINT"
    )
    numbered = rows.join(starts, "part").select((F.col("start") + F.col("number")).alias("ordinal"), "cells")
    return numbered.select(
        F.lit(query).alias("query"), "ordinal",
        F.array(*[F.lit(c) for c in df.columns]).alias("columns"), "cells",
    )


def store_result(df: DataFrame, query: str, location: str) -> None:
    """Store a query result below a location, replacing the last one of the query."""
    result_rows(df, query).drop("query").write.mode("overwrite").parquet(
        f"{location.rstrip('/')}/query={query}"
    )


def stored_results(spark: SparkSession, location: str) -> DataFrame:
    """All stored results below a location: ``(query, ordinal, columns, cells)``."""
    kind = "ordinal BIGINT, columns ARRAY<STRING>, cells ARRAY<STRING>, query STRING"
    return spark.read.schema(kind).parquet(location).select("query", "ordinal", "columns", "cells")
