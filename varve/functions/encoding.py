"""Row hashes and encodings, as JVM-side column expressions."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def content_columns(df: DataFrame) -> list[str]:
    """Sorted column names without operational metadata (leading underscore)."""
    return sorted(c for c in df.columns if not c.startswith("_"))


def any_null(columns: Iterable[str | Column]) -> Column:
    """True when at least one of the columns is NULL."""
    tests = [(F.col(c) if isinstance(c, str) else c).isNull() for c in columns]
    result = tests[0]
    for test in tests[1:]:
        result = result | test
    return result


def record_hash(columns: Iterable[str]) -> Column:
    """``sha2(concat_ws('||', ...), 256)`` of the columns in the given order.

    Kept because stored dimensions carry it. ``concat_ws`` skips NULLs and does not escape
    the delimiter, so unlike rows can share a hash; comparisons here use the columns.
    """
    return F.sha2(F.concat_ws("||", *[F.col(c) for c in columns]), 256)


def row_hash(df: DataFrame) -> Column:
    """64-bit hash over the content columns in name order."""
    return F.xxhash64(*[F.col(c) for c in content_columns(df)])


def canonical_text(field: T.StructField) -> Column:
    """A value as text that other engines write the same way."""
    column = F.col(field.name)
    if isinstance(field.dataType, (T.FloatType, T.DoubleType)):
        raise TypeError(f"{field.name}: cast floats to DECIMAL first, engines print them differently")
    if isinstance(field.dataType, (T.TimestampType, T.TimestampNTZType)):
        return timestamp_text(column, " ")
    return column.cast("string")


def timestamp_text(column: Column, separator: str) -> Column:
    """Date, separator and time with six decimals.

    Built from the plain text of the value: formatting functions would first move a timestamp
    without time zone into the session's zone, where an hour may not exist.
    """
    text = column.cast("string")
    return F.concat(
        F.substring(text, 1, 10), F.lit(separator), F.substring(text, 12, 8), F.lit("."),
        F.rpad(F.substring(text, 21, 6), 6, "0"),
    )


def row_text(df: DataFrame) -> Column:
    """One text per row that no other row content produces.

    Every value is length-prefixed and NULL has its own mark, so neither a delimiter inside
    a value nor the position of a NULL can make two different rows equal.
    """
    pieces = []
    for name in content_columns(df):
        value = canonical_text(df.schema[name])
        pieces.append(
            F.coalesce(F.concat(F.lit("v"), F.length(value).cast("string"), F.lit(":"), value),
                       F.lit("n"))
        )
    return F.concat(*pieces)


def md5_number(text: Column) -> Column:
    """The first 60 bits of the md5 of a text, as a number any engine can add up."""
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("decimal(38,0)")
