"""Join shapes that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def distinct_keys(df: DataFrame, **renamed: str) -> DataFrame:
    """Unique values of some columns, for the right side of a semi or anti join.

    Only membership matters there, and AQE cannot split that side when a key is hot.
    ``distinct`` combines before its exchange, so a hot key is one row per task.
    """
    return df.select(*[F.col(source).alias(name) for name, source in renamed.items()]).distinct()


def exists_in(df: DataFrame, other: DataFrame, **keys: str) -> DataFrame:
    """Rows of ``df`` with a match: ``exists_in(orders, lines, o_orderkey="l_orderkey")``."""
    return _membership(df, other, keys, "left_semi")


def missing_from(df: DataFrame, other: DataFrame, **keys: str) -> DataFrame:
    """Rows of ``df`` without a match (NOT EXISTS): a NULL key never matches, so it stays."""
    return _membership(df, other, keys, "left_anti")


def _membership(df: DataFrame, other: DataFrame, keys: dict[str, str], how: str) -> DataFrame:
    members = distinct_keys(other, **{f"__{k}": v for k, v in keys.items()})
    condition = [df[k] == members[f"__{k}"] for k in keys]
    return df.join(members, condition, how)


def not_in(df: DataFrame, column: str, other: DataFrame, other_column: str) -> DataFrame:
    """SQL ``column NOT IN (SELECT other_column FROM other)`` with its NULL rules.

    An empty subquery keeps every row; a NULL in it empties the result; otherwise a NULL
    ``column`` is dropped. Spark plans the SQL form as a broadcast of the subquery whatever
    its size, so here an ordinary anti join does the matching and one scalar row the rules.
    """
    rules = other.agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col(other_column).isNull()).alias("nulls")
    )
    size: Column = rules.select("n").scalar()
    nulls: Column = rules.select("nulls").scalar()
    kept = missing_from(df, other.where(F.col(other_column).isNotNull()), **{column: other_column})
    return kept.where((nulls == 0) & (F.col(column).isNotNull() | (size == 0)))
