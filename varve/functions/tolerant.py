"""Tolerant equality of values, as one JVM-side expression."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Tolerances of result comparison.
ABSOLUTE, RELATIVE = "0.01", "1e-9"

NUMERIC = (T.DecimalType, T.IntegralType, T.FloatType, T.DoubleType)


@dataclass(frozen=True)
class Tolerance:
    """How much two values may differ and still count as equal.

    ``lenient_text`` adds the rules for results stored as text: blanks around a text do not
    count, NULL, an empty text and the text NULL are equal, and texts that are numbers
    compare as numbers.
    """

    absolute: str = ABSOLUTE
    relative: str = RELATIVE
    lenient_text: bool = False


def _close(a: Column, b: Column, tolerance: Tolerance) -> Column:
    limit = F.greatest(
        F.lit(float(tolerance.absolute)), F.lit(float(tolerance.relative)) * F.abs(b)
    )
    # the slack absorbs the rounding of the subtraction itself
    slack = F.greatest(F.abs(a), F.abs(b)) * F.lit(4e-16)
    return F.abs(a - b) <= limit + slack


_NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def stripped(text: Column) -> Column:
    """A text without blanks and line breaks around it."""
    return F.btrim(text, F.lit(" \t\n\r\f\x0b"))


def as_number(text: Column) -> Column:
    """The number a text spells, else NULL (a bare parse would also accept ``1d``)."""
    return F.when(text.rlike(_NUMBER), text.try_cast("double"))


def is_missing(text: Column) -> Column:
    return text.isNull() | stripped(text).isin("", "NULL")


def values_equal(a: Column, b: Column, data_type: T.DataType, tolerance: Tolerance) -> Column:
    """TRUE or FALSE, never NULL. ``b`` is the expected value: it scales the tolerance."""
    if isinstance(data_type, NUMERIC):
        both_null = a.isNull() & b.isNull()
        return both_null | F.coalesce(
            _close(a.cast("double"), b.cast("double"), tolerance), F.lit(False)
        )
    if not isinstance(data_type, T.StringType) or not tolerance.lenient_text:
        return a.eqNullSafe(b)
    x, y = stripped(a), stripped(b)
    m, n = as_number(x), as_number(y)
    return (
        F.when(m.isNotNull() & n.isNotNull(), _close(m, n, tolerance))
        .when(a.isNull() | b.isNull(), is_missing(a) & is_missing(b))
        .otherwise(x == y)
    )
