"""Compare two tables as data, without collecting them.

``difference``         exact, order-insensitive: rows and how many copies each side lacks
``compare_by_key``     tolerant, for tables with unique keys
``compare_sorted``     tolerant, for tables without keys: both sides sorted and paired
``compare_results``    stored query results, query by query
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from varve.functions.encoding import content_columns
from varve.functions.tolerant import Tolerance, as_number, is_missing, stripped, values_equal
from varve.operators import ordered

_APPROXIMATE = (T.DecimalType, T.FloatType, T.DoubleType)


def schema_difference(left: DataFrame, right: DataFrame) -> list[str]:
    """Columns and types that one side lacks, as text; empty when the schemas agree."""
    a = {f.name: f.dataType.simpleString() for f in left.schema.fields}
    b = {f.name: f.dataType.simpleString() for f in right.schema.fields}
    return [
        f"{name}: {a.get(name, 'absent')} / {b.get(name, 'absent')}"
        for name in sorted(a.keys() | b.keys())
        if a.get(name) != b.get(name)
    ]


def _same_columns(left: DataFrame, right: DataFrame) -> list[str]:
    if sorted(left.columns) != sorted(right.columns):
        raise ValueError(f"columns differ: {schema_difference(left, right)}")
    return left.columns


def _both(left: DataFrame, right: DataFrame, columns: list[str]) -> DataFrame:
    """Both sides in one frame with ``__l`` and ``__r`` marking where a row came from."""
    one, none = F.lit(1).cast("bigint"), F.lit(0).cast("bigint")
    return left.select(*columns, one.alias("__l"), none.alias("__r")).unionByName(
        right.select(*columns, none.alias("__l"), one.alias("__r"))
    )


def difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows with unequal numbers of copies: the row, ``only_left`` and ``only_right``.

    Counting both sides in one aggregate needs one exchange, where subtracting each side
    from the other needs four, and equal copies of a row collapse before it.
    """
    columns = _same_columns(left, right)
    return (
        _both(left, right, columns)
        .groupBy(*columns)
        .agg((F.sum("__l") - F.sum("__r")).alias("__surplus"))
        .where(F.col("__surplus") != 0)
        .select(
            *columns,
            F.greatest(F.col("__surplus"), F.lit(0)).alias("only_left"),
            F.greatest(-F.col("__surplus"), F.lit(0)).alias("only_right"),
        )
    )


def summary(left: DataFrame, right: DataFrame) -> DataFrame:
    """One row: counts of both sides, copies only one side has, and whether they are equal."""
    columns = _same_columns(left, right)
    per_row = _both(left, right, columns).groupBy(*columns).agg(
        F.sum("__l").alias("l"), F.sum("__r").alias("r")
    )

    def total(column: Column) -> Column:
        return F.coalesce(F.sum(column), F.lit(0))

    return per_row.agg(
        total(F.col("l")).alias("left_rows"), total(F.col("r")).alias("right_rows"),
        total(F.greatest(F.col("l") - F.col("r"), F.lit(0))).alias("only_left"),
        total(F.greatest(F.col("r") - F.col("l"), F.lit(0))).alias("only_right"),
    ).select("*", ((F.col("only_left") == 0) & (F.col("only_right") == 0)).alias("equal"))


def compare_by_key(
    left: DataFrame, right: DataFrame, keys: Iterable[str], tolerance: Tolerance = Tolerance()
) -> DataFrame:
    """Keys whose rows differ: ``(keys…, status, columns)``.

    ``status`` is ``left only``, ``right only`` or ``differs``, with the names of the
    differing columns. Both sides meet in one aggregate by key (NULL keys meet too), so no
    join can multiply rows. A key that occurs twice on one side fails the job: use
    ``compare_sorted`` there.
    """
    keys = list(keys)
    columns = _same_columns(left, right)
    values = [c for c in columns if c not in keys]
    row = F.struct(F.lit(1).alias("__row"), *[F.col(c) for c in values])
    met = _both(left, right, columns).groupBy(*keys).agg(
        F.sum("__l").alias("__ln"), F.sum("__r").alias("__rn"),
        F.first(F.when(F.col("__l") == 1, row), ignorenulls=True).alias("a"),
        F.first(F.when(F.col("__r") == 1, row), ignorenulls=True).alias("b"),
    )
    unequal = F.filter(
        F.array(*[
            F.when(~values_equal(F.col(f"a.{c}"), F.col(f"b.{c}"), left.schema[c].dataType,
                                 tolerance), c)
            for c in values
        ] or [F.lit(None).cast("string")]),
        lambda name: name.isNotNull(),
    )
    status = (
        F.when((F.col("__ln") > 1) | (F.col("__rn") > 1),
               F.raise_error(F.lit("compare_by_key: a key is not unique")))
        .when(F.col("__rn") == 0, "left only")
        .when(F.col("__ln") == 0, "right only")
        .when(F.size("__unequal") > 0, "differs")
    )
    return (
        met.select("*", unequal.alias("__unequal"))
        .select(
            *keys, status.alias("status"),
            F.when((F.col("__ln") > 0) & (F.col("__rn") > 0), F.array_join("__unequal", ","))
            .otherwise("").alias("columns"),
        )
        .where(F.col("status").isNotNull())
    )


# positions handled by one task when runs of equal rows are lined up
BLOCK = 1_000_000


def compare_sorted(
    left: DataFrame, right: DataFrame, tolerance: Tolerance = Tolerance(),
    chunk: Column | None = None, block: int = BLOCK,
) -> DataFrame:
    """Pairs that differ when both sides are sorted alike: order-insensitive and tolerant.

    Columns other than decimals and floats must match exactly and form the groups; inside a
    group the n-th row of the left side, by the approximate columns, is paired with the
    n-th of the right side. Returns one row per differing pair of values with the number of
    ``copies``; a side that runs out of rows shows NULL.

    Equal rows collapse into runs first. Positions come from running totals over chunks
    (see ``varve.operators.ordered``) and runs are lined up in blocks of positions, so
    neither one huge group nor one row repeated without end ends up in a single task.
    """
    columns = _same_columns(left, right)
    approx = [c for c in columns if isinstance(left.schema[c].dataType, _APPROXIMATE)]
    exact = [c for c in columns if c not in approx]
    runs = _both(left, right, columns).groupBy(*columns).agg(
        F.sum("__l").alias("__l"), F.sum("__r").alias("__r")
    )
    order = approx or ["__l"]
    chunks = (
        ordered.range_chunks(runs, exact, order) if chunk is None
        else ordered.chunked(runs, chunk)
    )
    placed = ordered.running_before(chunks, exact, order, {"__l0": "__l", "__r0": "__r"})

    # one row per run and side: (side, first position, position after the last)
    sides = F.filter(
        F.array(*[
            F.when(F.col(n) > 0, F.struct(F.lit(side).alias("__side"), F.col(start).alias("__from"),
                                          (F.col(start) + F.col(n)).alias("__to")))
            for side, n, start in (("l", "__l", "__l0"), ("r", "__r", "__r0"))
        ]),
        lambda entry: entry.isNotNull(),
    )
    vector = F.struct(F.lit(1).alias("__row"), *[F.col(c) for c in approx]).alias("__v")
    # cut at block borders
    pieces = (
        placed.select(*exact, vector, F.inline(sides))
        .select("*", F.explode(F.sequence(
            F.floor(F.col("__from") / block), F.floor((F.col("__to") - 1) / block)
        )).alias("__block"))
        .select(
            *exact, "__block", "__side", "__v",
            F.greatest(F.col("__from"), F.col("__block") * block).alias("__from"),
            F.least(F.col("__to"), (F.col("__block") + 1) * block).alias("__to"),
        )
    )
    # starts of runs, and ends, where a side may have no further run
    events = pieces.select(
        *exact, "__block", "__side",
        F.inline(F.array(
            F.struct(F.col("__from").alias("__at"), F.lit(1).alias("__opens"),
                     F.col("__v").alias("__v")),
            F.struct(F.col("__to").alias("__at"), F.lit(0).alias("__opens"),
                     F.lit(None).cast(pieces.schema["__v"].dataType).alias("__v")),
        )),
    )
    spot = Window.partitionBy(*exact, "__block").orderBy("__at", "__opens")
    so_far = spot.rowsBetween(Window.unboundedPreceding, 0)

    def standing(side: str) -> Column:
        """The side's run that covers the positions after this event."""
        mark = F.when(F.col("__side") == side, F.struct(F.col("__v").alias("run")))
        return F.last(mark, ignorenulls=True).over(so_far)["run"]

    spans = events.select(
        *exact, standing("l").alias("a"), standing("r").alias("b"),
        (F.lead("__at").over(spot) - F.col("__at")).alias("copies"),
    ).where((F.col("copies") > 0) & (F.col("a").isNotNull() | F.col("b").isNotNull()))
    paired = F.col("a").isNotNull() & F.col("b").isNotNull()
    equal = paired
    for c in approx:
        equal = equal & values_equal(
            F.col(f"a.{c}"), F.col(f"b.{c}"), left.schema[c].dataType, tolerance
        )
    return (
        spans.where(~equal)
        .groupBy(
            *exact,
            *[F.col(f"a.{c}").alias(f"left_{c}") for c in approx],
            *[F.col(f"b.{c}").alias(f"right_{c}") for c in approx],
            F.when(F.col("a").isNull(), "right only").when(F.col("b").isNull(), "left only")
            .otherwise("differs").alias("status"),
        )
        .agg(F.sum("copies").alias("copies"))
    )


# --- stored query results ---------------------------------------------------------------


# Reasons of a comparison, as readers of stored verdicts know them.
EQUAL = "equal"
EQUAL_BLANK = "equal (single NULL row)"
EQUAL_TIES = "equal (ignoring order of tied rows)"
ROWS_DIFFER = "row count %d != %d"
COLUMNS_DIFFER = "column count %d != %d"
FIRST_DIFFERENCE = "first difference at row %d"


def _sort_key(cells: Column) -> Column:
    """Numbers to one decimal, then texts: the order in which tied rows are compared."""

    def part(cell: Column) -> Column:
        number = as_number(stripped(cell))
        return F.when(number.isNotNull(), F.struct(
            F.lit(0).alias("kind"), F.format_string("%.1f", number).alias("n"),
            F.lit("").alias("t"))
        ).otherwise(F.struct(
            F.lit(1).alias("kind"), F.lit("").alias("n"),
            F.coalesce(stripped(cell), F.lit("None")).alias("t")))

    return F.transform(cells, part)


def compare_results(
    actual: DataFrame, expected: DataFrame, tolerance: Tolerance = Tolerance(lenient_text=True)
) -> DataFrame:
    """Verdict per query over stored results ``(query, ordinal, cells)``.

    Returns ``(query, equal, reason)`` for every query of either side. An empty result
    equals a single row of NULLs; then row counts, column counts, rows in order, and rows
    in sorted order decide. Rows are numbered chunk by chunk, so a large result is spread
    over many tasks.
    """
    every = actual.select("query").unionByName(expected.select("query")).distinct()

    def side(frame: DataFrame, prefix: str) -> tuple[dict[str, DataFrame], DataFrame]:
        rows = frame.select(
            "query", "ordinal", "cells", _sort_key(F.col("cells")).alias("__key"),
            F.lit(1).alias("__one"),
        )

        def numbered(order: list[str], name: str) -> DataFrame:
            cut = ordered.range_chunks(rows, ["query"], order)
            return ordered.running_before(cut, ["query"], order, {"__before": "__one"}).select(
                "query", "cells", (F.col("__before") + 1).alias(name)
            )

        places = {"place": numbered(["ordinal"], "place"), "rank": numbered(["__key", "ordinal"], "rank")}
        facts = frame.groupBy("query").agg(
            F.count(F.lit(1)).alias(f"{prefix}_rows"),
            F.max(F.size("cells")).alias(f"{prefix}_columns"),
            F.every(F.forall("cells", is_missing)).alias(f"{prefix}_blank"),
        )
        return places, facts

    a, a_facts = side(actual, "a")
    b, b_facts = side(expected, "b")

    def mismatches(position: str) -> DataFrame:
        left = a[position].select("query", F.col(position).alias("at"), F.col("cells").alias("x"))
        right = b[position].select("query", F.col(position).alias("at"), F.col("cells").alias("y"))
        same = F.forall(
            F.arrays_zip("x", "y"),
            lambda p: values_equal(p["x"], p["y"], T.StringType(), tolerance),
        )
        return left.join(right, ["query", "at"]).groupBy("query").agg(
            F.count_if(~same).alias(f"__bad_{position}"),
            F.min(F.when(~same, F.col("at"))).alias(f"__first_{position}"),
        )

    facts = (
        every.join(a_facts, "query", "left").join(b_facts, "query", "left")
        .join(mismatches("place"), "query", "left").join(mismatches("rank"), "query", "left")
    )
    rows_a, rows_b = (F.coalesce(F.col(f"{s}_rows"), F.lit(0)) for s in "ab")
    blank = ((rows_a == 0) & (rows_b == 1) & F.coalesce("b_blank", F.lit(False))) | (
        (rows_b == 0) & (rows_a == 1) & F.coalesce("a_blank", F.lit(False))
    )
    reason = (
        F.when(blank, EQUAL_BLANK)
        .when(rows_a != rows_b, F.format_string(ROWS_DIFFER, rows_a, rows_b))
        .when(F.col("a_columns") != F.col("b_columns"),
              F.format_string(COLUMNS_DIFFER, "a_columns", "b_columns"))
        .when(F.coalesce("__bad_place", F.lit(0)) == 0, EQUAL)
        .when(F.col("__bad_rank") == 0, EQUAL_TIES)
        .otherwise(F.format_string(FIRST_DIFFERENCE, F.col("__first_place") - 1))
    )
    return facts.select("query", reason.alias("reason")).select(
        "query", F.col("reason").startswith(EQUAL).alias("equal"), "reason"
    )


def content(df: DataFrame) -> DataFrame:
    """The columns that count for equivalence: sorted, without operational metadata."""
    return df.select(*content_columns(df))
