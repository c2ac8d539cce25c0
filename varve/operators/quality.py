"""Row counts, keys, relations, schemas, profiles and content fingerprints.

Every check is a DataFrame with one row per table, relation or column, so checks run in
parallel, can be stored, and never bring table rows to the driver. Checks are unioned; each
scans only the columns it needs.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from varve import schema
from varve.functions.encoding import any_null, content_columns, md5_number, row_hash, row_text

PASS, FAIL, SKIP = "PASS", "FAIL", "SKIP"


def _stack(frames: Iterable[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def _named(df: DataFrame, name: str) -> DataFrame:
    return df.select(F.lit(name).alias("table_name"), "*")


# --- fingerprints -----------------------------------------------------------------------


def fingerprint(df: DataFrame) -> DataFrame:
    """Content fingerprint that does not depend on row order: ``(rows, hash_sum, columns)``.

    Adds a 64-bit hash of every row as DECIMAL(38,0). The hash skips NULLs and depends on
    column types, so compare it between like schemas; ``fingerprint_md5`` has neither limit.
    """
    return _fingerprint(df, _xx_number(df))


def fingerprint_md5(df: DataFrame) -> DataFrame:
    """Like ``fingerprint``, from md5 numbers that any SQL engine can compute."""
    return _fingerprint(df, _md5_number(df))


def _xx_number(df: DataFrame) -> Column:
    return row_hash(df).cast("decimal(38,0)")


def _md5_number(df: DataFrame) -> Column:
    return md5_number(row_text(df))


def _fingerprint(df: DataFrame, number: Column) -> DataFrame:
    columns = F.array(*[F.lit(c) for c in content_columns(df)])
    return df.agg(
        F.count(F.lit(1)).alias("rows"), _hash_sum(number)
    ).select("rows", "hash_sum", columns.alias("columns"))


def _hash_sum(number: Column) -> Column:
    return F.sum(number).cast("decimal(38,0)").alias("hash_sum")


def fingerprints(tables: dict[str, DataFrame], method=fingerprint) -> DataFrame:
    """One fingerprint row per table."""
    return _stack(_named(method(df), name) for name, df in tables.items())


def fingerprint_diff(left: DataFrame, right: DataFrame) -> DataFrame:
    """Compare two runs' fingerprints by table; a table missing in one of them differs."""
    a, b = left.alias("a"), right.alias("b")
    equal = (
        F.col("a.hash_sum").eqNullSafe(F.col("b.hash_sum"))
        & (F.col("a.rows") == F.col("b.rows"))
        & (F.col("a.columns") == F.col("b.columns"))
    )
    return a.join(b, F.col("a.table_name") == F.col("b.table_name"), "full").select(
        F.coalesce(F.col("a.table_name"), F.col("b.table_name")).alias("table_name"),
        F.col("a.rows").alias("left_rows"), F.col("b.rows").alias("right_rows"),
        F.coalesce(equal, F.lit(False)).alias("equal"),
    )


# --- keys and relations -----------------------------------------------------------------


def key_report(df: DataFrame, keys: Iterable[str]) -> DataFrame:
    """``(rows, distinct_pk, null_pk, duplicate_keys, pk_unique, pk_not_null)``.

    Rows are counted per key first, with a partial count before the exchange, so a key
    that repeats without end is one row per task. ``distinct_pk`` leaves out keys with a
    NULL part; ``pk_unique`` compares it with the row count, so a NULL key alone makes it
    false, while ``duplicate_keys`` counts only complete keys that occur more than once.
    """
    keys = list(keys)
    per_key = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    incomplete = any_null(keys)
    return per_key.agg(
        F.coalesce(F.sum("__n"), F.lit(0)).alias("rows"),
        F.count_if(~incomplete).alias("distinct_pk"),
        F.coalesce(F.sum(F.when(incomplete, F.col("__n"))), F.lit(0)).alias("null_pk"),
        F.count_if(~incomplete & (F.col("__n") > 1)).alias("duplicate_keys"),
    ).select(
        "*",
        (F.col("distinct_pk") == F.col("rows")).alias("pk_unique"),
        (F.col("null_pk") == 0).alias("pk_not_null"),
    )


def key_reports(tables: dict[str, DataFrame]) -> DataFrame:
    return _stack(
        _named(key_report(df, schema.PRIMARY_KEYS[name]), name) for name, df in tables.items()
    )


def orphan_report(
    child: DataFrame, child_column: str, parent: DataFrame, parent_column: str
) -> DataFrame:
    """``(orphans, null_children)``: child rows without a parent, NULLs among them apart.

    A NULL never equals a key, so NULL children are orphans too. Child rows are counted per
    key before they meet the parents; the join sees each key once.
    """
    children = child.groupBy(F.col(child_column).alias("__key")).agg(
        F.count(F.lit(1)).alias("__n")
    )
    parents = parent.select(F.col(parent_column).alias("__parent")).distinct()
    lost = children.join(parents, F.col("__key") == F.col("__parent"), "left_anti")
    return lost.agg(
        F.coalesce(F.sum("__n"), F.lit(0)).alias("orphans"),
        F.coalesce(F.sum(F.when(F.col("__key").isNull(), F.col("__n"))), F.lit(0)).alias(
            "null_children"
        ),
    )


def orphan_reports(
    tables: dict[str, DataFrame],
    relations: Iterable[schema.ForeignKey] = schema.FOREIGN_KEYS,
) -> DataFrame:
    return _stack(
        orphan_report(tables[r.child], r.child_column, tables[r.parent], r.parent_column).select(
            F.lit(f"{r.child}.{r.child_column}").alias("child"),
            F.lit(f"{r.parent}.{r.parent_column}").alias("parent"),
            "orphans", "null_children",
        )
        for r in relations
        if r.child in tables and r.parent in tables
    )


# --- schemas ----------------------------------------------------------------------------

def schema_matches(df: DataFrame, table: str) -> bool:
    """Same columns in the same order with the declared types."""
    def shape(struct: T.StructType) -> list[tuple[str, T.DataType]]:
        return [(f.name, f.dataType) for f in struct.fields]

    return shape(df.schema) == shape(schema.struct(table))


def schema_report(df: DataFrame, table: str) -> DataFrame:
    """One row per declared column: its type, the actual one, and the values that miss it.

    ``uncastable`` counts values the declared type cannot hold, so it also tells whether a
    conversion would lose rows. Absent columns have no actual type. One scan per table, of
    the columns whose type differs.
    """
    present = {f.name: f.dataType for f in df.schema.fields}
    declared = schema.struct(table).fields

    def uncastable(f: T.StructField) -> Column:
        if f.name not in present:
            return F.max(F.lit(None).cast("bigint"))
        if present[f.name] == f.dataType:
            return F.coalesce(F.max(F.lit(0).cast("bigint")), F.lit(0))
        value = F.col(f.name)
        return F.count_if(value.isNotNull() & value.try_cast(f.dataType).isNull())

    totals = df.agg(*[uncastable(f).alias(f"__{i}") for i, f in enumerate(declared)])
    entries = []
    for i, f in enumerate(declared):
        want = f.dataType.simpleString()
        have = present[f.name].simpleString() if f.name in present else None
        entries.append(F.struct(
            F.lit(f.name).alias("column_name"), F.lit(want).alias("declared_type"),
            F.lit(have).cast("string").alias("actual_type"),
            F.lit(have == want).alias("matches"), F.col(f"__{i}").alias("uncastable"),
        ))
    return totals.select(F.inline(F.array(*entries)))


def schema_reports(tables: dict[str, DataFrame]) -> DataFrame:
    return _stack(_named(schema_report(df, name), name) for name, df in tables.items())


# --- counts and profiles ----------------------------------------------------------------


def count_report(
    counts: DataFrame, expected: dict[str, Column], bounds: dict[str, tuple[Column, Column]] | None = None
) -> DataFrame:
    """Compare ``(table_name, rows)`` with expectations. A table with a NULL expectation is held
    against its least and largest count in ``bounds``, or skipped without one."""
    within = F.lit(None).cast("boolean")
    for name, (low, high) in (bounds or {}).items():
        within = F.when(F.col("table_name") == name, F.col("rows").between(low, high)).otherwise(within)
    wanted = F.lit(None).cast("bigint")
    for name, value in expected.items():
        wanted = F.when(F.col("table_name") == name, value.cast("bigint")).otherwise(wanted)
    return counts.select("table_name", "rows", wanted.alias("expected_rows")).select(
        "*",
        F.when(F.col("expected_rows").isNull() & within.isNull(), SKIP)
        .when(F.coalesce(F.col("rows") == F.col("expected_rows"), within), PASS)
        .otherwise(FAIL).alias("status"),
    )


def expected_counts(scale_factor: float, names: Iterable[str]) -> dict[str, Column]:
    return {n: F.lit(schema.expected_rows(n, scale_factor)) for n in names}


def _profile_measure(field: T.StructField) -> tuple[str, Column]:
    column = F.col(field.name)
    if isinstance(field.dataType, T.StringType):
        return "length", F.length(column)
    if isinstance(field.dataType, T.DateType):
        return "day", F.unix_date(column)
    return "value", column


def _exact(measure: Column, kind: str, data_type: T.DataType) -> Column:
    """A measure in the narrowest type whose sum is exact and cannot overflow in practice:
    lengths and days as numbers, decimals as they are, keys as decimals without fraction."""
    if kind != "value" or isinstance(data_type, T.DecimalType):
        return measure
    whole = {T.LongType: "decimal(20,0)", T.IntegerType: "decimal(10,0)"}
    return measure.cast(whole.get(type(data_type), "decimal(38,2)"))


def _profile(df: DataFrame) -> tuple[list[Column], Column]:
    """The sums a profile needs, and the array of its rows over their result."""
    measures = [(f.name, *_profile_measure(f)) for f in df.schema.fields]
    sums = [
        F.sum(_exact(m, kind, f.dataType)).cast("decimal(38,2)").alias(f"__{i}")
        for i, (f, (_, kind, m)) in enumerate(zip(df.schema.fields, measures))
    ]
    entries = [
        F.struct(F.lit(name).alias("column_name"), F.lit(kind).alias("measure"),
                 F.col(f"__{i}").alias("total"))
        for i, (name, kind, _) in enumerate(measures)
    ]
    return sums, F.array(*entries)


def column_profile(df: DataFrame) -> DataFrame:
    """One row per column: ``(column_name, measure, rows, total)``.

    ``total`` adds up the values, the text lengths or the days since 1970-01-01, in one
    aggregate over the table.
    """
    sums, entries = _profile(df)
    totals = df.agg(F.count(F.lit(1)).alias("rows"), *sums)
    return totals.select("rows", F.inline(entries)).select(
        "column_name", "measure", "rows", "total"
    )


def table_facts(df: DataFrame, method=fingerprint) -> DataFrame:
    """Fingerprint and column profile from a single scan: ``(rows, hash_sum, profile)``."""
    number = _md5_number(df) if method is fingerprint_md5 else _xx_number(df)
    sums, entries = _profile(df)
    totals = df.agg(F.count(F.lit(1)).alias("rows"), _hash_sum(number), *sums)
    return totals.select("rows", "hash_sum", entries.alias("profile"))


# --- check list -------------------------------------------------------------------------


def check(frame: DataFrame, key: str, title: str, bad: Column, detail: Column) -> DataFrame:
    """Fold a report into one ``(key, title, status, detail)`` row.

    ``bad`` marks failing rows and may be NULL for "not known"; ``detail`` describes a
    failing row. Reports have one row per table or relation, so the list of details is
    short. A report with nothing known is SKIP.
    """
    return frame.agg(
        F.count_if(bad).alias("failed"), F.count(bad).alias("known"),
        F.sort_array(F.collect_list(F.when(bad, detail))).alias("details"),
    ).select(
        F.lit(key).alias("key"), F.lit(title).alias("title"),
        F.when(F.col("failed") > 0, FAIL).when(F.col("known") == 0, SKIP).otherwise(PASS)
        .alias("status"),
        F.when(F.col("failed") > 0, F.array_join("details", "; "))
        .otherwise(F.concat(F.col("known").cast("string"), F.lit(" checked"))).alias("detail"),
    )


def quality_checks(
    tables: dict[str, DataFrame], counts_expected: dict[str, Column],
    bounds: dict[str, tuple[Column, Column]] | None = None,
) -> DataFrame:
    """Row counts, keys, relations and schemas of a set of tables as a check list."""
    keys = key_reports(tables)
    # the key report has counted the rows
    counts = count_report(keys.select("table_name", "rows"), counts_expected, bounds)
    mismatch = F.when(F.col("status") != SKIP, F.col("status") == FAIL)
    table_rows = F.concat_ws(" ", "table_name", F.col("rows").cast("string"), F.lit("of"),
                             F.coalesce(F.col("expected_rows").cast("string"), F.lit("another number")))
    return _stack([
        check(counts, "row_counts", "Row counts", mismatch, table_rows),
        check(keys, "primary_keys", "Primary keys",
              ~(F.col("pk_unique") & F.col("pk_not_null")), F.col("table_name")),
        check(orphan_reports(tables), "foreign_keys", "Foreign keys", F.col("orphans") > 0,
              F.concat_ws(" ", "child", F.col("orphans").cast("string"))),
        check(schema_reports(tables), "schemas", "Schemas", ~F.col("matches"),
              F.concat_ws(".", "table_name", "column_name")),
    ])


def overall(checks: DataFrame) -> DataFrame:
    """One row: FAIL when any check failed, with the number of checks by status."""
    return checks.agg(
        F.when(F.count_if(F.col("status") == FAIL) > 0, FAIL).otherwise(PASS).alias("status"),
        *[F.count_if(F.col("status") == s).alias(s.lower()) for s in (PASS, FAIL, SKIP)],
    )


def check_rows(spark: SparkSession, rows: list[tuple[str, str, str, str]]) -> DataFrame:
    """Checks decided on the driver (a table that cannot be read, a missing run)."""
    return spark.createDataFrame(rows, "key STRING, title STRING, status STRING, detail STRING")
