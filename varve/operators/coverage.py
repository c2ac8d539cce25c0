"""Roll-ups and rule checks over curated tables (capability lists, inventories)."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Assessment statuses, and which of them count as covered.
STATUSES = ("NATIVE", "ALTERNATIVE", "WORKAROUND", "MISSING", "NOT_ASSESSED")
COVERED = ("NATIVE", "ALTERNATIVE", "WORKAROUND")
NATIVE, NOT_ASSESSED = "NATIVE", "NOT_ASSESSED"


def coverage_rollup(df: DataFrame, group: str, status: Column, required: Column) -> DataFrame:
    """Per group: rows by status, and the covered, native and required shares.

    Rows not assessed are counted but left out of every share; a group without assessed
    rows has NULL shares. One aggregate, combined before its exchange.
    """
    assessed = status != NOT_ASSESSED
    covered = status.isin(*COVERED)
    counts = df.groupBy(group).agg(
        *[F.count_if(status == s).alias(s.lower()) for s in STATUSES],
        F.count_if(assessed).alias("total"),
        F.count_if(covered).alias("covered"),
        F.count_if(required & covered).alias("required_covered"),
        F.count_if(required & assessed).alias("required_total"),
    )

    def share(column: str) -> Column:
        ratio = F.col(column).cast("double") / F.nullif(F.col("total"), F.lit(0)).cast("double")
        return F.round(ratio, 4)

    return counts.select(
        "*", share("covered").alias("outcome_coverage"), share("native").alias("native_parity")
    )


def rule_violations(
    df: DataFrame,
    *,
    required: Iterable[str] = (),
    allowed: Mapping[str, Iterable[str]] | None = None,
    unique: Iterable[Iterable[str]] = (),
) -> DataFrame:
    """``(rule, column_name, value, rows)`` for every broken rule.

    ``required`` columns hold no NULL; ``allowed`` columns hold listed values only (NULL is
    a matter for ``required``); each ``unique`` list of columns identifies a row, and its
    violations count the surplus rows. All value rules are checked in one pass.
    """
    rules = [
        (F.lit("required"), c, F.col(c).isNull(), F.lit(None).cast("string")) for c in required
    ] + [
        (F.lit("allowed"), c, ~F.col(c).cast("string").isin(*values), F.col(c).cast("string"))
        for c, values in (allowed or {}).items()
    ]
    reports = []
    if rules:
        broken = F.filter(
            F.array(*[
                F.when(bad, F.struct(rule.alias("rule"), F.lit(c).alias("column_name"),
                                     value.alias("value")))
                for rule, c, bad, value in rules
            ]),
            lambda entry: entry.isNotNull(),
        )
        reports.append(
            df.select(F.inline(broken))
            .groupBy("rule", "column_name", "value")
            .agg(F.count(F.lit(1)).alias("rows"))
        )
    for columns in unique:
        keys = list(columns)
        reports.append(
            df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
            .where(F.col("__n") > 1)
            .groupBy(F.lit("unique").alias("rule"), F.lit(",".join(keys)).alias("column_name"),
                     F.lit(None).cast("string").alias("value"))
            .agg(F.sum(F.col("__n") - 1).alias("rows"))
        )
    return reduce(DataFrame.unionByName, reports)
