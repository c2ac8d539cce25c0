"""Slowly changing dimension, type 2.

A change log has one row per change (batch, effective date, op ``U`` or ``D``, key,
attributes); the dimension keeps one row per version of a key, valid from
``valid_from`` until ``valid_to`` (exclusive, NULL while current). Dates come from the
data, never from the clock, so a result can be repeated.

``apply_changes`` folds one batch into a dimension; ``from_log`` builds the whole
dimension from the whole log. Both follow the same rules: an unchanged repeat makes no
version; a delete only closes; deleting an unknown key does nothing; a key that comes back
leaves a gap. NULL attributes, and NULL keys, compare equal to each other.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from varve.functions.encoding import record_hash
from varve.operators import ordered

VALIDITY = "valid_from DATE, valid_to DATE, is_current BOOLEAN, record_hash STRING"


@dataclass(frozen=True)
class Spec:
    """Which columns of a change log mean what."""

    keys: tuple[str, ...] = ("customer_id",)
    tracked: tuple[str, ...] = ("name", "segment", "city")
    effective: str = "effective_date"
    op: str = "op"
    batch: str = "batch_id"
    # Order of changes to one key; the last column must make it unique.
    sequence: tuple[str, ...] = ("effective_date", "batch_id")
    # Compare stored hashes, as a hash-based MERGE would, instead of the columns.
    compare_hashes: bool = False
    # A batch may hold several changes of a key, told apart by the sequence, which starts with
    # the effective date.
    many_per_batch: bool = False

    @property
    def columns(self) -> list[str]:
        return [*self.keys, *self.tracked, "valid_from", "valid_to", "is_current", "record_hash"]

    def same(self, left: str, right: str) -> Column:
        """Equal tracked attributes; NULL equals NULL."""
        if self.compare_hashes:
            return F.col(f"{left}.record_hash") == F.col(f"{right}.record_hash")
        result = F.lit(True)
        for c in self.tracked:
            result = result & F.col(f"{left}.{c}").eqNullSafe(F.col(f"{right}.{c}"))
        return result


    def same_key(self, left: str, right: str) -> list[Column]:
        """Equal business keys; a NULL key is a key like any other."""
        return [F.col(f"{left}.{k}").eqNullSafe(F.col(f"{right}.{k}")) for k in self.keys]


CUSTOMER = Spec()


def empty(spark: SparkSession, changes: DataFrame, spec: Spec = CUSTOMER) -> DataFrame:
    """A dimension without rows, with the key and attribute types of a change log."""
    attributes = ", ".join(
        f"`{c}` {changes.schema[c].dataType.simpleString()}" for c in (*spec.keys, *spec.tracked)
    )
    return spark.createDataFrame([], f"{attributes}, {VALIDITY}")


def _one_change_per_key(changes: DataFrame, spec: Spec) -> DataFrame:
    """The batch with each key once; two changes for one key fail the job.

    Grouping combines before its exchange, so a key repeated many times is caught without
    gathering its rows.
    """
    payload = [*spec.tracked, spec.effective, spec.op]
    once = changes.groupBy(*spec.keys).agg(
        F.count(F.lit(1)).alias("__n"), F.first(F.struct(*payload)).alias("__change")
    )
    checked = F.when(
        F.col("__n") > 1, F.raise_error(F.lit("a batch holds two changes for one key"))
    ).otherwise(F.col("__change"))
    return once.select(*spec.keys, checked.alias("__change")).select(
        *spec.keys, *[F.col(f"__change.{c}").alias(c) for c in payload],
        F.lit(None).cast("date").alias("valid_to"),
    ).withColumn("record_hash", record_hash(spec.tracked))


def apply_changes(dimension: DataFrame, changes: DataFrame, spec: Spec = CUSTOMER) -> DataFrame:
    """The dimension after one batch of changes.

    Closed versions pass through without a join. Current versions meet the batch in joins
    keyed on the business key whose other side is at most as large as the batch, so a small
    batch is broadcast and the dimension is not shuffled; a large one is hash-joined.
    A change dated before the current version it would close fails the job.
    """
    if spec.many_per_batch:
        return _apply_runs(dimension, changes, spec)
    batch = _one_change_per_key(changes, spec)
    current = dimension.where("is_current")
    touched = (
        current.alias("c")
        .join(batch.alias("b"), spec.same_key("c", "b"))
        .select(
            *[F.col(f"b.{k}").alias(k) for k in spec.keys],
            spec.same("c", "b").alias("__same"),
            F.col(f"b.{spec.op}").alias("__op"),
            F.when(
                F.col(f"b.{spec.effective}") < F.col("c.valid_from"),
                F.raise_error(F.lit("a change is dated before the version it replaces")),
            ).otherwise(F.col(f"b.{spec.effective}")).alias("__until"),
        )
    )
    closing = touched.where((F.col("__op") == "D") | ~F.col("__same")).select(
        *spec.keys, "__until"
    )
    kept = current.alias("c").join(closing.alias("x"), spec.same_key("c", "x"), "left").select(
        *[F.col(f"c.{name}") for name in (*spec.keys, *spec.tracked, "valid_from")],
        F.col("__until").alias("valid_to"),
        F.col("__until").isNull().alias("is_current"),
        "record_hash",
    )
    unchanged = touched.where("__same").select(*spec.keys)
    upserts = batch.where(F.col(spec.op) == "U").alias("b")
    opened = upserts.join(unchanged.alias("u"), spec.same_key("b", "u"), "left_anti").select(
        *spec.keys, *spec.tracked,
        F.col(spec.effective).alias("valid_from"), "valid_to",
        F.lit(True).alias("is_current"), "record_hash",
    )
    closed = dimension.where(~F.col("is_current")).select(*spec.columns)
    return closed.unionByName(kept).unionByName(opened)


def _apply_runs(dimension: DataFrame, changes: DataFrame, spec: Spec) -> DataFrame:
    """One batch with several changes per key: the current version of a key that it touches
    becomes the first row of the key's run of changes, and the runs are built as a log."""
    if spec.sequence[0] != spec.effective or spec.compare_hashes:
        raise ValueError("runs of changes compare columns, and their sequence starts with the effective date")
    current = dimension.where("is_current")
    first = changes.groupBy(*spec.keys).agg(
        F.min(spec.effective).alias("__since"), F.lit(True).alias("__touched")
    )
    met = current.alias("c").join(first.alias("f"), spec.same_key("c", "f"), "left")
    kept = met.where("__touched IS NULL").select(*[F.col(f"c.{c}").alias(c) for c in spec.columns])
    begun = F.when(
        F.col("__since") < F.col("valid_from"),
        F.raise_error(F.lit("a change is dated before the version it replaces")),
    ).otherwise(F.col("valid_from"))
    # NULLs sort first, so the version stands before changes of its own day
    later = [c for c in spec.sequence if c != spec.effective]
    opening = met.where("__touched").select(
        *[F.col(f"c.{c}").alias(c) for c in (*spec.keys, *spec.tracked)],
        begun.alias(spec.effective), F.lit("U").alias(spec.op),
        *[F.lit(None).cast(changes.schema[c].dataType).alias(c) for c in later],
    )
    # the opening rows, one for each key, make no key long: the splits come from the batch alone
    runs = from_log(opening.unionByName(changes.select(*opening.columns)), spec, changes)
    closed = dimension.where(~F.col("is_current")).select(*spec.columns)
    return closed.unionByName(kept).unionByName(runs.select(*spec.columns))


def from_log(log: DataFrame, spec: Spec = CUSTOMER, drawn: DataFrame | None = None) -> DataFrame:
    """The dimension after every batch of the log, in one pass over it.

    A row opens a version when its state differs from the state before it, and the next
    such row closes that version. Keys with many rows are cut into chunks along the sequence, about as many as
    partitions in all, and at most two rows of each link it to the next, so one very active key is spread over many
    tasks. A log without such keys is shuffled and sorted once. ``drawn`` is what the chunks are judged by, the log
    itself unless a cheaper part of it tells its long keys.
    """
    order = list(spec.sequence)
    state = F.when(F.col(spec.op) == "U", F.struct(*spec.tracked))
    # NULL attributes must not look like "deleted": a struct is non-NULL whatever it holds
    rows = log.select(
        *spec.keys, *dict.fromkeys([*order, spec.effective]), state.alias("__state")
    )
    keys = list(spec.keys)
    points = ordered.split_points(rows if drawn is None else drawn, keys, order)
    chunks = ordered.split_chunks(rows, keys, order, points=points) if points else rows
    before = ordered.previous(chunks, keys, order, "__state", "__prev")
    changed = before.where(~F.col("__state").eqNullSafe(F.col("__prev.value"))).drop("__prev")
    until = ordered.following(changed, keys, order, spec.effective, "__next")
    return until.where(F.col("__state").isNotNull()).select(
        *spec.keys,
        *[F.col(f"__state.{c}").alias(c) for c in spec.tracked],
        F.col(spec.effective).alias("valid_from"),
        F.col("__next.value").alias("valid_to"),
        F.col("__next").isNull().alias("is_current"),
    ).withColumn("record_hash", record_hash(spec.tracked))


def snapshot(dimension: DataFrame, spec: Spec = CUSTOMER) -> DataFrame:
    """The dimension as plain text dates, in key and validity order."""
    return dimension.select(
        *spec.keys, *spec.tracked,
        F.col("valid_from").cast("string").alias("valid_from"),
        F.col("valid_to").cast("string").alias("valid_to"),
        "is_current",
    ).orderBy(*spec.keys, "valid_from")


def as_of(dimension: DataFrame, date: str | Column) -> DataFrame:
    """Versions valid on a date."""
    day = F.lit(date).cast("date") if isinstance(date, str) else date
    return dimension.where(
        (F.col("valid_from") <= day) & (F.col("valid_to").isNull() | (F.col("valid_to") > day))
    )


def as_of_join(
    facts: DataFrame, dimension: DataFrame, key: Column, day: Column, spec: Spec = CUSTOMER,
    bucket_days: int = 64,
) -> DataFrame:
    """Every fact with the version of its key that was valid on its day, or NULLs without one.

    Adds a column ``version``, a struct of the dimension's columns. Versions are valid over
    day ranges; a version is posted under each bucket of ``bucket_days`` that it reaches into
    between its first day and the last day any fact has, so the join is an equality on (key, bucket) and
    the day test runs on the few versions of one bucket. A hot key falls into as many
    groups as it has buckets, and adaptive execution splits those further.

    A fact with a NULL day has no version; a NULL key is a key like any other. ``spec`` names one business key.
    """
    (name,) = spec.keys
    asked = facts.select("*", key.alias("__key"), day.cast("date").alias("__day"))
    bounds = asked.agg(F.min("__day").alias("low"), F.max("__day").alias("high")).first()
    if bounds.low is None:
        return asked.select(*facts.columns, F.lit(None).cast(dimension.select(F.struct(*dimension.columns)).schema[0].dataType).alias("version"))
    bucket = lambda c: F.floor(F.unix_date(c) / bucket_days).cast("int")
    first = F.greatest(F.col("valid_from"), F.lit(bounds.low))
    last = F.least(F.coalesce(F.date_sub("valid_to", 1), F.lit(bounds.high)), F.lit(bounds.high))
    posted = dimension.where((first <= last) & ((F.col("valid_to") > F.col("valid_from")) | F.col("valid_to").isNull())).select(
        F.struct(*dimension.columns).alias("version"), F.explode(F.sequence(bucket(first), bucket(last))).alias("__in")
    )
    held = (
        F.col("version.valid_from") <= F.col("__day")
    ) & (F.col("version.valid_to").isNull() | (F.col("version.valid_to") > F.col("__day")))
    met = asked.withColumn("__at", bucket(F.col("__day"))).join(
        posted, F.col("__key").eqNullSafe(F.col(f"version.{name}")) & (F.col("__at") == F.col("__in")) & held, "left"
    )
    return met.select(*facts.columns, "version")


def log_contains(log: DataFrame, batch_ids: DataFrame, spec: Spec = CUSTOMER) -> DataFrame:
    """For each asked batch id, whether the log already holds it."""
    known = log.select(F.col(spec.batch).alias("__known")).distinct()
    return batch_ids.join(known, F.col(spec.batch) == F.col("__known"), "left").select(
        spec.batch, F.col("__known").isNotNull().alias("loaded")
    )


def fold(
    dimension: DataFrame, log: DataFrame, batch_ids: Iterable[int], spec: Spec = CUSTOMER
) -> DataFrame:
    """Apply several batches of a log in the given order.

    Each step reads the dimension more than once, so it is written to the checkpoint folder
    in between; otherwise the plan would grow as a power of the number of batches.
    """
    from varve.session import ensure_checkpoint_dir

    ensure_checkpoint_dir(log.sparkSession)
    for batch_id in batch_ids:
        changes = log.where(F.col(spec.batch) == batch_id)
        dimension = apply_changes(dimension, changes, spec).checkpoint()
    return dimension
