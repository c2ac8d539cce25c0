"""Order-dependent calculations over groups too large for one task.

A window partitioned by a key sends all rows of that key to one task. Here each group is
cut into *chunks* that follow its order: windows run per (group, chunk), and a second window
over one or two rows per chunk links the chunks. A key that holds a third of the table is
then spread over many tasks.

``CHUNK`` must not decrease along the order inside a group. Use ``split_chunks``, a rule computed from
the row (a minute, an integer part) when the data offers one, or ``range_chunks``. NULL keys
form a group of their own, as in any window. A NULL chunk is that of a group left whole.
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from varve.session import ensure_checkpoint_dir

CHUNK = "__chunk"


def chunked(df: DataFrame, chunk: Column) -> DataFrame:
    """Add the chunk of every row by a rule."""
    return df.select("*", chunk.alias(CHUNK))


#: Rows that the driver sees for each chunk to be made.
SAMPLED = 32


def split_points(
    df: DataFrame, keys: list[str], order: list[str], partitions: int | None = None
) -> dict[tuple, list[tuple]]:
    """The places where keys with many rows are cut, as texts; empty if no key has that many.

    The places are every SAMPLED-th row of a sample with a bound. A key with less than a quarter as many
    sampled rows is left whole, also where such a place falls into it.
    """
    parts = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    total = df.count()
    share = min(1.0, SAMPLED * parts / max(1, total))
    drawn = df.select(*keys, *order).sample(share, seed=7).orderBy(*keys, *order).select(
        F.struct(*[F.col(k).cast("string") for k in keys]).alias("key"),
        F.struct(*[F.col(c).cast("string") for c in order]).alias("place"),
    )
    seen = drawn.limit(4 * SAMPLED * parts).collect()
    held = Counter(tuple(row.key) for row in seen)
    points: dict[tuple, list[tuple]] = {}
    for row in seen[SAMPLED - 1::SAMPLED]:
        if 4 * held[tuple(row.key)] >= SAMPLED:
            points.setdefault(tuple(row.key), []).append(tuple(row.place))
    return points


def split_chunks(
    df: DataFrame, keys: list[str], order: list[str], partitions: int | None = None,
    points: dict[tuple, list[tuple]] | None = None,
) -> DataFrame:
    """Chunks between split points of the (key, order) sequence, without a shuffle.

    The points become literals of the plan: each row looks up those of its key and counts the ones not after
    it. Keys without any are left whole, and their chunk is NULL.
    """
    if points is None:
        points = split_points(df, keys, order, partitions)
    # a chunk of each key is named by the texts of its columns, NULL apart from every text
    name = F.to_json(F.array(*[F.col(k).cast("string") for k in keys]))
    place = F.struct(*[F.col(c) for c in order])
    kinds = [df.schema[c].dataType for c in order]

    def literal(values: tuple) -> Column:
        return F.struct(*[F.lit(v).cast(kind).alias(c) for v, kind, c in zip(values, kinds, order)])

    chunk = F.lit(None)
    if points:
        text = F.create_map(*[x for key, places in points.items() for x in (
            F.to_json(F.array(*[F.lit(v).cast("string") for v in key])),
            F.array(*[literal(values) for values in dict.fromkeys(places)]),
        )])
        chunk = F.when(
            F.map_contains_key(text, name),
            F.size(F.filter(F.try_element_at(text, name), lambda split: split <= place)),
        )
    return df.select("*", chunk.cast("int").alias(CHUNK))


def range_chunks(
    df: DataFrame, keys: list[str], order: list[str], partitions: int | None = None
) -> DataFrame:
    """Chunks of about equal size whatever the distribution: the ranges of a sorted shuffle.

    The range bounds come from sampling, so the result is written to the shared checkpoint
    folder: every later use, also after a lost executor, must see the same chunk numbers.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    parts = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(parts, *keys, *order)
    return chunked(ranged, F.spark_partition_id()).checkpoint()


def running_before(
    df: DataFrame, keys: list[str], order: list[str],
    before: dict[str, str], whole: dict[str, str] | None = None,
) -> DataFrame:
    """Add sums over the earlier rows of the group, and over the whole group.

    ``before`` and ``whole`` map a new column to the counted column. Each chunk gets one
    extra row that stands before its first and holds what the chunks before it add up to;
    a running sum inside the chunk then starts from there, and no join is needed.
    """
    whole = whole or {}
    names = [*before, *whole]
    across = Window.partitionBy(*keys).orderBy(CHUNK)
    earlier = across.rowsBetween(Window.unboundedPreceding, -1)
    everything = across.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)

    totals = df.groupBy(*keys, CHUNK).agg(
        *[F.sum(c).cast("bigint").alias(f"__sum_{n}") for n, c in {**before, **whole}.items()]
    )
    starts = totals.select(
        *keys, CHUNK,
        *[F.coalesce(F.sum(f"__sum_{n}").over(earlier), F.lit(0)).alias(n) for n in before],
        *[F.sum(f"__sum_{n}").over(everything).alias(n) for n in whole],
        F.lit(0).alias("__real"),
    )
    rows = df.select(
        *df.columns, *[F.col(c).cast("bigint").alias(n) for n, c in before.items()],
        *[F.lit(None).cast("bigint").alias(n) for n in whole], F.lit(1).alias("__real"),
    )
    inside = Window.partitionBy(*keys, CHUNK).orderBy("__real", *order)
    so_far = inside.rowsBetween(Window.unboundedPreceding, -1)
    both = rows.unionByName(starts, allowMissingColumns=True)
    summed = both.select(
        *df.columns, "__real",
        *[F.sum(n).over(so_far).alias(n) for n in before],
        *[F.first(n).over(inside.rowsBetween(Window.unboundedPreceding, 0)).alias(n)
          for n in whole],
    )
    return summed.where(F.col("__real") == 1).select(*df.columns, *names)


def previous(df: DataFrame, keys: list[str], order: list[str], value: str, name: str) -> DataFrame:
    """Add the value of the row before, wrapped in a struct: NULL means "no such row"."""
    return _neighbour(df, keys, order, value, name, forward=False)


def following(df: DataFrame, keys: list[str], order: list[str], value: str, name: str) -> DataFrame:
    """Add the value of the row after, wrapped in a struct: NULL means "no such row"."""
    return _neighbour(df, keys, order, value, name, forward=True)


def _neighbour(
    df: DataFrame, keys: list[str], order: list[str], value: str, name: str, forward: bool
) -> DataFrame:
    """Look next door inside the chunk; only chunk borders look across chunks.

    Both parts read the same shuffled rows. The second part holds at most two rows per
    chunk, in which the row next to a chunk's first row is the last of the chunk before.
    Without a chunk column every group is whole, and one window does it.
    """
    step = F.lead if forward else F.lag
    wrapped = F.struct(F.col(value).alias("value"))
    if CHUNK not in df.columns:
        return df.withColumn(name, step(wrapped).over(Window.partitionBy(*keys).orderBy(*order)))
    around = Window.partitionBy(*keys, CHUNK).orderBy(*order)
    # the wrapped value is a column of both parts, so that they share one exchange
    rows = df.withColumn("__value", wrapped).select(
        "*", step("__value").over(around).alias(name),
        F.lag(F.lit(True)).over(around).isNull().alias("__first"),
        F.lead(F.lit(True)).over(around).isNull().alias("__last"),
    )

    def cut(edge: Column) -> Column:
        # one expression, as a test of the chunk alone would move below the exchange and undo its reuse
        return F.when(edge, F.col(CHUNK).isNotNull()).otherwise(False)

    border = cut(F.col("__last" if forward else "__first"))
    across = Window.partitionBy(*keys).orderBy(CHUNK, *order)
    borders = (
        rows.where(cut(F.col("__first") | F.col("__last")))
        .withColumn(name, step("__value").over(across))
        .where(border)
    )
    return rows.where(~border).unionByName(borders).drop("__first", "__last", "__value")


def median(df: DataFrame, keys: list[str], value: str, chunk: Column, name: str) -> DataFrame:
    """Exact median per group, from counts of distinct values and their running totals.

    NULL values are ignored. ``chunk`` is a rule over the value column, for example its
    integer part.
    """
    counted = (
        df.where(F.col(value).isNotNull())
        .groupBy(*keys, F.col(value).cast("double").alias("__value"))
        .agg(F.count(F.lit(1)).alias("__n"))
        .withColumnRenamed("__value", value)
    )
    ranked = running_before(
        chunked(counted, chunk), keys, [value], {"__start": "__n"}, {"__size": "__n"}
    )
    low, high = F.floor((F.col("__size") - 1) / 2), F.floor(F.col("__size") / 2)
    end = F.col("__start") + F.col("__n")
    holds = [(F.col("__start") <= at) & (at < end) for at in (low, high)]
    return ranked.where(holds[0] | holds[1]).groupBy(*keys).agg(
        ((F.max(F.when(holds[0], F.col(value))) + F.max(F.when(holds[1], F.col(value)))) / 2)
        .alias(name)
    )
