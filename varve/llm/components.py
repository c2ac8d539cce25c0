"""Connected components: links are contracted where they lie, then by large-star and small-star steps."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


#: Links that one task contracts, 16 bytes each.
AT_ONCE = 500_000


def _stars(batches):
    """Links of one task as links of each node to the smallest node that it reaches through them."""
    tables = [pa.Table.from_batches([batch]) for batch in batches]
    if not tables:
        return
    ends = pa.concat_tables(tables)
    u, v = ends.column("u").to_numpy(), ends.column("v").to_numpy()
    nodes, number = np.unique(np.concatenate((u, v)), return_inverse=True)
    left, right = number[:len(u)], number[len(u):]
    label = np.arange(len(nodes))
    while True:
        least = label.copy()
        np.minimum.at(least, left, label[right])
        np.minimum.at(least, right, label[left])
        np.minimum.at(least, label, least)  # a root takes the least of its members
        least = least[least]
        if (least == label).all():
            break
        label = least
    far = np.flatnonzero(label != np.arange(len(nodes)))
    if len(far):
        yield pa.RecordBatch.from_pydict({"u": pa.array(nodes[far], pa.int64()), "v": pa.array(nodes[label[far]], pa.int64())})


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, component: the smallest node that each node of ``links`` reaches.

    Tasks first contract up to AT_ONCE links each. If there was more than one such task, star steps
    follow until the links no longer change; every step sends a link at most twice and first takes
    minima on the map side, so a node with very many links is no burden. Results of steps are written
    to the checkpoint folder. A node that is linked to itself alone is not in the result.
    """
    ends = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v")
    tasks = links.count() // AT_ONCE + 1
    edges = ends.coalesce(tasks).mapInArrow(_stars, "u long, v long").checkpoint()
    if tasks == 1:
        return _members(edges)
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        root = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(root, "u").select(F.explode(F.array(
            F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v"))
        )).alias("e")).select("e.u", "e.v").where("u <> v").distinct().checkpoint()
        # the same links in other order, or links still on the move
        facts = [F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))]
        before, after = edges.agg(*facts).first(), small.agg(*facts).first()
        edges = small
        if tuple(before) == tuple(after):
            break
    return _members(edges)


def _members(stars: DataFrame) -> DataFrame:
    members = stars.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = stars.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return members.unionByName(roots)
