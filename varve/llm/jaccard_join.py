"""Similarity join on word shingles by vertical partitioning.

Shingles have one global order, by document frequency and then by hash. It is cut into fragments, and
every fragment counts, for each candidate pair, the shingles that both have in it; the sum over the
fragments is the overlap. Candidates come from prefixes: two sets that are similar enough share one
of the first n - ceil(t * n) + 1 shingles of either, and shingles of one document alone come first, so
most documents are left alone without a pair.

Nodes are distinct sets, so copies meet once. Pairs are asked for in three rounds. In the first a set
is compared only with the set of each prefix list that has fewest shingles of its own, most often the
original of a group. In the second it is compared with the likeliest set of another component. In the
last, every pair of a prefix list is compared whose ends are not yet in one component, and whose lengths,
places in the order and bitmaps allow the overlap. A list of more than LIST sets is first split by a second
common shingle, and what is still long is cut into blocks of equal length and place; only pairs of blocks
that the bounds allow are compared, each in a task's group of its own. No link between components is lost, and a group
never becomes all its pairs.

A bitmap holds the parity of the shingles that fall on each of its bits. Two bitmaps differ in at most
as many bits as the sets differ in shingles, which bounds the overlap of two sets.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varve.llm.common import (
    BYTE_BASE, WORD_BASE, ensure_checkpoints, lowered, mixed, partitions, span_hashes, windows, word_hashes, word_spans,
)
from varve.llm.components import components
from varve.llm.sliced import BUCKETS, NO_ID, bucket_order, cells, deal, send, slice_of

SHINGLE = 5
PERCENT = 75
#: Sets with which a set is compared in the first round, and places of a list that it looks at in the
#: second; the last round is exact for what they leave.
CENTERS, NEAR = 2, 64
BITS = 1024
#: Sets of a list that one group of a task compares in the last round; a longer list is refined and cut
#: into blocks of about so many. In the second round lists are cut after WIDE sets.
LIST, WIDE = 4096, 1 << 16
#: Hash parts of the components of a block, so that large components have blocks of their own.
KINDS = 16
#: Pairs that may be sent to every task: at most 24 bytes each.
SMALL = 200_000
#: Bytes of shingles that make a fragment worth its while.
FRAGMENT = 1 << 19
#: A set with many partners travels once for each of so many parts of them.
PARTNERS = 64


def shingle_sets(part, shingle: int):
    """Distinct (text, shingle) of a slice: distinct hashes, and the text and hash number of each pair."""
    starts, ends, owner = word_spans(part)
    hashes = word_hashes(lowered(part.data), starts, ends)
    at, values = windows(hashes, owner, shingle)
    first = np.searchsorted(owner, np.arange(len(part) + 1))
    words = np.diff(first)
    short = np.flatnonzero((words > 0) & (words < shingle))
    texts = np.concatenate((owner[at], short))
    values = np.concatenate((values, span_hashes(hashes, first[short], first[short + 1], WORD_BASE)))
    keys, group = np.unique(values, return_inverse=True)
    code = np.unique(texts * max(1, len(keys)) + group)
    return keys, code // max(1, len(keys)), code % max(1, len(keys))


def _sums(values: np.ndarray, borders: np.ndarray) -> np.ndarray:
    """Sums of the values between the borders, modulo 2**64."""
    return np.diff(np.concatenate((np.zeros(1, np.uint64), np.cumsum(values, dtype=np.uint64)))[borders])


def frequency_class(table: pa.Table) -> pa.Table:
    """For the keys of a bucket: 0 if one document has the key, else a class that grows with the
    number of documents. 22 bits of a key travel besides its bucket; some single shingles are taken
    for shared ones, which costs time and changes no count."""
    packed, counts = cells(table, "keys", "u1")
    keys = np.zeros((len(packed) // 3, 4), np.uint8)
    keys[:, :3] = packed.reshape(-1, 3)
    keys, counts = keys.view("<u4").ravel(), [count // 3 for count in counts]
    _, group = np.unique(keys >> 2, return_inverse=True)
    times = np.bincount(group, weights=keys & 3)
    classes = np.where(times > 1, np.minimum(255, np.floor(8 * np.log2(np.maximum(times, 1)))), 0).astype(np.uint8)[group]
    cuts = np.cumsum(counts)[:-1]
    return pa.table({
        "s": table.column("s"), "b": table.column("b"),
        "classes": pa.array([zlib.compress(part.tobytes(), 1) for part in np.split(classes, cuts)], pa.binary()),
    })


def sets(docs: DataFrame, doc_id: str, text: str, shingle: int, percent: int) -> DataFrame:
    """doc_id, n, and where the set may be similar to another: node, alone (shingles of no other
    document) and shared (the others in the global order, packed)."""
    keyed = docs.select(
        F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.xxhash64(F.coalesce(F.col(text).cast("string"), F.lit(""))).alias("text_key")
    )
    dealt, buckets = deal(keyed, carry=("text_key",))

    def ask(table: pa.Table) -> pa.Table:
        keys, _, number = shingle_sets(slice_of(table), shingle)
        times = np.minimum(np.bincount(number, minlength=len(keys)), 3)
        short = ((keys >> np.uint64(42)).astype("<u4") << np.uint32(2) | times.astype("<u4")).view(np.uint8).reshape(-1, 4)[:, :3]
        return send(table.column("s")[0].as_py(), keys, buckets, {"keys": lambda row: short[row].tobytes()})

    def order(table: pa.Table, replies: pa.Table) -> pa.Table:
        kinds = {"doc_id": pa.int64(), "n": pa.int64(), "node": pa.int64(), "alone": pa.int64(), "shared": pa.binary(), "bits": pa.binary(), "text_key": pa.int64()}
        if not table.num_rows:
            return pa.table({name: pa.array([], kind) for name, kind in kinds.items()})
        part = slice_of(table)
        keys, texts, number = shingle_sets(part, shingle)
        classes = np.zeros(len(keys), np.uint8)
        by_bucket, bounds = bucket_order(keys, buckets)
        for b, cell in zip(replies.column("b").to_pylist(), replies.column("classes").to_pylist()):
            classes[by_bucket[bounds[b]:bounds[b + 1]]] = np.frombuffer(zlib.decompress(cell), np.uint8)
        own = classes[number]
        # a set is known by two sums over its hashes, mixed in different ways
        every, borders = keys[number], np.searchsorted(texts, np.arange(len(part) + 1))
        node = mixed(_sums(every, borders) ^ np.uint64(BYTE_BASE)) ^ _sums(mixed(every ^ np.uint64(WORD_BASE)), borders)
        parity = np.bincount(texts * BITS + (every % np.uint64(BITS)).astype(np.int64), minlength=len(part) * BITS) & 1
        bitmaps = np.packbits(parity.astype(np.uint8).reshape(len(part), BITS), axis=1)
        sizes = np.bincount(texts, minlength=len(part))
        alone = np.bincount(texts[own == 0], minlength=len(part))
        needed = -(-percent * sizes // 100)
        # a set whose prefix is all its own has no partner
        able = (sizes > 0) & (alone < sizes - needed + 1)
        wanted = able[texts] & (own > 0)
        texts, number, own = texts[wanted], number[wanted], own[wanted]
        ordered = np.lexsort((number, own, texts))  # numbers rise with hashes
        values = keys[number[ordered]]
        cuts = np.searchsorted(texts[ordered], np.arange(len(part) + 1))
        shared = [values[cuts[k]:cuts[k + 1]].tobytes() if able[k] else None for k in range(len(part))]
        return pa.table({
            "doc_id": pa.array(part.ids, pa.int64()), "n": pa.array(sizes, pa.int64()), "node": pa.array(node.view(np.int64), pa.int64(), mask=~able),
            "alone": pa.array(alone, pa.int64()), "shared": pa.array(shared, pa.binary()),
            "bits": pa.array([row.tobytes() if ok else None for row, ok in zip(bitmaps, able)], pa.binary()),
            "text_key": pc.struct_field(table.column("carried").take(part.order).combine_chunks(), "text_key"),
        })

    known = dealt.groupBy("s").applyInArrow(ask, "b int, s int, keys binary").groupBy("b").applyInArrow(
        frequency_class, "s int, b int, classes binary"
    )
    return dealt.groupBy("s").cogroup(known.groupBy("s")).applyInArrow(order, "doc_id long, n long, node long, alone long, shared binary, bits binary, text_key long")


def prefixes(nodes: DataFrame, percent: int) -> DataFrame:
    """key, node, n, alone, place: the shared shingles in the prefix of each set and their places."""

    def cut(batches):
        for batch in batches:
            n, alone = batch.column("n").to_numpy(), batch.column("alone").to_numpy()
            keys = [np.frombuffer(cell, "<i8") for cell in batch.column("shared").to_pylist()]
            length = n + percent * -n // 100 + 1 - alone
            keys = [key[:count] for key, count in zip(keys, length)]
            count = np.array([len(key) for key in keys], dtype=np.int64)
            place = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(alone, count)
            yield pa.RecordBatch.from_pydict({
                "key": pa.array(np.concatenate([*keys, np.zeros(0, np.int64)]), pa.int64()),
                "node": pa.array(np.repeat(batch.column("node").to_numpy(), count), pa.int64()),
                "n": pa.array(np.repeat(n, count).astype(np.int32), pa.int32()),
                "alone": pa.array(np.repeat(alone, count).astype(np.int32), pa.int32()), "place": pa.array(place.astype(np.int32), pa.int32()),
            })

    return nodes.select("node", "n", "alone", "shared").mapInArrow(cut, "key long, node long, n int, alone int, place int")


def overlaps(nodes: DataFrame, pairs: DataFrame, fragments: int) -> DataFrame:
    """a, b, overlap for pairs (a, b): counted in each fragment of the order, summed per pair.

    Shingles of one document alone never overlap, so fragments hold the shared ones."""
    pairs = pairs.checkpoint()
    few = pairs.count() <= SMALL
    grouped = pairs.withColumn("chunk", F.pmod(F.xxhash64("b"), F.lit(PARTNERS))).groupBy("a", "chunk").agg(F.collect_list("b").alias("partners"))
    # a set goes to its fragments once as itself and once for each chunk of partners
    asks = grouped.select(F.col("a").alias("node"), "partners").unionByName(
        pairs.select(F.col("b").alias("node")).distinct().select("node", F.array().cast("array<long>").alias("partners"))
    )
    # a few pairs go to the sets, or else both meet by node
    sent = nodes.select("node", "shared").join(F.broadcast(asks) if few else asks, "node")

    def cut(batches):
        for batch in batches:
            held: dict[int, list] = {}
            for node, partners, cell in zip(*(batch.column(n).to_pylist() for n in ("node", "partners", "shared"))):
                keys = np.frombuffer(cell, "<u8")
                order, bounds = bucket_order(keys, fragments)
                for f in np.flatnonzero(np.diff(bounds)):
                    held.setdefault(int(f), []).append((node, partners, keys[order[bounds[f]:bounds[f + 1]]]))
            yield pa.RecordBatch.from_pydict({
                "f": pa.array(list(held), pa.int32()),
                "node": pa.array([np.array([r[0] for r in rows], "<i8").tobytes() for rows in held.values()], pa.binary()),
                "asked": pa.array([np.array([len(r[1]) for r in rows], "<u4").tobytes() for rows in held.values()], pa.binary()),
                "partners": pa.array([np.array([p for r in rows for p in r[1]], "<i8").tobytes() for rows in held.values()], pa.binary()),
                "held": pa.array([np.array([len(r[2]) for r in rows], "<u4").tobytes() for rows in held.values()], pa.binary()),
                "keys": pa.array([np.concatenate([r[2] for r in rows]).tobytes() for rows in held.values()], pa.binary()),
            })

    groups = partitions(nodes.sparkSession)

    def count(table: pa.Table) -> pa.Table:
        node, asked, partners, held, keys = (
            cells(table, name, kind)[0] for name, kind in (("node", "<i8"), ("asked", "<u4"), ("partners", "<i8"), ("held", "<u4"), ("keys", "<u8"))
        )
        names = np.unique(node)
        _, key = np.unique(keys, return_inverse=True)
        width = int(key.max(initial=0)) + 1
        present = np.unique(np.repeat(np.searchsorted(names, node), held) * width + key)
        begin = np.cumsum(held.astype(np.int64)) - held
        left, other = np.repeat(np.arange(len(node)), asked), np.minimum(np.searchsorted(names, partners), len(names) - 1)
        ok = names[other] == partners if len(names) else np.zeros(0, bool)
        left, other, partners = left[ok], other[ok], partners[ok]
        sums = np.zeros(len(left), np.int64)
        for low in range(0, len(left), 4096):  # pairs at a time
            rows = left[low:low + 4096]
            sizes = held[rows].astype(np.int64)
            places = np.arange(sizes.sum()) + np.repeat(begin[rows] - (np.cumsum(sizes) - sizes), sizes)
            code = np.repeat(other[low:low + 4096], sizes) * width + key[places]
            at = np.minimum(np.searchsorted(present, code), len(present) - 1)
            sums[low:low + 4096] = np.bincount(np.repeat(np.arange(len(rows)), sizes), weights=present[at] == code, minlength=len(rows))
        some = np.flatnonzero(sums > 0)
        a, b = node[left[some]], partners[some]
        return send(0, mixed(a.view(np.uint64)) ^ b.view(np.uint64), groups, {
            "a": lambda row: a[row].tobytes(), "c": lambda row: b[row].tobytes(), "part": lambda row: sums[some[row]].astype("<i8").tobytes(),
        })

    def total(table: pa.Table) -> pa.Table:
        a, b, part = (cells(table, name, "<i8")[0] for name in ("a", "c", "part"))
        pair, number = np.unique(np.stack([a, b], axis=1), axis=0, return_inverse=True)
        overlap = np.bincount(number.ravel(), weights=part).astype(np.int64)
        return pa.table({"a": pa.array(pair[:, 0], pa.int64()), "b": pa.array(pair[:, 1], pa.int64()), "overlap": pa.array(overlap, pa.int64())})

    packed = sent.mapInArrow(cut, "f int, node binary, asked binary, partners binary, held binary, keys binary")
    parts = packed.groupBy("f").applyInArrow(count, "b int, s int, a binary, c binary, part binary")
    return parts.groupBy("b").applyInArrow(total, "a long, b long, overlap long")


def linked(nodes: DataFrame, pairs: DataFrame, percent: int, fragments: int) -> DataFrame:
    """The pairs that are similar enough."""
    sizes = nodes.select("node", "n")
    found = overlaps(nodes, pairs, fragments)
    both = found.join(sizes.toDF("a", "na"), "a").join(sizes.toDF("b", "nb"), "b")
    return both.where((100 + percent) * F.col("overlap") >= percent * (F.col("na") + F.col("nb"))).select("a", "b")


def first_pairs(prefix: DataFrame) -> DataFrame:
    """Each set with those sets of its prefix lists that have fewest shingles of their own, the most
    frequent of them first."""
    least = prefix.groupBy("key").agg(F.min(F.struct("alone", "node")).alias("a"), F.count("*").alias("size")).where("size > 1")
    votes = prefix.select("key", F.col("node").alias("b")).join(least.select("key", F.col("a.node").alias("a")), "key")
    votes = votes.where("a <> b").groupBy("b", "a").count()
    best = votes.groupBy("b").agg(F.slice(F.sort_array(F.collect_list(F.struct("count", "a")), asc=False), 1, CENTERS).alias("best"))
    return best.select(F.explode("best.a").alias("a"), "b")


def _mixed(placed: DataFrame) -> DataFrame:
    """The keys of lists that hold more than one component, with their sizes."""
    return placed.groupBy("key").agg(
        F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("size")
    ).where("low <> high").select("key", "size")


def two_common(nodes: DataFrame, lists: DataFrame, percent: int) -> DataFrame:
    """Long lists by pairs of shingles: key, node, n, ahead, component.

    Sets that need an overlap of c share two of the first n - c + 2 shingles of either. So where ``key``
    is their first common shingle, the second follows it within those, and no more can be
    common than the first and what follows from the second on."""

    def cut(batches):
        for batch in batches:
            key, node, n, alone, place, component = (batch.column(c).to_numpy() for c in ("key", "node", "n", "alone", "place", "component"))
            n, alone, place = n.astype(np.int64), alone.astype(np.int64), place.astype(np.int64)
            stop = n + percent * -n // 100 + 2 - alone
            seconds = [np.frombuffer(cell, "<i8")[low:high] for cell, low, high in zip(batch.column("shared").to_pylist(), place - alone + 1, stop)]
            count = np.array([len(second) for second in seconds], dtype=np.int64)
            at = np.repeat(place, count) + 1 + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            both = mixed(np.repeat(key, count).view(np.uint64)) ^ np.concatenate([*seconds, np.zeros(0, np.int64)]).view(np.uint64)
            yield pa.RecordBatch.from_pydict({
                "key": pa.array(both.view(np.int64), pa.int64()), "node": pa.array(np.repeat(node, count), pa.int64()),
                "n": pa.array(np.repeat(n, count).astype(np.int32), pa.int32()),
                "ahead": pa.array((np.repeat(n, count) - at + 1).astype(np.int32), pa.int32()),
                "component": pa.array(np.repeat(component, count), pa.int64()),
            })

    held = lists.select("key", "node", "n", "alone", "place", "component").join(nodes.select("node", "shared"), "node")
    return held.mapInArrow(cut, "key long, node long, n int, ahead int, component long")


def block_pairs(lists: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """The blocks of long lists, and the pairs (x, y) of their parts that may hold similar sets of two components.

    A block has one length and place, so the bounds hold or fail for all its pairs at once."""
    blocks = lists.withColumn("kind", F.pmod(F.xxhash64("component"), F.lit(KINDS)).cast("int")).groupBy("key", "n", "ahead", "kind").agg(
        F.min("component").alias("low"), F.max("component").alias("high"), F.ceil(F.count("*") / LIST).cast("int").alias("parts")
    ).checkpoint()
    names = ("ahead", "kind", "low", "high", "parts")
    x = blocks.select("key", F.col("n").alias("nx"), *[F.col(c).alias(c + "x") for c in names])
    x = x.withColumn("n", F.explode(F.sequence("nx", F.expr(f"CAST(100L * nx DIV {percent} AS INT)"))))
    y = blocks.select("key", "n", *[F.col(c).alias(c + "y") for c in names])
    met = x.join(y, ["key", "n"]).where(
        "(nx, aheadx, kindx) <= (n, aheady, kindy) AND NOT (lowx = highx AND lowy = highy AND lowx = lowy) "
        f"AND {100 + percent} * least(aheadx, aheady) >= {percent} * (nx + n)"
    )
    met = met.withColumn("partx", F.explode(F.expr("sequence(0, partsx - 1)"))).withColumn("party", F.explode(F.expr("sequence(0, partsy - 1)")))
    met = met.where("(nx, aheadx, kindx) < (n, aheady, kindy) OR partx <= party")
    return blocks, met.select(
        F.struct("key", F.col("nx").alias("n"), F.col("aheadx").alias("ahead"), F.col("kindx").alias("kind"), F.col("partx").alias("part")).alias("x"),
        F.struct("key", "n", F.col("aheady").alias("ahead"), F.col("kindy").alias("kind"), F.col("party").alias("part")).alias("y"),
    )


def _allowed(a, b, node, n, ahead, group, bits, percent: int):
    """Rows of a, b that the components and the bounds leave, with the overlap that bitmaps allow."""
    keep = (group[a] != group[b]) & ((100 + percent) * np.minimum(ahead[a], ahead[b]) >= percent * (n[a] + n[b]))
    a, b = a[keep], b[keep]
    most = (n[a] + n[b] - np.bitwise_count(bits[a] ^ bits[b]).sum(axis=1, dtype=np.int64)) // 2
    keep = (100 + percent) * most >= percent * (n[a] + n[b])
    return a[keep], b[keep], most[keep]


def _columns(table: pa.Table):
    node, n, ahead, group = (table.column(c).to_numpy() for c in ("node", "n", "ahead", "component"))
    bits = np.frombuffer(b"".join(table.column("bits").to_pylist()), np.uint64).reshape(len(node), BITS // 64)
    return node, n.astype(np.int64), ahead.astype(np.int64), group, bits


def _in_blocks(nodes: DataFrame, lists: DataFrame, percent: int) -> DataFrame:
    """Pairs of long lists, block by block."""
    blocks, pairs = block_pairs(lists, percent)
    kept = pairs.checkpoint()
    asks = kept.select(F.col("x").alias("block"), "x", "y", F.lit(0).alias("side")).unionByName(
        kept.where("x <> y").select(F.col("y").alias("block"), "x", "y", F.lit(1).alias("side"))
    )
    rows = lists.withColumn("kind", F.pmod(F.xxhash64("component"), F.lit(KINDS)).cast("int")).join(
        blocks.select("key", "n", "ahead", "kind", "parts"), ["key", "n", "ahead", "kind"]
    ).withColumn("block", F.struct("key", "n", "ahead", "kind", F.expr("CAST(pmod(xxhash64(node), parts) AS INT)").alias("part")))
    # only rows of blocks that are compared need their bitmaps
    used = rows.join(asks.select("block").distinct(), "block", "left_semi").join(nodes.select("node", "bits"), "node")
    sent = used.select("block", "node", "n", "ahead", "component", "bits").join(asks, "block").drop("block")

    def pair(table: pa.Table) -> pa.Table:
        side = table.column("side").to_numpy()
        columns = _columns(table)
        node = columns[0]
        left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        alike = table.column("x")[0] == table.column("y")[0]
        right = left if alike else right
        step, found = max(1, (1 << 18) // max(1, len(right))), []
        for low in range(0, len(left), step):
            a = np.repeat(left[low:low + step], len(right))
            b = np.tile(right, len(left[low:low + step]))
            if alike:
                a, b = a[a < b], b[a < b]
            a, b, _ = _allowed(a, b, *columns, percent)
            found.append(np.stack([np.minimum(node[a], node[b]), np.maximum(node[a], node[b])], axis=1))
        pairs = np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 2), np.int64)
        return pa.table({"a": pa.array(pairs[:, 0], pa.int64()), "b": pa.array(pairs[:, 1], pa.int64())})

    return sent.groupBy("x", "y").applyInArrow(pair, "a long, b long")


def _in_lists(nodes: DataFrame, lists: DataFrame, percent: int, near: int | None) -> DataFrame:
    """Pairs of short lists: a, b and the overlap that bitmaps allow."""
    buckets = BUCKETS * partitions(nodes.sparkSession)
    lists = lists.withColumn("f", F.pmod(F.xxhash64("key"), F.lit(buckets)).cast("int"))
    lists = lists.join(nodes.select("node", "bits"), "node").select("f", "key", "node", "n", "ahead", "component", "bits")

    def pair(table: pa.Table) -> pa.Table:
        key = table.column("key").to_numpy()
        node, n, ahead, group, bits = _columns(table)
        order = np.lexsort((node, n, key))
        key, node, n, ahead, group, bits = key[order], node[order], n[order], ahead[order], group[order], bits[order]
        # partners follow in the list and are at most so much larger
        width = int(n.max(initial=0)) + 1
        number = np.cumsum(np.concatenate(([0], key[1:] != key[:-1])))
        last = np.searchsorted(number * width + n, number * width + np.minimum(100 * n // percent, width - 1), side="right")
        count = last - np.arange(len(key)) - 1
        count = np.minimum(count, near) if near else count
        # rows whose partners are about a quarter of a million
        cuts = np.searchsorted(np.cumsum(count), np.arange(0, count.sum(), 1 << 18))
        found = []
        for low, high in zip(cuts, [*cuts[1:], len(key)]):
            rows = np.arange(low, high)
            counts = count[rows]
            a = np.repeat(rows, counts)
            b = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + a + 1
            # in the list of their first common shingle no more can be common than what follows
            a, b, most = _allowed(a, b, node, n, ahead, group, bits, percent)
            a, b = node[a], node[b]
            if not near:
                found.append(np.unique(np.stack([np.minimum(a, b), np.maximum(a, b), 0 * most], axis=1), axis=0))
                continue
            # for each set the partner with the largest share, of both directions
            ends, others, share = np.concatenate((a, b)), np.concatenate((b, a)), np.concatenate((most, most))
            best = np.lexsort((others, -share, ends))
            first = np.flatnonzero(np.concatenate(([True], ends[best][1:] != ends[best][:-1])))[: len(ends)]
            found.append(np.stack([ends[best][first], others[best][first], share[best][first]], axis=1))
        pairs = np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 3), np.int64)
        return pa.table({name: pa.array(pairs[:, k], pa.int64()) for k, name in enumerate(("a", "b", "most"))})

    return lists.groupBy("f").applyInArrow(pair, "a long, b long, most long")


def open_pairs(nodes: DataFrame, prefix: DataFrame, of: DataFrame, percent: int, near: int | None) -> DataFrame:
    """Pairs of a prefix list in different components that may still be similar: all of them, or
    with ``near`` the likeliest of each set among so many places ahead in its lists."""
    placed = prefix.join(of, "node", "left").withColumn("component", F.coalesce("component", "node")).withColumn("ahead", F.expr("n - place"))
    keys = _mixed(placed).checkpoint()
    lists = placed.join(keys, "key")
    if near:
        part = F.pmod(F.xxhash64("node"), F.ceil(F.col("size") / WIDE))
        lists = lists.withColumn("key", F.when(F.col("size") > WIDE, F.xxhash64("key", part)).otherwise(F.col("key")))
        best = _in_lists(nodes, lists, percent, near).groupBy("a").agg(F.max(F.struct("most", "b")).alias("best"))
        return best.select(F.least("a", "best.b").alias("a"), F.greatest("a", "best.b").alias("b")).distinct()
    found = _in_lists(nodes, lists.where(F.col("size") <= LIST), percent, None).select("a", "b")
    if not keys.where(F.col("size") > LIST).isEmpty():
        long = lists.where(F.col("size") > LIST)
        # sets of one shingle have no second one, and at half or less may need only one in common
        if percent > 50:
            refined = two_common(nodes, long, percent)
            keys = _mixed(refined).checkpoint()
            long = refined.join(keys, "key")
            found = found.unionByName(_in_lists(nodes, long.where(F.col("size") <= LIST), percent, None).select("a", "b"))
            long = long.where(F.col("size") > LIST)
        found = found.unionByName(_in_blocks(nodes, long, percent))
    return found.distinct()


def similar(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, percent: int = PERCENT,
) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id, text_key, component_key.

    A row's set holds the distinct sequences of ``shingle`` words of its text, A-Z lower-cased; a
    shorter text is one sequence. Rows are linked when 100 * intersection >= percent * union of
    their sets, and ``component_id`` is the smallest id that links reach. ``text_key`` is the xxhash64 of
    the text and ``component_key`` names the component, also where ids repeat. A null or empty text has an
    empty set and is linked with nothing. A null id counts as larger than any other and is shown as
    null; rows with the same id are linked by their texts alone; an empty table gives no rows; other
    columns are not read.
    """
    spark = docs.sparkSession
    ensure_checkpoints(spark)
    rows = sets(docs, doc_id, text, shingle, percent).checkpoint()
    nodes = rows.where("node is not null").groupBy("node").agg(
        F.first("n").alias("n"), F.first("alone").alias("alone"), F.first("shared").alias("shared"), F.first("bits").alias("bits")
    ).checkpoint()
    prefix = prefixes(nodes, percent)
    size = nodes.agg(F.sum(F.octet_length("shared"))).first()[0] or 0
    fragments = min(partitions(spark), size // FRAGMENT + 1)
    links = linked(nodes, first_pairs(prefix), percent, fragments).checkpoint()
    for near in (NEAR, None):
        more = open_pairs(nodes, prefix, components(links), percent, near)
        links = links.unionByName(linked(nodes, more, percent, fragments)).checkpoint()
    of = components(links)
    members = rows.where("node is not null").select("doc_id", "n", "node", "text_key").join(of, "node", "left").select(
        "doc_id", "n", F.coalesce("component", "node").alias("component"), "text_key"
    )
    least = members.groupBy("component").agg(F.min("doc_id").alias("least"))
    together = members.join(least, "component").select("doc_id", "n", "least", "text_key", "component")
    single = rows.where("node is null").select(
        "doc_id", "n", F.col("doc_id").alias("least"), "text_key", F.xxhash64("doc_id", "text_key").alias("component")
    )
    return together.unionByName(single).select(
        F.nullif("doc_id", F.lit(NO_ID)).alias("doc_id"), F.col("n").alias("n_shingles"),
        F.nullif("least", F.lit(NO_ID)).alias("component_id"), "text_key", F.col("component").alias("component_key"),
    )
