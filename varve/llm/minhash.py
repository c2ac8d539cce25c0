"""MinHash near-dedup by an inverted join on signature coordinates.

The nodes are distinct shingle sets, so exact copies meet once. A signature holds COORDINATES minima, and a node is posted
under pairs (coordinate, value). Two sets of the asked similarity agree in MATCHES coordinates or more, but for a chance below
MISS. Collisions are counted in three ways that leave out most lists:

* Prefix: the pairs of a node have one global order, by the number of nodes under them. Nodes that agree in
  MATCHES coordinates share at least EXTRA of the first COORDINATES - MATCHES + EXTRA pairs of either, and pairs of
  one node alone are of no use; a node with less than EXTRA others among these has no partner, as most have none.
* Contraction: first each node is compared with those nodes that have fewest pairs of their own in one of its lists, most often
  the originals of a group. Such pairs above the match threshold make up families, and the best of each node a star. A family is cut
  into blocks, in which all sets are compared at once by a product of their incidence matrices: first the blocks of a star, and
  then those pairs of blocks of the family that are not yet one component. What a task returns are links contracted where they
  lie, so neither a group of near copies nor one of texts just too different becomes all its pairs. Lists that lie in one family
  are left out of the merging.
* Skipping: lists of more than CROWD nodes are not merged. A node has a known number of them, so a pair
  needs as many collisions less in the other lists. Only nodes with EXTRA crowded lists or more can be a pair
  without any other collision; they are compared by whole signatures in blocks of BLOCK nodes, those of like length and of
  different families.

Pairs above the match threshold are confirmed on full sets, which are made again from the texts of the candidates alone.

What is not exact is the signature: a link is missed with a chance below MISS, which is in practice none (1e-9 for
a pair just at the limit, less for every other); no list, partner or candidate is capped.

Nulls and ties: a null or empty text, or one without words, has no shingles and is linked with nothing; its component is its own
id. A component is named by its smallest id; null ids count last, and a component of null ids alone has
none. ``kept`` is true for every row that has the component's id, null or not, so repeated rows are all kept or all not.
An empty table gives no rows; other columns are ignored. A text over 8 MB is read a few MB of words at a time.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varve.llm.common import (
    BYTE_BASE, WORD_BASE, Slice, chunked_word_hashes, ensure_checkpoints, id_and_bytes, lowered, mixed, partitions, slices, span_hashes,
)
from varve.llm.components import _stars, components
from varve.llm.jaccard_join import shingle_sets
from varve.llm.sliced import NO_ID, bucket_order, cells, send

SHINGLE, PERCENT = 2, 80
COORDINATES, MISS = 128, 1e-9
#: Collisions that a pair must have in the prefixes.
EXTRA = 8
#: Nodes of a list that is still merged, so that a posting makes at most half as many rows; and nodes of a block whose
#: signatures are compared.
CROWD, BLOCK = 32, 2048
#: Shingles of a block of sets, where every set counts SET more, so that a block has at most 2048 of them.
WEIGHT, SET = 1 << 20, 1 << 9
#: Nodes whose pairs are asked for together, and pairs that make up a bucket.
SLICE, BUCKET = 4096, 1 << 22
LONG = 8 << 20


def least_matches(coordinates: int, percent: int, miss: float) -> int:
    """The largest number of coordinates in which two sets just at the limit agree, but for a chance under ``miss``."""
    share, below = percent / 100, 0.0
    for count in range(coordinates + 1):
        below += math.comb(coordinates, count) * share ** count * (1 - share) ** (coordinates - count)
        if below > miss:
            return count
    return coordinates


MATCHES = least_matches(COORDINATES, PERCENT, MISS)
PREFIX = COORDINATES - MATCHES + EXTRA


def _draws() -> tuple[np.ndarray, np.ndarray]:
    """An odd factor and a shift for each coordinate."""
    drawn = mixed(np.arange(1, 2 * COORDINATES + 1, dtype=np.uint64) * np.uint64(BYTE_BASE))
    return (drawn[:COORDINATES] >> np.uint64(32)).astype(np.uint32) | np.uint32(1), (drawn[COORDINATES:] >> np.uint64(32)).astype(np.uint32)


FACTORS, SHIFTS = _draws()


def _sets(part: Slice, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of each text of a slice, rising within a text, and the borders of the texts among them."""
    if len(part) == 1 and len(part.data) > LONG:
        seen, tail, words = np.zeros(0, np.uint64), np.zeros(0, np.uint64), 0
        for hashes in chunked_word_hashes(lowered(part.data)):
            words += len(hashes)
            run = np.concatenate((tail, hashes))
            at = np.arange(max(0, len(run) - shingle + 1))
            if len(at):
                seen = np.union1d(seen, span_hashes(run, at, at + shingle, WORD_BASE))
            tail = run[max(0, len(run) - shingle + 1):]
        if 0 < words < shingle:
            seen = span_hashes(tail, np.array([0]), np.array([words]), WORD_BASE)
        return seen, np.array([0, len(seen)])
    keys, texts, number = shingle_sets(part, shingle)
    return keys[number], np.searchsorted(texts, np.arange(len(part) + 1))


def _sums(values: np.ndarray, borders: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values, out=sums[1:])
    return np.diff(sums[borders])


def _signatures(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Minima of every coordinate over the runs from ``starts``, one row a run."""
    short = (values >> np.uint64(32)).astype(np.uint32)
    out, work = np.empty((len(starts), COORDINATES), np.uint32), np.empty_like(short)
    for k in range(COORDINATES):
        np.multiply(short, FACTORS[k], out=work)
        np.add(work, SHIFTS[k], out=work)
        out[:, k] = np.minimum.reduceat(work, starts)
    return out


def signed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """doc_id, id (a null as NO_ID), text_key, n, and for texts with shingles node (the set's key) and signature."""
    rows = docs.select(
        F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.xxhash64(F.coalesce(F.col(text).cast("string"), F.lit(""))).alias("text_key")
    )

    def sign(batches):
        for batch in batches:
            keys, done = batch.column("carried").field("text_key"), 0
            for part in slices(batch):
                values, borders = _sets(part, shingle)
                sizes = np.diff(borders)
                some = np.flatnonzero(sizes)
                node = mixed(_sums(values, borders) ^ np.uint64(BYTE_BASE)) ^ _sums(mixed(values ^ np.uint64(WORD_BASE)), borders)
                cell = iter(_signatures(values, borders[some]) if len(some) else ())
                yield pa.RecordBatch.from_pydict({
                    "doc_id": pa.array(part.ids, pa.int64()), "id": pa.array([NO_ID if i is None else i for i in part.ids], pa.int64()),
                    "text_key": keys.slice(done, len(part)), "n": pa.array(sizes, pa.int64()),
                    "node": pa.array(node.view(np.int64), pa.int64(), mask=sizes == 0),
                    "signature": pa.array([next(cell).tobytes() if size else None for size in sizes], pa.binary()),
                })
                done += len(part)

    return id_and_bytes(rows, carry=("text_key",)).mapInArrow(sign, "doc_id long, id long, text_key long, n long, node long, signature binary")


def _pair_keys(table: pa.Table) -> np.ndarray:
    """64-bit keys of the (coordinate, value) pairs, one row a node."""
    values = cells(table, "signature", "<u4")[0].reshape(-1, COORDINATES).astype(np.uint64)
    return mixed(values | np.arange(1, COORDINATES + 1, dtype=np.uint64) << np.uint64(32))


def _frequencies(table: pa.Table) -> pa.Table:
    """For the pairs of a bucket: 0 if one node is posted under it, else a class that grows with their number."""
    keys, counts = cells(table, "keys", "<u4")
    times = np.concatenate([np.frombuffer(zlib.decompress(cell), "<u2") for cell in table.column("times").to_pylist()])
    _, group = np.unique(keys, return_inverse=True)
    total = np.bincount(group, weights=times)
    classes = np.minimum(255, np.floor(8 * np.log2(np.maximum(total, 1)))).astype(np.uint8)[group]
    return pa.table({"s": table.column("s"), "b": table.column("b"), "classes": pa.array(
        [zlib.compress(part.tobytes(), 1) for part in np.split(classes, np.cumsum(counts)[:-1])], pa.binary())})


def postings(nodes: DataFrame) -> DataFrame:
    """key, node, n, own: the pairs of the prefixes under which others may be found too; own is the number of
    coordinates that the node shares with none. Nodes that cannot have a partner are not posted."""
    parts, count = partitions(nodes.sparkSession), nodes.count()
    groups = max(count // SLICE + 1, min(parts, count // 256 + 1))
    pairs = count * COORDINATES
    buckets = max(pairs // BUCKET + 1, min(parts, (pairs >> 16) + 1))
    dealt = nodes.withColumn("s", F.pmod(F.xxhash64("node"), F.lit(groups)).cast("int")).select("s", "node", "n", "signature")

    def ask(table: pa.Table) -> pa.Table:
        keys, times = np.unique(_pair_keys(table), return_counts=True)
        high = (keys >> np.uint64(32)).astype("<u4")
        return send(table.column("s")[0].as_py(), keys, buckets, {
            "keys": lambda row: high[row].tobytes(), "times": lambda row: zlib.compress(times[row].astype("<u2").tobytes(), 1),
        })

    def order(table: pa.Table, replies: pa.Table) -> pa.Table:
        if not table.num_rows:
            return pa.table({"key": pa.array([], pa.int64()), "node": pa.array([], pa.int64()), "n": pa.array([], pa.int32()), "own": pa.array([], pa.int32())})
        every = _pair_keys(table)
        keys, number = np.unique(every, return_inverse=True)
        classes = np.zeros(len(keys), np.uint8)
        by_bucket, bounds = bucket_order(keys, buckets)
        for b, cell in zip(replies.column("b").to_pylist(), replies.column("classes").to_pylist()):
            classes[by_bucket[bounds[b]:bounds[b + 1]]] = np.frombuffer(zlib.decompress(cell), np.uint8)
        number = number.reshape(every.shape)
        rank = classes[number].astype(np.int64) * len(keys) + number  # numbers rise with keys
        first = np.sort(rank, axis=1)[:, :PREFIX]
        own = (classes[number] == 0).sum(axis=1)
        shared = first >= len(keys)
        shared &= shared.sum(axis=1, keepdims=True) >= EXTRA
        row, _ = np.nonzero(shared)
        n, node = table.column("n").to_numpy(), table.column("node").to_numpy()
        return pa.table({
            "key": pa.array(keys[first[shared] % len(keys)].view(np.int64), pa.int64()), "node": pa.array(node[row], pa.int64()),
            "n": pa.array(n[row].astype(np.int32), pa.int32()), "own": pa.array(own[row].astype(np.int32), pa.int32()),
        })

    known = dealt.groupBy("s").applyInArrow(ask, "b int, s int, keys binary, times binary").groupBy("b").applyInArrow(
        _frequencies, "s int, b int, classes binary")
    return dealt.groupBy("s").cogroup(known.groupBy("s")).applyInArrow(order, "key long, node long, n int, own int")


def _like(a, b, percent: int):
    """Whether sizes allow the similarity."""
    return 100 * F.least(a, b) >= percent * F.greatest(a, b)


def centre_pairs(posted: DataFrame, percent: int) -> DataFrame:
    """a, b: each node with the centres that it collides with often enough; the centre of a list is the node with fewest pairs of
    its own."""
    centres = posted.groupBy("key").agg(F.min(F.struct("own", "node", "n")).alias("c")).select(
        "key", F.col("c.node").alias("b"), F.col("c.n").alias("n_b"))
    met = posted.withColumnRenamed("node", "a").join(centres, "key").where(F.col("a") != F.col("b")).where(_like(F.col("n"), F.col("n_b"), percent))
    return met.groupBy("a", "b").count().where(F.col("count") >= EXTRA).select("a", "b")


def merged_pairs(posted: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """Pairs of different components with enough collisions in lists that are not crowded; and the nodes, with their
    components, that may have partners in crowded lists alone. ``posted`` has the components."""
    lists = posted.groupBy("key").agg(F.count("*").alias("size"), F.min("component").alias("least"), F.max("component").alias("most")).where("least <> most")
    placed = posted.join(lists.select("key", "size"), "key").checkpoint()
    crowded = placed.where(F.col("size") > CROWD).groupBy("node", "component", "n").agg(F.count("*").alias("crowded"))
    left = placed.where(F.col("size") <= CROWD).select("key", "node", "component", "n")
    right = left.toDF("key", "node_b", "component_b", "n_b")
    met = left.join(right, "key").where(
        (F.col("component") < F.col("component_b")) & _like(F.col("n"), F.col("n_b"), percent)
    ).groupBy(F.col("node").alias("a"), F.col("node_b").alias("b")).count()
    skipped = crowded.select("node", "crowded")
    needed = EXTRA - F.least(F.coalesce("crowded_a", F.lit(0)), F.coalesce("crowded_b", F.lit(0)))
    pairs = met.join(skipped.toDF("a", "crowded_a"), "a", "left").join(skipped.toDF("b", "crowded_b"), "b", "left").where(F.col("count") >= needed)
    return pairs.select("a", "b"), crowded.where(F.col("crowded") >= EXTRA).select("node", "component", "n")


def block_pairs(dense: DataFrame, percent: int) -> DataFrame:
    """Pairs of different components above the match threshold, by whole signatures, block against block.

    Blocks are of nodes whose sizes lie in one step of the ratio that the similarity allows, so that a block meets
    those of its own step and of the next. The number of steps is some dozens, whatever the data."""
    stepped = dense.withColumn("step", F.floor(F.log(F.col("n").cast("double")) / math.log(100 / percent) + 1e-9).cast("int"))
    sizes = {r.step: -(-r["count"] // BLOCK) for r in stepped.groupBy("step").count().collect()}
    if not sizes:
        return dense.sparkSession.createDataFrame([], "a long, b long")
    blocks = F.create_map(*(F.lit(x) for item in sizes.items() for x in item))
    numbered = stepped.withColumn("own", F.pmod(F.xxhash64("node"), blocks[F.col("step")]).cast("int"))
    none = F.array().cast("array<struct<x:int,i:int,y:int,j:int>>")

    def meets(step, side):
        """The groups in which a block meets the blocks of ``step``."""
        others = blocks[step]
        own = F.struct(F.col("step").alias("x"), F.col("own").alias("i"))
        return F.when(others.isNull(), none).otherwise(F.transform(F.sequence(F.lit(0), others - 1), lambda k: side(own, step, k)))

    groups = F.concat(
        meets(F.col("step"), lambda own, step, k: F.struct(step.alias("x"), F.least(own.i, k).alias("i"), step.alias("y"), F.greatest(own.i, k).alias("j"))),
        meets(F.col("step") + 1, lambda own, step, k: F.struct(own.x.alias("x"), own.i.alias("i"), step.alias("y"), k.alias("j"))),
        meets(F.col("step") - 1, lambda own, step, k: F.struct(step.alias("x"), k.alias("i"), own.x.alias("y"), own.i.alias("j"))),
    )
    sent = numbered.select("node", "component", "n", "signature", F.col("step").alias("own_step"), "own", F.explode(groups).alias("g"))

    def compare(table: pa.Table) -> pa.Table:
        g = table.column("g")[0].as_py()
        node, component, n, step, own = (table.column(c).to_numpy() for c in ("node", "component", "n", "own_step", "own"))
        signature = cells(table, "signature", "<u4")[0].reshape(-1, COORDINATES)
        left = np.flatnonzero((step == g["x"]) & (own == g["i"]))
        right = np.flatnonzero((step == g["y"]) & (own == g["j"]))
        same = (g["x"], g["i"]) == (g["y"], g["j"])
        found = []
        if len(left) and len(right) and min(component[left].min(), component[right].min()) != max(component[left].max(), component[right].max()):
            for at in range(0, len(left), 32):
                rows = left[at:at + 32]
                open_ = component[rows][:, None] != component[right][None, :]
                open_ &= 100 * np.minimum(n[rows][:, None], n[right]) >= percent * np.maximum(n[rows][:, None], n[right])
                if same:
                    open_ &= rows[:, None] < right[None, :]
                i, j = np.nonzero(open_)
                for low in range(0, len(i), 1 << 16):
                    a, b = rows[i[low:low + (1 << 16)]], right[j[low:low + (1 << 16)]]
                    enough = (signature[a] == signature[b]).sum(axis=1) >= MATCHES
                    found.append(np.stack([node[a[enough]], node[b[enough]]]))
        ends = np.concatenate(found, axis=1) if found else np.zeros((2, 0), np.int64)
        return pa.table({"a": pa.array(ends[0], pa.int64()), "b": pa.array(ends[1], pa.int64())})

    return sent.groupBy("g").applyInArrow(compare, "a long, b long")


def matching(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """a, b, matches: the pairs whose signatures agree in MATCHES coordinates or more."""
    signatures = nodes.select("node", "signature")
    both = pairs.join(signatures.toDF("a", "left"), "a").join(signatures.toDF("b", "right"), "b").select("a", "b", "left", "right")

    def count(batches):
        for batch in batches:
            if batch.num_rows:
                table = pa.Table.from_batches([batch])
                left, right = (cells(table, c, "<u4")[0].reshape(-1, COORDINATES) for c in ("left", "right"))
                matches = (left == right).sum(axis=1)
                yield batch.select(["a", "b"]).append_column("matches", pa.array(matches, pa.int64())).filter(pa.array(matches >= MATCHES))

    return both.mapInArrow(count, "a long, b long, matches long")


def full_sets(docs: DataFrame, nodes: DataFrame, wanted: DataFrame, doc_id: str, text: str, shingle: int) -> DataFrame:
    """node, held: the shingles of the ``wanted`` nodes, packed in rising order, made from one text of each."""
    keyed = docs.select(
        F.coalesce(F.col(doc_id).cast("long"), F.lit(NO_ID)).alias("id"), F.col(text).alias("text"),
        F.xxhash64(F.coalesce(F.col(text).cast("string"), F.lit(""))).alias("text_key"),
    )
    asked = wanted.select("node").distinct().join(nodes.select("node", "id", "text_key"), "node")
    texts = keyed.join(asked, ["id", "text_key"]).dropDuplicates(["node"])

    def shingled(batches):
        for batch in batches:
            for part in slices(batch):
                values, borders = _sets(part, shingle)
                yield pa.RecordBatch.from_pydict({
                    "node": pa.array(part.ids, pa.int64()),
                    "held": pa.array([values[x:y].tobytes() for x, y in zip(borders, borders[1:])], pa.binary()),
                })

    return id_and_bytes(texts, "node").mapInArrow(shingled, "node long, held binary").checkpoint()


def _overlaps(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Shingles in common of every set of ``left`` with every one of ``right``, by products of incidence matrices over the
    shingles that two sets or more hold, a part of them at a time."""
    held = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), [len(own) for own in sets])
    keys, column, times = np.unique(held, return_inverse=True, return_counts=True)
    column = np.where(times > 1, np.cumsum(times > 1) - 1, -1)[column]
    owner, column = owner[column >= 0], column[column >= 0]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    columns = int(column[-1]) + 1 if len(column) else 0
    width = max(1, min(columns, (1 << 24) // len(sets)))
    total = np.zeros((len(left), len(right)))
    for low in range(0, columns, width):
        some = slice(*np.searchsorted(column, (low, low + width)))
        has = np.zeros((len(sets), width), np.float32)
        has[owner[some], column[some] - low] = 1
        total += has[left] @ has[right].T
    return total


def block_links(rows: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """a, b: links between the components of each group, contracted. ``rows``: g, side, node, component; the nodes of side 0 are
    compared with those of side 1, or with one another where there is no side 1."""
    parts = partitions(rows.sparkSession)
    weight = rows.join(sets.select("node", F.octet_length("held").alias("size")), "node").agg(F.sum(F.col("size") / 8 + SET)).first()[0] or 0
    buckets = int(max(weight // WEIGHT + 1, min(parts, weight // (WEIGHT >> 4) + 1)))
    sent = rows.join(sets, "node").withColumn("bucket", F.pmod("g", F.lit(buckets)).cast("int"))

    def compare(table: pa.Table) -> pa.Table:
        table = table.sort_by([("g", "ascending"), ("side", "ascending")])
        g, side, node, component = (table.column(c).to_numpy() for c in ("g", "side", "node", "component"))
        sets = [np.frombuffer(cell.as_buffer(), "<u8") for cell in table.column("held")]
        sizes = np.array([len(own) for own in sets], np.int64)
        found = [pa.table({"u": pa.array([], pa.int64()), "v": pa.array([], pa.int64())})]
        borders = np.concatenate((np.flatnonzero(np.diff(g, prepend=g[0] - 1)), [len(g)]))
        for low, high in zip(borders, borders[1:]):
            if component[low:high].min() == component[low:high].max():
                continue
            own = np.arange(high - low)
            left, right = own[side[low:high] == 0], own[side[low:high] == 1]
            right = right if len(right) else left
            common = _overlaps(sets[low:high], left, right)
            n, one = sizes[low:high], component[low:high]
            near = 100 * common >= percent * (n[left][:, None] + n[right][None, :] - common)
            i, j = np.nonzero(near & (one[left][:, None] != one[right][None, :]))
            ends = np.stack([node[low + left[i]], node[low + right[j]]])
            links = pa.RecordBatch.from_pydict({"u": pa.array(ends.max(axis=0), pa.int64()), "v": pa.array(ends.min(axis=0), pa.int64())})
            found += [pa.Table.from_batches([batch]) for batch in _stars([links])]
        return pa.concat_tables(found).rename_columns(["a", "b"])

    return sent.groupBy("bucket").applyInArrow(compare, "a long, b long")


def star_rows(stars: DataFrame, nodes: DataFrame) -> DataFrame:
    """Groups of a centre and a block of the nodes around it; the centre is in all of its blocks."""
    around = stars.select(F.col("a").alias("node"), F.col("b").alias("centre"))
    weighed = around.join(nodes.select("node", "n"), "node").groupBy("centre").agg(
        F.ceil(F.sum(F.col("n") + SET) / WEIGHT).cast("int").alias("blocks"))
    members = around.join(weighed, "centre").select("node", "centre", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("block"))
    centres = weighed.select(F.col("centre").alias("node"), "centre", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    return members.unionByName(centres).select(F.xxhash64("centre", "block").alias("g"), F.lit(0).alias("side"), "node", F.col("node").alias("component"))


def family_rows(belongs: DataFrame) -> DataFrame:
    """Groups of two blocks of a family, or of one with itself, that are not in one component. ``belongs``: node, n, component,
    family. A component that fills a block has blocks of its own, the others of a family share theirs."""
    open_ = belongs.groupBy("family").agg(F.min("component").alias("least"), F.max("component").alias("most")).where("least <> most").select("family")
    rows = belongs.join(open_, "family").withColumn("weight", F.col("n") + SET)
    full = rows.groupBy("family", "component").agg(F.sum("weight").alias("total")).where(F.col("total") >= WEIGHT).select(
        "family", "component", F.lit(True).alias("whole"))
    pooled = rows.join(full, ["family", "component"], "left").withColumn("whole", F.coalesce("whole", F.lit(False))).withColumn(
        "pool", F.when(F.col("whole"), F.xxhash64("family", "component")).otherwise(F.xxhash64("family")))
    pools = pooled.groupBy("family", "pool", "whole").agg(F.ceil(F.sum("weight") / WEIGHT).cast("int").alias("blocks"))
    placed = pooled.join(pools.select("pool", "blocks"), "pool").select(
        "node", "component", "pool", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("block"))
    blocks = pools.select("family", "pool", "whole", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    other = blocks.select("family", F.col("pool").alias("pool_b"), F.col("block").alias("block_b"))
    met = blocks.join(other, "family").where(
        (F.struct("pool", "block") <= F.struct(F.col("pool_b"), F.col("block_b"))) & ~(F.col("whole") & (F.col("pool") == F.col("pool_b")))
    ).withColumn("g", F.xxhash64("pool", "block", "pool_b", "block_b"))
    first = met.select("pool", "block", "g", F.lit(0).alias("side"))
    second = met.where("pool <> pool_b OR block <> block_b").select(F.col("pool_b").alias("pool"), F.col("block_b").alias("block"), "g", F.lit(1).alias("side"))
    return placed.join(first.unionByName(second), ["pool", "block"]).select("g", "side", "node", "component")


def similar(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    both = pairs.join(sets.toDF("a", "left"), "a").join(sets.toDF("b", "right"), "b").select("a", "b", "left", "right")

    def confirm(batches):
        for batch in batches:
            flags = []
            for x, y in zip(batch.column("left"), batch.column("right")):
                x, y = np.frombuffer(x.as_buffer(), "<u8"), np.frombuffer(y.as_buffer(), "<u8")
                small, large = (x, y) if len(x) <= len(y) else (y, x)
                at = np.minimum(np.searchsorted(large, small), len(large) - 1)
                common = int(np.count_nonzero(large[at] == small))
                flags.append(100 * common >= percent * (len(x) + len(y) - common))
            yield batch.select(["a", "b"]).filter(pa.array(flags, pa.bool_()))

    return both.mapInArrow(confirm, "a long, b long")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row for each row of ``docs``.

    ``percent`` may be larger than PERCENT, for which the match threshold is set, but not smaller."""
    if percent < PERCENT:
        raise ValueError(f"the match threshold is set for {PERCENT} percent or more")
    ensure_checkpoints(docs.sparkSession)
    rows = signed(docs, doc_id, text, shingle).checkpoint()
    nodes = rows.where("node IS NOT NULL").groupBy("node").agg(
        F.first("n").alias("n"), F.first("signature").alias("signature"), F.min(F.struct("id", "text_key")).alias("one")
    ).select("node", "n", "signature", "one.*").checkpoint()
    posted = postings(nodes).checkpoint()

    drawn = matching(nodes, centre_pairs(posted, percent)).checkpoint()
    stars = drawn.groupBy("a").agg(F.max(F.struct("matches", "b")).alias("best")).select("a", F.col("best.b").alias("b"))
    sets = full_sets(docs, nodes, drawn.select(F.explode(F.array("a", "b")).alias("node")), doc_id, text, shingle)
    links = block_links(star_rows(stars, nodes), sets, percent).checkpoint()
    belongs = components(drawn).withColumnRenamed("component", "family").join(components(links), "node", "left").join(
        nodes.select("node", "n"), "node").withColumn("component", F.coalesce("component", "node")).checkpoint()
    links = links.unionByName(block_links(family_rows(belongs), sets, percent))

    # a family is named by one of its nodes, so single nodes can be named by themselves
    pairs, dense = merged_pairs(posted.join(belongs.select("node", "family"), "node", "left").withColumn("component", F.coalesce("family", "node")), percent)
    across = matching(nodes, pairs).select("a", "b").unionByName(block_pairs(dense.join(nodes.select("node", "signature"), "node"), percent)).distinct().checkpoint()
    others = full_sets(docs, nodes, across.select(F.explode(F.array("a", "b")).alias("node")), doc_id, text, shingle)
    found = components(links.unionByName(similar(across, others, percent)).checkpoint())

    least = rows.where("node IS NOT NULL").groupBy("node").agg(F.min("doc_id").alias("least")).join(found, "node", "left").withColumn(
        "component", F.coalesce("component", "node"))
    named = least.groupBy("component").agg(F.min("least").alias("component_id"))
    members = least.join(named, "component").select("node", "component_id")
    return rows.select("doc_id", "n", "node").join(members, "node", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
    ).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
