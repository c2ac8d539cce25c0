"""Exact top-k by inner product with block-at-a-time pruning.

Vectors of small integers are put in an order that keeps like vectors together and cut into blocks
of a few. A block has a forward index (its vectors, dimension by dimension) and, for each of two
terms a dimension gives (its positive and its negative part), the largest value in the block. A
query's bound for a block is the sum of its weights times those maxima. Per query, blocks are
scored in falling order of their bounds until the next bound lies under its kth score.

Blocks travel in shards, queries in groups; every group meets every shard once. Scores are exact: in doubles where no
sum of a group and a shard can pass 2**53, else in 64-bit integers, and in unbounded ones where those could overflow.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from varve.llm.common import ensure_checkpoints, partitions

BLOCK, SHARD, GROUP = 64, 4096, 512
#: Vectors that give each query a first kth score, and the first of them that give the order.
SAMPLE, PIVOTS = 1024, 64
SCALE = 64


def whole_numbers(rows: DataFrame, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """vec_id, v (floor(SCALE * x) per component) and row, a number of its own for each row, for vectors of finite
    components only.

    A null id, a null vector and one with a null, NaN or infinite component are left out. Rows that share an id are
    rows of their own. Values are 64-bit integers; a component beyond them counts as the nearest one.
    """
    scaled = F.transform(vector, lambda x: F.floor(x.cast("double") * SCALE).cast("long"))
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    good = rows.where(F.col(vec_id).isNotNull() & F.col(vector).isNotNull()).where(~F.coalesce(bad, F.lit(False)))
    return good.select(F.col(vec_id).cast("long").alias("vec_id"), scaled.alias("v"), F.monotonically_increasing_id().alias("row"))


def _matrix(lists: pa.ListArray, width: int) -> np.ndarray:
    """Rows of a list column, padded with zeros."""
    lengths = np.asarray(lists.value_lengths())
    out = np.zeros((len(lists), width), np.int64)
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(lists)), lengths)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat
    return out


def _exact(*matrices: np.ndarray) -> tuple[type, object]:
    """The number type in which products of rows of the first with rows of the others are exact, and what is less than any of them."""
    most = [max((abs(int(edge)) for edge in (m.min(), m.max())), default=0) if m.size else 0 for m in matrices]
    largest = 2 * max(1, matrices[0].shape[1]) * most[0] * max(most[1:])
    if largest < 1 << 53:
        return float, -np.inf
    return (np.int64, np.iinfo(np.int64).min) if largest < 1 << 63 else (object, -np.inf)


def _packed(frame_size: int, width: int, name: str):
    """Rows to packed rows of up to ``frame_size`` (id, row number) pairs and vectors."""

    def run(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        ids, rows, held = [], [], 0

        def flush():
            return pa.RecordBatch.from_pydict({
                name: pa.array([part], pa.int32()),
                "ids": pa.array([np.concatenate(ids).tobytes()], pa.binary()),
                "data": pa.array([np.concatenate(rows).astype("<i8").tobytes()], pa.binary()),
            })

        for batch in batches:
            own = np.stack([batch.column("vec_id").to_numpy(), batch.column("row").to_numpy()], axis=1).astype("<i8")
            matrix = _matrix(batch.column("v"), width)
            while len(own):
                take = frame_size - held
                ids.append(own[:take])
                rows.append(matrix[:take])
                held += len(own[:take])
                own, matrix = own[take:], matrix[take:]
                if held == frame_size:
                    yield flush()
                    ids, rows, held = [], [], 0
        if held:
            yield flush()

    return run


def _products(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Matrix products; of unbounded integers each is held within 64 bits."""
    out = np.matmul(left, right)
    return np.minimum(np.maximum(out, -(1 << 63)), (1 << 63) - 1) if out.dtype == object else out


def search_shard(queries: np.ndarray, query_rows: np.ndarray, vectors: np.ndarray, ids: np.ndarray, rows: np.ndarray, floor: np.ndarray, k: int, none):
    """Best k of one shard per query among those that reach ``floor``: query index, place in the shard, score. Queries and vectors have
    a type in which their products are exact, and ``none`` is less than all of these."""
    blocks = -(-len(ids) // BLOCK)
    pad = blocks * BLOCK - len(ids)
    place = np.arange(blocks * BLOCK).reshape(blocks, BLOCK)
    real = place < len(ids)
    # the last vector once more in place of what is missing: bounds stay those of the block
    forward = np.concatenate([vectors, np.repeat(vectors[-1:], pad, axis=0)]).reshape(blocks, BLOCK, -1)
    own_ids, own_rows = (np.concatenate([own, np.repeat(own[-1:], pad)]).reshape(blocks, BLOCK) for own in (ids, rows))
    up, down = forward.max(axis=1), (-forward).max(axis=1)
    bounds = _products(np.concatenate([np.maximum(queries, 0), np.maximum(-queries, 0)], axis=1), np.concatenate([up, down], axis=1).T)
    order = np.argsort(-bounds, axis=1, kind="stable")
    count = len(queries)
    best = np.full((count, k), none, queries.dtype)
    best_ids, best_rows = (np.full((count, k), np.iinfo(np.int64).max) for _ in range(2))
    best_at = np.full((count, k), -1)
    active = np.arange(count)
    for step in range(blocks):
        block = order[active, step]
        kth = np.maximum(best[active, -1], floor[active])
        going = bounds[active, block] >= kth  # an equal score with a smaller id may still count
        active, block = active[going], block[going]
        if not len(active):
            break
        scores = _products(forward[block], queries[active][:, :, None])[:, :, 0]
        allowed = real[block] & (own_rows[block] != query_rows[active][:, None]) & (scores >= floor[active][:, None])
        scores = np.where(allowed, scores, np.array(none, queries.dtype))
        both = np.concatenate([best[active], scores], axis=1)
        parts = [np.concatenate([old[active], new[block]], axis=1) for old, new in ((best_ids, own_ids), (best_rows, own_rows), (best_at, place))]
        # ranks of the scores stand in for them, as unbounded integers are no sort key; what is not allowed comes last
        rank = -both if both.dtype != object else np.unique(-both, return_inverse=True)[1].reshape(both.shape)
        rank = np.where(both > none, rank, np.inf if rank.dtype == float else np.iinfo(np.int64).max)
        top = np.lexsort((parts[1], parts[0], rank), axis=1)[:, :k]
        best[active] = np.take_along_axis(both, top, axis=1)
        for held, part in zip((best_ids, best_rows, best_at), parts):
            held[active] = np.take_along_axis(part, top, axis=1)
    row, column = np.nonzero(best > none)
    return row, best_at[row, column], best[row, column]


def top_k(rows: DataFrame, k: int = 20, every: int = 20, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Per query (rows whose id is divisible by ``every``) its k best other rows: query_id, rank, vec_id, score.

    Equal scores go to the smaller id. A repeated id is a query, and a candidate, for each of its rows. A score beyond 64 bits
    counts as the nearest 64-bit number. With fewer than k others all are returned. Vectors of
    unequal length are compared as if padded with zeros; what takes part is said at
    ``whole_numbers``. An empty table gives no rows; other columns are not read.
    """
    spark = rows.sparkSession
    ensure_checkpoints(spark)
    parts = partitions(spark)
    vectors = whole_numbers(rows, vec_id, vector).checkpoint()
    width = vectors.agg(F.max(F.size("v"))).first()[0] or 1
    sample = vectors.orderBy(F.xxhash64("vec_id", "row"), "vec_id", "row").limit(SAMPLE).toArrow().combine_chunks()
    sample_numbers = sample.column("row").to_numpy() if len(sample) else np.zeros(0, np.int64)
    lists = sample.column("v").combine_chunks() if len(sample) else pa.array([], pa.list_(pa.int64()))
    if isinstance(lists, pa.ChunkedArray):
        lists = pa.concat_arrays(lists.chunks)
    sample_rows = _matrix(lists, width)

    def order(batches):
        pivots = sample_rows[:PIVOTS] / np.maximum(np.linalg.norm(sample_rows[:PIVOTS], axis=1, keepdims=True), 1)
        for batch in batches:
            near = np.argmax(_matrix(batch.column("v"), width) @ pivots.T, axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near, pa.int32())], ["vec_id", "v", "row", "pivot"])

    shards = (
        vectors.mapInArrow(order, "vec_id long, v array<long>, row long, pivot int")
        .repartitionByRange(parts, "pivot", "vec_id", "row").sortWithinPartitions("pivot", "vec_id", "row").select("vec_id", "v", "row")
        .mapInArrow(_packed(SHARD, width, "part"), "part int, ids binary, data binary")
    ).checkpoint()  # the numbers of the range partitions must not change
    asked = vectors.where(F.col("vec_id") % every == 0)
    groups = asked.mapInArrow(_packed(GROUP, width, "of"), "of int, ids binary, data binary").select(
        F.col("ids").alias("query_ids"), F.col("data").alias("queries"),
        F.explode(F.sequence(F.lit(0), F.lit(shards.rdd.getNumPartitions() - 1))).alias("part"),
    )

    def search(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                cell = lambda name: batch.column(name)[row].as_buffer()
                asked = np.frombuffer(cell("query_ids"), "<i8").reshape(-1, 2)
                held = np.frombuffer(cell("ids"), "<i8").reshape(-1, 2)
                queries, data = (np.frombuffer(cell(c), "<i8").reshape(len(own), width) for c, own in (("queries", asked), ("data", held)))
                kind, none = _exact(queries, data, sample_rows)
                queries, data = queries.astype(kind), data.astype(kind)
                floor = np.full(len(queries), none, queries.dtype)
                if len(sample_numbers) > k:
                    first = _products(queries, sample_rows.T.astype(kind))
                    first[asked[:, 1][:, None] == sample_numbers[None, :]] = none
                    sort = np.sort if kind is object else lambda m, axis: np.partition(m, len(sample_numbers) - k, axis)
                    floor = sort(first, axis=1)[:, len(sample_numbers) - k]
                at, found, score = search_shard(queries, asked[:, 1], data, held[:, 0], held[:, 1], floor, k, none)
                yield pa.RecordBatch.from_pydict({
                    "query_id": pa.array(asked[at, 0], pa.int64()), "query_row": pa.array(asked[at, 1], pa.int64()),
                    "vec_id": pa.array(held[found, 0], pa.int64()), "row": pa.array(held[found, 1], pa.int64()),
                    "score": pa.array(score.astype(np.int64), pa.int64()),
                })

    found = shards.join(groups, "part").select("query_ids", "queries", "ids", "data").mapInArrow(
        search, "query_id long, query_row long, vec_id long, row long, score long"
    )
    ranks = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id", "row")
    return found.withColumn("rank", F.row_number().over(ranks)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
