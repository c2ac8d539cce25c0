"""Questions that slices of a corpus put to key buckets, in packed form.

Documents are dealt into slices of a few MB by a hash of id and text. A slice sends the keys of its
windows to buckets by key, as one packed row for each bucket, every distinct key once however often
the slice holds it. A bucket sees all occurrences of its keys over the corpus and answers each row
with one bit per key, in the order in which they came. A slice is sorted by id and text, so it finds
its keys in the same order again when the answers arrive: neither positions nor ids travel along.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varve.llm.common import Slice, id_and_bytes, partitions, slices

#: Bytes of a slice, and of what makes a slice or a bucket worth its while.
SLICE, LEAST = 2 << 20, 1 << 18
#: Buckets for each partition: one bucket at a time is in memory.
BUCKETS = 4
#: Stands for a null id in comparisons: larger than any other.
NO_ID = (1 << 63) - 1


def deal(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = SLICE, carry: tuple[str, ...] = (),
    parts: int | None = None, most: int | None = None,
) -> tuple[DataFrame, int]:
    """s, doc_id, data: whole texts with the number of their slice; and carried, a struct of the
    columns named in ``carry``, if any. Also returns how many key buckets to use.

    Slices hold about ``size`` bytes, less where there would be fewer than partitions, but not under
    ``LEAST``; ``parts`` stands for the session's number of partitions if it is given. With ``most``, there are so many
    buckets that each gets that many bytes of text on the average at most. So packed rows, one for each slice and bucket, stay far fewer than keys."""
    rows = id_and_bytes(docs, doc_id, text, carry).withColumn("doc_id", F.coalesce("doc_id", F.lit(NO_ID)))
    total = rows.agg(F.sum(F.octet_length("data"))).first()[0] or 0
    parts, fill = parts or partitions(docs.sparkSession), total // LEAST + 1
    count = max(total // size + 1, min(parts, fill))
    dealt = rows.withColumn("s", F.pmod(F.xxhash64("doc_id", "data"), F.lit(count)).cast("int"))
    return dealt, max(min(BUCKETS * parts, fill), total // most + 1 if most else 0)


def slice_of(table: pa.Table) -> Slice:
    """The rows of a slice as one, sorted by id and text."""
    order = pc.sort_indices(table, sort_keys=[("doc_id", "ascending"), ("data", "ascending")])
    batch = table.select(["doc_id", "data"]).take(order).combine_chunks().to_batches()[0]
    whole = next(slices(batch, size=1 << 62))
    whole.ids = np.array(whole.ids, dtype=np.int64)
    whole.order = order
    return whole


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket of each key."""
    return ((keys & np.uint64(0xFFFFFFFF)) % np.uint64(buckets)).astype(np.uint16 if buckets < 1 << 16 else np.uint32)


def bucket_order(keys: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """An order of the keys by bucket, and where each bucket begins in it."""
    bucket = bucket_of(keys, buckets)
    return np.argsort(bucket, kind="stable"), np.concatenate(([0], np.cumsum(np.bincount(bucket, minlength=buckets))))


def send(
    s: int, keys: np.ndarray, buckets: int, packed: dict[str, Callable[[np.ndarray], bytes]], also: np.ndarray | None = None,
) -> pa.Table:
    """One row for each bucket that gets a key or is flagged in ``also``: b, s, and what ``packed`` makes of its key numbers."""
    order, bounds = bucket_order(keys, buckets)
    filled = np.flatnonzero(np.diff(bounds) if also is None else (np.diff(bounds) > 0) | also)
    rows = [order[bounds[b]:bounds[b + 1]] for b in filled]
    return pa.table({
        "b": pa.array(filled, pa.int32()), "s": pa.array(np.full(len(filled), s), pa.int32()),
        **{name: pa.array([pack(row) for row in rows], pa.binary()) for name, pack in packed.items()},
    })


def answer(table: pa.Table, counts: list[int], flags: np.ndarray, stage: int) -> pa.Table:
    """Bits for the rows of a bucket."""
    cuts = np.cumsum(counts)[:-1]
    return pa.table({
        "s": table.column("s"), "stage": pa.array(np.full(len(counts), stage), pa.int32()), "b": table.column("b"),
        "bits": pa.array([np.packbits(part).tobytes() for part in np.split(flags, cuts)], pa.binary()),
    })


ANSWER = "s int, stage int, b int, bits binary"


def answered(replies: pa.Table, stage: int, keys: np.ndarray, buckets: int) -> np.ndarray:
    """The bit of each key of a slice."""
    out = np.zeros(len(keys), dtype=bool)
    order, bounds = bucket_order(keys, buckets)
    for at, b, bits in zip(*(replies.column(n).to_pylist() for n in ("stage", "b", "bits"))):
        if at == stage:
            own = order[bounds[b]:bounds[b + 1]]
            out[own] = np.unpackbits(np.frombuffer(bits, np.uint8), count=len(own)).astype(bool)
    return out


def cells(table: pa.Table, name: str, kind) -> tuple[np.ndarray, list[int]]:
    """The packed numbers of a column end to end, and how many each row has."""
    parts = [np.frombuffer(cell, kind) for cell in table.column(name).to_pylist()]
    return np.concatenate(parts), [len(part) for part in parts]


def seen_twice(table: pa.Table) -> pa.Table:
    """Stage 1: which keys occur twice or more. The lowest bit of a key says that its slice has it
    twice, the next that it may be matched at all. 30 bits of each key travel and the bucket adds
    its own, so a few keys are taken for others; what follows compares whole keys."""
    keys, counts = cells(table, "keys", "<u4")
    _, group = np.unique(keys >> 2, return_inverse=True)
    times = np.bincount(group, weights=1 + (keys & 1))
    able = np.bincount(group, weights=(keys >> 1) & 1)
    return answer(table, counts, ((times >= 2) & (able > 0))[group], 1)


def short_keys(keys: np.ndarray, twice: np.ndarray, able: np.ndarray | None = None) -> np.ndarray:
    high = (keys >> np.uint64(34)).astype(np.uint32) << np.uint32(2)
    high |= twice.astype(np.uint32)
    high |= np.uint32(2) if able is None else able.astype(np.uint32) << np.uint32(1)
    return high


def in_smaller(table: pa.Table) -> pa.Table:
    """Stage 2: which keys also occur with a smaller id, by whole keys of 64 bits."""
    keys, counts = cells(table, "keys", "<u8")
    ids = np.concatenate([unpack_ids(cell) for cell in table.column("ids").to_pylist()])
    _, group = np.unique(keys, return_inverse=True)
    least = np.full(group.max(initial=-1) + 1, NO_ID)
    np.minimum.at(least, group, ids)
    return answer(table, counts, least[group] < ids, 2)


def pack_ids(ids: np.ndarray) -> bytes:
    """Rising ids as differences, deflated."""
    import zlib

    return zlib.compress(np.diff(ids, prepend=0).astype("<i8").tobytes(), 1)


def unpack_ids(cell: bytes) -> np.ndarray:
    import zlib

    return np.cumsum(np.frombuffer(zlib.decompress(cell), "<i8"))
