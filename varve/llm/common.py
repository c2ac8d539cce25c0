"""Helpers shared by the operators: Arrow slices of whole texts, words, hashes, checkpoints.

Inside tasks, texts are handled as UTF-8 bytes in numpy arrays. A batch is cut into slices of a
few MB of text, so the arrays of one slice bound a task's memory; a longer text is a slice alone.
"""

from __future__ import annotations

import hashlib
import tempfile
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SLICE_BYTES = 4 << 20

#: Odd multipliers of the polynomial hashes over bytes and over words.
BYTE_BASE = 0x9E3779B97F4A7C15
WORD_BASE = 0xC2B2AE3D27D4EB4F
MASK = (1 << 64) - 1


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def id_and_bytes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """The id as ``doc_id`` and the text as UTF-8 bytes, a null text as no bytes. Other columns go,
    but those named in ``carry`` stay as the fields of a struct ``carried``."""
    return docs.select(
        F.col(doc_id).cast("long").alias("doc_id"),
        F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary").alias("data"),
        *([F.struct(*carry).alias("carried")] if carry else []),
    )


def ensure_checkpoints(spark: SparkSession) -> None:
    """Use the folder that the session names; only a local session without one gets its own."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not context.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
            folder = tempfile.mkdtemp(prefix="varve-llm-")
        context.setCheckpointDir(folder)


def partitions(spark: SparkSession) -> int:
    """How many parts the session deals a shuffle to."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def fold(column: Column, modulus: int) -> Column:
    """crc32 of the decimal id, by which rows are held out; a null id counts as the empty text."""
    return F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")) % modulus


class Slice:
    """Consecutive texts of one batch: ids, and their bytes end to end."""

    def __init__(self, ids: list, offsets: np.ndarray, data: np.ndarray):
        self.ids = ids
        self.offsets = offsets  # len(ids) + 1, from 0
        self.data = data

    def __len__(self) -> int:
        return len(self.ids)

    @property
    def lengths(self) -> np.ndarray:
        return np.diff(self.offsets)

    def text(self, k: int) -> bytes:
        return self.data[self.offsets[k]:self.offsets[k + 1]].tobytes()


def slices(batch, size: int = SLICE_BYTES, ids: str = "doc_id", data: str = "data") -> Iterator[Slice]:
    """Cut a record batch at text borders into slices of about ``size`` bytes."""
    column = batch.column(batch.schema.get_field_index(data))
    keys = batch.column(batch.schema.get_field_index(ids)).to_pylist()
    count = len(column)
    if not count:
        return
    buffers = column.buffers()
    width = np.int64 if str(column.type).startswith("large") else np.int32
    offsets = np.frombuffer(buffers[1], dtype=width)[column.offset:column.offset + count + 1].astype(np.int64)
    flat = np.frombuffer(buffers[2], dtype=np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    begin = 0
    while begin < count:
        end = int(np.searchsorted(offsets, offsets[begin] + size, side="right")) - 1
        end = min(count, max(begin + 1, end))
        low, high = offsets[begin], offsets[end]
        yield Slice(keys[begin:end], offsets[begin:end + 1] - low, flat[low:high])
        begin = end


_BLANK = np.zeros(256, dtype=bool)
_BLANK[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def lowered(data: np.ndarray) -> np.ndarray:
    """A-Z in lower case; every other byte as it is."""
    return _LOWER[data]


def word_spans(piece: Slice, inside: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of a slice, and the index of each word's text.

    A word never crosses from one text to the next. ``inside`` flags the bytes of words, if they are
    not just those between blanks.
    """
    inside = ~_BLANK[piece.data] if inside is None else inside
    borders = np.zeros(len(inside) + 1, dtype=bool)
    borders[piece.offsets] = True
    starts = inside.copy()
    starts[1:] &= ~inside[:-1] | borders[1:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | borders[1:-1]
    begin = np.flatnonzero(starts)
    owner = np.searchsorted(piece.offsets, begin, side="right") - 1
    return begin, np.flatnonzero(ends) + 1, owner


def mixed(values: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every bit over all of them."""
    out = values ^ (values >> np.uint64(30))
    out *= np.uint64(0xBF58476D1CE4E5B9)
    out ^= out >> np.uint64(27)
    out *= np.uint64(0x94D049BB133111EB)
    out ^= out >> np.uint64(31)
    return out


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, count: int) -> tuple[np.ndarray, np.ndarray]:
    """base**k and base**-k modulo 2**64 for k < count."""
    have = _POWERS.get(base)
    if have is None or len(have[0]) < count:
        size = max(1 << 16, 1 << (count - 1).bit_length())
        both = []
        for b in (base, pow(base, -1, 1 << 64)):
            table = np.full(size, b, dtype=np.uint64)
            table[0] = 1
            both.append(np.multiply.accumulate(table))
        have = _POWERS[base] = (both[0], both[1])
    return have[0][:count], have[1][:count]


def spread_bytes() -> np.ndarray:
    """A fixed 64-bit value for each byte value."""
    return mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(BYTE_BASE))


def span_sums(values: np.ndarray, base: int) -> np.ndarray:
    """What ``spans_of`` needs to hash any run of ``values``."""
    sums = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values * powers(base, len(values) + 1)[0][:-1], out=sums[1:])
    return sums


def spans_of(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    """The polynomial hashes of ``values[start:end]`` from their ``span_sums``."""
    out = (sums[ends] - sums[starts]) * powers(base, len(sums))[1][starts]
    return mixed(out + (ends - starts).astype(np.uint64))


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    """Polynomial hashes of ``values[start:end]``, equal for equal runs wherever they stand."""
    return spans_of(span_sums(values, base), starts, ends, base)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return span_hashes(spread_bytes()[data], starts, ends, BYTE_BASE)


def windows(values: np.ndarray, owner: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions at which ``length`` consecutive values of one text start, and their hashes."""
    if len(values) < length:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    at = np.flatnonzero(owner[length - 1:] == owner[:len(owner) - length + 1])
    return at, span_hashes(values, at, at + length, WORD_BASE)


def covered(size: int, starts: np.ndarray, length) -> np.ndarray:
    """Which of ``size`` places lie in one of the runs from ``starts``."""
    edge = np.zeros(size + 1, dtype=np.int32)
    np.add.at(edge, starts, 1)
    np.add.at(edge, np.minimum(starts + length, size), -1)
    return np.cumsum(edge[:-1]) > 0


def runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True."""
    step = np.diff(np.concatenate(([0], mask.view(np.int8), [0])))
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)


def chunked_word_hashes(data: np.ndarray, size: int = SLICE_BYTES) -> Iterator[np.ndarray]:
    """Hashes of the words of one text in their order, about ``size`` bytes of text at a time.

    Equal to ``word_hashes``, but that a word of more than ``size`` bytes stands alone and is hashed
    by blake2b, so no array of 64-bit values is longer than ``size``."""
    starts, ends = runs(~_BLANK[data])
    begin = 0
    while begin < len(starts):
        end = max(begin + 1, int(np.searchsorted(ends, starts[begin] + size, side="right")))
        part = data[starts[begin]:ends[end - 1]]
        if len(part) > size:
            yield np.frombuffer(hashlib.blake2b(part, digest_size=8).digest(), np.uint64)
        else:
            yield word_hashes(part, starts[begin:end] - starts[begin], ends[begin:end] - starts[begin])
        begin = end


def per_text(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many bytes of each text are flagged."""
    if len(offsets) == 2:
        return np.array([np.count_nonzero(flags)], np.int64)
    sums = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=sums[1:])
    return np.diff(sums[offsets])
