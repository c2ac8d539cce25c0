"""Best-two-fit packing of tokenized documents into fixed-length sequences.

Documents with the same length are alike to a packer, so the plan is made from the number of
pieces of each length: at most ``size`` numbers, whatever the input. The plan says how many
sequences hold which lengths; each piece then finds its place from its rank among those of its
length. Ranks come from counts by (length, salt), so a length that very many pieces share is
numbered by many tasks.
"""

from __future__ import annotations

import re
import sys
import zlib
from array import array
from bisect import bisect_right
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from varve.llm.chunk_cache import ENTRIES, ChunkCache
from varve.llm.common import ensure_checkpoints, id_and_bytes, partitions, slices

SIZE = 2048

#: The pre-tokenizer never joins a space to what stands before it, unless that is white space.
AFTER_BLANK = re.compile(r"\s ")
BORDER = re.compile(r"(?<=\S)(?= \S)")


def chunks(text: str) -> list[str]:
    """A text cut where no token can cross; joined, the chunks are the text."""
    if AFTER_BLANK.search(text):
        return BORDER.split(text)
    first, *rest = text.split(" ")
    return [first, *[" " + part for part in rest]]


#: A space, letters of European languages and stops: two words for the merges, without a pre-tokenizer.
PLAIN = re.compile(r" ([A-Za-z\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u024F]+)([.,;:!?]*)")


def byte_characters() -> dict[int, str]:
    """The character by which a byte-level vocabulary shows each byte: itself if it is printable,
    else the next one from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}


def packed(ids: list[int]) -> bytes:
    """Little-endian unsigned 32-bit numbers."""
    own = array("I", ids)
    if sys.byteorder == "big":
        own.byteswap()
    return own.tobytes()


class Encoder:
    """Little-endian ids of chunks; plain ones go straight to the tokenizer's merges."""

    def __init__(self, tokenizer_file: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one core for each task
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(tokenizer_file)
        self.whole.no_truncation()
        self.whole.no_padding()
        self.merge = self.whole.model.tokenize
        self.characters = byte_characters()
        self.space = self.characters[32]

    def plain(self, letters: str, stops: str) -> bytes:
        if not letters.isascii():
            letters = letters.encode().decode("latin-1").translate(self.characters)
        tokens = self.merge(self.space + letters)
        return packed([t.id for t in (tokens + self.merge(stops) if stops else tokens)])

    def encode(self, chunks: list[str]) -> dict[str, bytes]:
        out, rest = {}, []
        for chunk in chunks:
            match = PLAIN.fullmatch(chunk)
            if match:
                out[chunk] = self.plain(*match.groups())
            else:
                rest.append(chunk)
        for chunk, found in zip(rest, self.whole.encode_batch_fast(rest, add_special_tokens=False)):
            out[chunk] = packed(found.ids)
        return out


def tokenize(
    docs: DataFrame, tokenizer_file: str, size: int = SIZE, end_id: int = 0, doc_id: str = "doc_id",
    text: str = "text", entries: int = ENTRIES, keep_ids: bool = True,
) -> DataFrame:
    """Pieces of the documents' ids, each document ended by ``end_id``.

    Columns: doc_id, piece, start, length, ids_crc32, and with ``keep_ids`` ids. A document longer
    than ``size`` is cut so that only its first piece may be shorter.
    """
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long"
    if keep_ids:
        schema += ", ids array<int>"

    def run(batches):
        encoder = Encoder(tokenizer_file)
        cache = ChunkCache(encoder.encode, entries)  # little-endian ids of each distinct chunk
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            for part in slices(batch):
                parts = [chunks(part.text(k).decode("utf-8", "replace")) for k in range(len(part))]
                ids_of = cache.known(set().union(*parts)).__getitem__
                rows: dict[str, list] = {name.split()[0]: [] for name in schema.split(", ")}
                for key, chunk in zip(part.ids, parts):
                    ids = b"".join(map(ids_of, chunk)) + end
                    count = len(ids) // 4
                    first = (count - 1) % size + 1
                    for piece, stop in enumerate(range(first, count + 1, size)):
                        start = max(0, stop - size)
                        own = ids[4 * start:4 * stop]
                        rows["doc_id"].append(key)
                        rows["piece"].append(piece)
                        rows["start"].append(start)
                        rows["length"].append(stop - start)
                        rows["ids_crc32"].append(zlib.crc32(own))
                        if keep_ids:
                            rows["ids"].append(np.frombuffer(own, "<u4").astype(np.int32))
                kinds = {"piece": pa.int32(), "ids": pa.list_(pa.int32())}
                yield pa.RecordBatch.from_pydict(
                    {name: pa.array(values, kinds.get(name, pa.int64())) for name, values in rows.items()}
                )

    return id_and_bytes(docs, doc_id, text).mapInArrow(run, schema)


class Place(NamedTuple):
    """Pieces of one length from rank ``first`` on fill sequences from ``sequence`` on, ``each`` in
    every one of them, one after the other from ``offset``."""

    length: int
    first: int
    count: int
    sequence: int
    each: int
    offset: int


def _fill(free: np.ndarray, size: int) -> dict[int, int]:
    """Lengths of one sequence: the longest that fits, again and again; then the smallest is
    exchanged for the two left that fill the space best, if they fill more than it did."""
    have = np.flatnonzero(free).tolist()
    chosen: dict[int, int] = {}
    gap = size
    upto = bisect_right(have, gap)
    while upto:
        length = have[upto - 1]
        take = min(int(free[length]), gap // length)
        if take:
            chosen[length] = take
            gap -= take * length
        upto = min(upto - 1, bisect_right(have, gap))
    if gap and chosen:
        least = min(chosen)
        space = gap + least
        left = free.copy()
        for length, used in chosen.items():
            left[length] -= used
        lengths = np.flatnonzero(left[:space] > 0)
        if len(lengths):
            longest = np.zeros(space + 1, dtype=np.int64)
            longest[lengths] = lengths
            longest = np.maximum.accumulate(longest)
            mate = longest[space - lengths]
            same = (mate == lengths) & (left[lengths] < 2)
            mate[same] = longest[np.maximum(lengths[same] - 1, 0)]
            total = np.where(mate > 0, lengths + mate, 0)
            best = int(np.argmax(total))
            if total[best] > least:
                chosen[least] -= 1
                for length in (int(lengths[best]), int(mate[best])):
                    chosen[length] = chosen.get(length, 0) + 1
                chosen = {length: used for length, used in chosen.items() if used}
    return chosen


def plan(counts: dict[int, int], size: int = SIZE) -> list[Place]:
    """Best-two-fit over the number of pieces of each length.

    A filling is used for as many sequences as the counts allow, after which one of its lengths is
    too scarce for another; that happens to a length at most once for each number of times it fits
    into a sequence, so there are fewer than size * (1 + ln size) fillings for any input.
    """
    free = np.zeros(size + 1, dtype=np.int64)
    for length, count in counts.items():
        free[length] = count
    used = np.zeros_like(free)
    places: list[Place] = []
    sequence = 0
    while free.any():
        filling = _fill(free, size)
        times = min(int(free[length]) // each for length, each in filling.items())
        offset = 0
        for length in sorted(filling, reverse=True):
            each = filling[length]
            places.append(Place(length, int(used[length]), times * each, sequence, each, offset))
            used[length] += times * each
            free[length] -= times * each
            offset += each * length
        sequence += times
    return places


def ranked(pieces: DataFrame) -> DataFrame:
    """``pieces`` with ``rank``: 0, 1, 2 ... among those of the same length."""
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(partitions(pieces.sparkSession))).cast("int"))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    counts = salted.groupBy("length", "salt").count().select(
        "length", "salt", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("before")
    )
    within = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "start", "ids_crc32")
    numbered = salted.withColumn("number", F.row_number().over(within) - 1)
    return numbered.join(counts, ["length", "salt"]).withColumn("rank", F.col("before") + F.col("number")).drop("salt", "before", "number")


def pack(
    docs: DataFrame, tokenizer_file: str, size: int = SIZE, end_id: int = 0, doc_id: str = "doc_id",
    text: str = "text", keep_ids: bool = True,
) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids).

    Every document's ids are followed by ``end_id``; a null or empty text is that id alone. Only
    documents of over ``size`` ids are cut. A null id stays null, repeated rows are packed each,
    equal lengths go by id, an empty table gives no rows, and other columns are not read.
    """
    ensure_checkpoints(docs.sparkSession)
    # tokenized once: the plan needs all lengths before the first piece has a place
    pieces = tokenize(docs, tokenizer_file, size, end_id, doc_id, text, keep_ids=keep_ids).checkpoint()
    counts = {row["length"]: row["count"] for row in pieces.groupBy("length").count().collect()}  # at most size rows
    columns = np.array(plan(counts, size), dtype=np.int64).reshape(-1, len(Place._fields))
    columns = columns[np.lexsort((columns[:, 1], columns[:, 0]))]
    # (length, first rank) as one growing number, for a search by halving
    step = int(columns[:, 1].max(initial=0) + columns[:, 2].max(initial=0) + 1)
    starts = columns[:, 0] * step + columns[:, 1]

    def place(frames):
        for frame in frames:
            if frame.empty:
                continue
            at = np.searchsorted(starts, frame["length"].to_numpy() * step + frame["rank"].to_numpy(), side="right") - 1
            own = columns[at]
            nth = frame["rank"].to_numpy() - own[:, 1]
            frame = frame.drop(columns="rank")
            frame["sequence_id"] = own[:, 3] + nth // own[:, 4]
            frame["offset"] = own[:, 5] + nth % own[:, 4] * own[:, 0]
            yield pd.DataFrame(frame)

    names = ["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if keep_ids else [])]
    ready = ranked(pieces).select(*names, "rank")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ready.schema if f.name != "rank")
    return ready.mapInPandas(place, f"{schema}, sequence_id long, offset long")
