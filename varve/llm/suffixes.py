"""Substring dedup of bytes by suffixes at a difference cover.

Places whose number in their document, modulo 31, is in the cover {1, 5, 11, 24, 25, 27} are sampled:
whatever two places are compared, some offset under 31 leads from both to sampled ones. So two equal
strings of 50 bytes hold sampled tuples of 20 bytes at the same offset. Three steps follow.

1. Sampled tuples of the corpus are sorted and named in key buckets. A suffix whose tuple is unique is
   in its final place and has no equal; it is discarded.
2. The suffixes around the remaining samples are merged: those with the same least tuple in their first
   50 bytes meet in one bucket, as runs of text (neighbours overlap, so a run of k suffixes is k + 49
   bytes), and are sorted by the hash of those bytes.
3. Adjacent equal prefixes are compared: a suffix learns whether a smaller id has the same 50 bytes.

A tuple that stands in a common line is the least of many suffixes, and all of them meet. Step 1 also
counts the suffixes of each bucket, and those of a bucket with over ``OVER`` are dealt one by one, as
hashes of their 50 bytes: what all slices share is then one number for each slice, the rest is spread.

Order beyond 50 bytes is never asked for, so names are not made into a string to sort again: the
recursion ends at its first level.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from varve.llm.common import BYTE_BASE, Slice, covered, mixed, powers, runs, span_hashes, span_sums, spans_of, spread_bytes
from varve.llm.sliced import (
    ANSWER, NO_ID, answer, answered, bucket_of, bucket_order, deal, pack_ids, seen_twice, send, short_keys, slice_of, unpack_ids,
)

LENGTH = 50
# A difference cover modulo 31: every residue is the difference of two members.
PERIOD = 31
COVER = (1, 5, 11, 24, 25, 27)
#: Bytes of text for a bucket on the average at most; suffixes of a bucket that may meet there as runs of text.
MOST, OVER = 4 << 20, 8 << 20
#: Bytes of text that are hashed at a time, suffixes that are compared at a time, and places that are weighed at a time.
STEP, ROUND, STRETCH = 1 << 20, 1 << 19, 1 << 15


def _spread(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for each run."""
    begins = np.cumsum(counts) - counts
    return np.arange(counts.sum()) + np.repeat(starts - begins, counts)


def _least(tuples: np.ndarray, count: int, span: int) -> np.ndarray:
    """The least of ``span`` tuples in a row from each of the first ``count``, of which ``tuples`` is overwritten."""
    width = 1
    while 2 * width <= span:
        tuples[:-width] = np.minimum(tuples[:-width], tuples[width:])
        width *= 2
    return np.minimum(tuples[:count], tuples[span - width:span - width + count])


def _distinct(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first place of each distinct hash, rising, and for each hash the number of its like."""
    _, chosen, group = np.unique(hashes, return_index=True, return_inverse=True)
    order = np.argsort(chosen, kind="stable")
    rank = np.empty_like(order)
    rank[order] = np.arange(len(order))
    return chosen[order], rank[group]


class Suffixes:
    """The suffixes of one slice of documents."""

    def __init__(self, part: Slice, length: int):
        self.part, self.length, self.tuple, self.size = part, length, length - PERIOD + 1, len(part.data)
        self.sums = span_sums(spread_bytes()[part.data], BYTE_BASE)

    def hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return spans_of(self.sums, starts, ends, BYTE_BASE)

    def ids_at(self, places: np.ndarray) -> np.ndarray:
        return self.part.ids[np.searchsorted(self.part.offsets, places, side="right") - 1]

    def samples(self):
        """Distinct tuple hashes, which occur twice, and for each sampled place its tuple's number."""
        lengths = self.part.lengths
        local = np.arange(self.size) - np.repeat(self.part.offsets[:-1], lengths)
        wanted = np.isin(np.arange(PERIOD), COVER)[local % PERIOD] & (local + self.tuple <= np.repeat(lengths, lengths))
        at = np.flatnonzero(wanted)
        keys, group, times = np.unique(self.hashes(at, at + self.tuple), return_inverse=True, return_counts=True)
        return keys, times > 1, at, group

    def short(self) -> np.ndarray:
        """Flags of the places after which fewer than ``length`` bytes of the text are left."""
        out = np.zeros(self.size, dtype=bool)
        tails = np.minimum(self.part.lengths, self.length - 1)
        out[_spread(self.part.offsets[1:] - tails, tails)] = True
        return out

    def least_tuples(self, places: np.ndarray, count: int) -> np.ndarray:
        """Least tuple in the first ``length`` bytes of the suffix at each of the first ``count`` places."""
        room = places + self.tuple <= self.size
        tuples = np.full(len(places) + 2 * PERIOD, np.iinfo(np.uint64).max)
        tuples[:len(places)][room] = self.hashes(places[room], places[room] + self.tuple)
        return _least(tuples, count, PERIOD)

    def weights(self, buckets: int) -> np.ndarray:
        """How many suffixes have their least tuple in each bucket, whether or not they will be merged."""
        out, whole = np.zeros(buckets, np.int64), ~self.short()
        sums, back, width = self.sums, powers(BYTE_BASE, len(self.sums))[1], np.uint64(self.tuple)
        for begin in range(0, self.size, STRETCH):
            end = min(begin + STRETCH, self.size)
            last = min(end + PERIOD - 1, self.size - self.tuple + 1)
            tuples = np.full(end - begin + 2 * PERIOD, np.iinfo(np.uint64).max)
            if last > begin:
                tuples[:last - begin] = mixed((sums[begin + self.tuple:last + self.tuple] - sums[begin:last]) * back[begin:last] + width)
            least = _least(tuples, end - begin, PERIOD)[whole[begin:end]]
            if len(least):
                first = np.flatnonzero(np.concatenate(([True], least[1:] != least[:-1])))
                np.add.at(out, bucket_of(least[first], buckets), np.diff(first, append=len(least)))
        return out

    def merged(self, hit: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least tuple and place of the suffixes that hold a sampled tuple of those hit in their first ``length`` bytes."""
        size, span = self.size, PERIOD
        marks = np.zeros(size + span + 1, dtype=np.int32)
        marks[at[hit] + 1] = 1
        marks = np.cumsum(marks)
        usable = np.zeros(size + span, dtype=bool)
        usable[:size] = (marks[span:span + size] > marks[:size]) & ~self.short()
        begin, end = runs(usable)
        # over the stretches that hold suffixes to merge
        stretch = np.minimum(end - begin + span - 1, size - begin)
        places = _spread(begin, stretch)
        mine = _spread(np.cumsum(stretch) - stretch, end - begin)
        return self.least_tuples(places, len(places))[mine], places[mine]

    def in_runs(self, key: np.ndarray, place: np.ndarray):
        """Runs of merged suffixes with the same least tuple, side by side.

        Returns distinct runs (first place, number of suffixes, id, bucket key) in the order of
        their ids, and all runs (first place, number of the distinct run, id)."""
        if not len(place):
            empty = np.zeros(0, np.int64)
            return (empty, empty, empty, np.zeros(0, np.uint64)), (empty, empty, empty)
        first = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]) | (place[1:] != place[:-1] + 1))))
        count = np.diff(np.concatenate((first, [len(place)])))
        start, key = place[first], key[first]
        ids = self.ids_at(start)
        # the slice is sorted by id, so the first has the least
        chosen, group = _distinct(self.hashes(start, start + count + self.length - 1))
        return (start[chosen], count[chosen], ids[chosen], key[chosen]), (start, group, ids)

    def one_by_one(self, place: np.ndarray):
        """Distinct hashes of the first ``length`` bytes of merged suffixes, and their ids, which rise;
        for each suffix the number of its hash, and its id."""
        hashes, ids = self.hashes(place, place + self.length), self.ids_at(place)
        chosen, group = _distinct(hashes)
        return (hashes[chosen], ids[chosen]), (group, ids)


def _named(table: pa.Table, over: int) -> pa.Table:
    """Stage 1: which tuples occur twice. Stage 0: a row for each slice that asks, if the bucket has over ``over`` suffixes."""
    names = seen_twice(table)
    if sum(table.column("n").to_pylist()) <= over:
        return names
    return pa.concat_tables([names, answer(table, [0] * table.num_rows, np.zeros(0, bool), 0)])


def _split(replies: pa.Table, key: np.ndarray, buckets: int) -> np.ndarray:
    """Which suffixes are of a bucket with too many of them, by their least tuples."""
    out = np.zeros(buckets, dtype=bool)
    out[[b for stage, b in zip(*(replies.column(n).to_pylist() for n in ("stage", "b"))) if stage == 0]] = True
    return out[bucket_of(key, buckets)]


def _smaller(table: pa.Table, length: int) -> pa.Table:
    """Which suffixes of a bucket have an equal prefix with a smaller id, whether they came as runs of
    text (stage 2) or as hashes (stage 3). Only their hashes are held, and compared part by part."""
    stages = table.column("stage").to_pylist()
    counts = [np.frombuffer(cell, "<u4").astype(np.int64) for cell in table.column("counts").to_pylist()]
    sizes = [int(count.sum()) for count in counts]
    ids = np.concatenate([unpack_ids(cell) for cell in table.column("ids").to_pylist()])
    total = sum(sizes)
    rounds = min(total // ROUND + 1, 1 << 16)
    hashes, parts, at = np.empty(total, np.uint64), np.empty(total, np.uint16), 0
    texts, held, read = [], [], 0
    for k, (stage, cell) in enumerate(zip(stages, table.column("text"))):
        if stage == 3:
            found = [np.frombuffer(cell.as_py(), "<u8")]
        else:
            texts.append(zlib.decompress(cell.as_py()))
            held.append(counts[k])
            read += len(texts[-1])
            found = []
        if texts and (stage == 3 or read >= STEP or k + 1 == len(stages)):
            count = np.concatenate(held)
            places = _spread(np.cumsum(count + length - 1) - (count + length - 1), count)
            values = spread_bytes()[np.frombuffer(b"".join(texts), np.uint8)]
            found.insert(0, span_hashes(values, places, places + length, BYTE_BASE))
            texts, held, read = [], [], 0
        for some in found:
            hashes[at:at + len(some)] = some
            parts[at:at + len(some)] = (some >> np.uint64(48)) * np.uint64(rounds) >> np.uint64(16)
            at += len(some)
    ends = np.cumsum(np.concatenate(counts))
    smaller = np.zeros(total, dtype=bool)
    for k in range(rounds):
        own = np.flatnonzero(parts == k)
        _, group = np.unique(hashes[own], return_inverse=True)
        from_id = ids[np.searchsorted(ends, own, side="right")]
        least = np.full(group.max(initial=-1) + 1, NO_ID)
        np.minimum.at(least, group, from_id)
        smaller[own] = least[group] < from_id
    return answer(table, sizes, smaller, stages)


def dedup(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH, keep: bool = True,
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans, kept_sha256, with ``keep`` kept (the text left,
    without the rest of a character that was cut) and carried (a struct of the columns in ``carry``).

    A byte goes if a string of ``length`` bytes over it also starts in a row with a smaller id; a
    span is a maximal run of such bytes. A null text is empty; a null id counts as larger than any
    other; rows with the same id leave each other alone and stay as they are; an empty table gives
    no rows; other columns than those
    in ``carry`` are not read.
    """
    if length < PERIOD + 8:
        raise ValueError(f"length must be {PERIOD + 8} or more")
    dealt, buckets = deal(docs, doc_id, text, carry=carry, most=MOST)
    over = OVER
    asked = (
        ("b", pa.int32()), ("s", pa.int32()), ("text", pa.binary()), ("counts", pa.binary()), ("ids", pa.binary()), ("stage", pa.int32()),
    )
    shown = [
        ("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()),
        ("kept_sha256", pa.string()), ("kept", pa.string()),
    ][:6 if keep else 5]

    def empty(columns) -> pa.Table:
        return pa.table({name: pa.array([], kind) for name, kind in columns})

    def ask_names(table: pa.Table) -> pa.Table:
        own = Suffixes(slice_of(table), length)
        keys, twice, _, _ = own.samples()
        short, weights = short_keys(keys, twice), own.weights(buckets)
        out = send(table.column("s")[0].as_py(), keys, buckets, {"keys": lambda row: short[row].tobytes()}, weights > 0)
        return out.append_column("n", pa.array(weights[out.column("b").to_numpy()], pa.int64()))

    def ask_prefixes(table: pa.Table, replies: pa.Table) -> pa.Table:
        if not table.num_rows or not replies.num_rows:
            return empty(asked)
        s, own = table.column("s")[0].as_py(), Suffixes(slice_of(table), length)
        keys, _, at, group = own.samples()
        key, place = own.merged(answered(replies, 1, keys, buckets)[group], at)
        split = _split(replies, key, buckets)
        (start, count, ids, key), _ = own.in_runs(key[~split], place[~split])
        (hashes, own_ids), _ = own.one_by_one(place[split])
        sent = [
            send(s, key, buckets, {
                "text": lambda row: zlib.compress(own.part.data[_spread(start[row], count[row] + length - 1)].tobytes(), 1),
                "counts": lambda row: count[row].astype("<u4").tobytes(),
                "ids": lambda row: pack_ids(ids[row]),
            }),
            send(s, hashes, buckets, {
                "text": lambda row: hashes[row].astype("<u8").tobytes(),
                "counts": lambda row: np.ones(len(row), "<u4").tobytes(),
                "ids": lambda row: pack_ids(own_ids[row]),
            }),
        ]
        return pa.concat_tables([
            out.append_column("stage", pa.array(np.full(out.num_rows, stage), pa.int32())) for stage, out in zip((2, 3), sent)
        ])

    def remove(table: pa.Table, replies: pa.Table) -> pa.Table:
        if not table.num_rows:
            return empty(shown if not carry else [*shown, ("carried", table.schema.field("carried").type)])
        own = Suffixes(slice_of(table), length)
        part = own.part
        gone = np.zeros(len(part.data), dtype=bool)
        if replies.num_rows:
            keys, _, at, group = own.samples()
            key, place = own.merged(answered(replies, 1, keys, buckets)[group], at)
            split = _split(replies, key, buckets)
            single = place[split]
            (hashes, least), (alike, single_id) = own.one_by_one(single)
            single = single[answered(replies, 3, hashes, buckets)[alike] | (single_id > least[alike])]
            (_, count, ids, key), (place, distinct, own_id) = own.in_runs(key[~split], place[~split])
            begins = np.cumsum(count) - count
            smaller = np.zeros(int(count.sum()), dtype=bool)
            order, bounds = bucket_order(key, buckets)
            for stage, b, bits in zip(*(replies.column(n).to_pylist() for n in ("stage", "b", "bits"))):
                if stage == 2:
                    row = order[bounds[b]:bounds[b + 1]]
                    to = _spread(begins[row], count[row])
                    smaller[to] = np.unpackbits(np.frombuffer(bits, np.uint8), count=len(to)).astype(bool)
            each = count[distinct]
            flags = smaller[_spread(begins[distinct], each)] | np.repeat(own_id > ids[distinct], each)
            gone = covered(len(gone), np.concatenate((_spread(place, each)[flags], single)), length)
        removed, spans, digests, texts = [], [], [], []
        for k in range(len(part)):
            out = gone[part.offsets[k]:part.offsets[k + 1]]
            data = part.data[part.offsets[k]:part.offsets[k + 1]]
            count = int(out.sum())
            kept = (data[~out] if count else data).tobytes()
            removed.append(count)
            spans.append(len(runs(out)[0]) if count else 0)
            digests.append(hashlib.sha256(kept).hexdigest())
            if keep:
                texts.append(kept.decode("utf-8", "ignore"))
        values = [part.ids, part.lengths, removed, spans, digests, texts]
        columns = {name: pa.array(value, kind) for (name, kind), value in zip(shown, values)}
        columns["doc_id"] = pa.array(part.ids, pa.int64(), mask=part.ids == NO_ID)
        if carry:
            columns["carried"] = table.column("carried").take(part.order)
        return pa.table(columns)

    # One plan: the texts are dealt once, all three visits to them read the same exchange.
    names = (
        dealt.groupBy("s").applyInArrow(ask_names, "b int, s int, keys binary, n long")
        .groupBy("b").applyInArrow(lambda table: _named(table, over), ANSWER)
    )
    prefixes = (
        dealt.groupBy("s").cogroup(names.groupBy("s")).applyInArrow(ask_prefixes, "b int, s int, text binary, counts binary, ids binary, stage int")
        .groupBy("b").applyInArrow(lambda table: _smaller(table, length), ANSWER)
    )
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept string" if keep else "")
    if carry:
        schema += f", carried {dealt.schema['carried'].dataType.simpleString()}"
    return dealt.groupBy("s").cogroup(names.unionByName(prefixes).groupBy("s")).applyInArrow(remove, schema)
