"""Substring dedup of word sequences by fixed-block anchors.

Every document is indexed by its non-overlapping blocks of half a window: any window contains one
whole block. All rolling windows of block length probe that index; where one hits, the match is
extended over the windows around it, as far as whole windows are equal, which gives the maximal
exact repeats of at least a window. A passage in very many documents has one entry for each slice
of documents, and no pairs are made: a window asks only whether a smaller id has it.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from varve.llm.common import Slice, covered, windows, word_hashes, word_spans
from varve.llm.sliced import (
    ANSWER, NO_ID, answered, deal, in_smaller, pack_ids, seen_twice, send, short_keys, slice_of,
)

WINDOW = 50


class Anchors:
    """The windows of one slice of documents."""

    def __init__(self, part: Slice, window: int):
        self.part, self.window, self.block = part, window, window // 2
        self.starts, self.ends, self.owner = word_spans(part)
        self.hashes = word_hashes(part.data, self.starts, self.ends)
        self.first = np.searchsorted(self.owner, np.arange(len(part) + 1))

    def probes(self):
        """Distinct hashes of all rolling windows of block length, which of them are blocks of the
        index, which occur twice, and for each place its window's number."""
        at, hashes = windows(self.hashes, self.owner, self.block)
        keys, group, times = np.unique(hashes, return_inverse=True, return_counts=True)
        whole = (at - self.first[self.owner[at]]) % self.block == 0
        indexed = np.bincount(group, weights=whole, minlength=len(keys)) > 0
        return keys, indexed, times > 1, at, group

    def extended(self, hit: np.ndarray, at: np.ndarray):
        """Whole windows that hold a hit: distinct hashes, the smallest id with each, and for each
        window its place, hash number and id."""
        marks = np.zeros(len(self.hashes) + 1, dtype=np.int64)
        marks[at[hit] + 1] = 1
        marks = np.cumsum(marks)
        places, hashes = windows(self.hashes, self.owner, self.window)
        wanted = marks[places + self.window - self.block + 1] > marks[places]
        places, hashes = places[wanted], hashes[wanted]
        keys, least, group = np.unique(hashes, return_index=True, return_inverse=True)
        ids = self.part.ids[self.owner[places]]
        return keys, ids[least], places, group, ids


def dedup(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, keep: bool = True,
) -> DataFrame:
    """Per row: doc_id, n_words, n_removed, kept_sha256, and with ``keep`` kept (the words left).

    Words are runs of other characters than space, tab and line ends. A word goes if it lies in a
    window of ``window`` words that also starts in a row with a smaller id. A null text has no
    words; a null id counts as larger than any other; rows with the same id leave each other alone
    and stay as they are; an empty table gives no rows; other columns are not read.
    """
    dealt, buckets = deal(docs, doc_id, text)

    def ask_index(table: pa.Table) -> pa.Table:
        own = Anchors(slice_of(table), window)
        keys, indexed, twice, _, _ = own.probes()
        short = short_keys(keys, twice, indexed)
        return send(table.column("s")[0].as_py(), keys, buckets, {"keys": lambda row: short[row].tobytes()})

    def ask_windows(table: pa.Table, replies: pa.Table) -> pa.Table:
        if not table.num_rows or not replies.num_rows:
            return pa.table({n: pa.array([], t) for n, t in (("b", pa.int32()), ("s", pa.int32()), ("keys", pa.binary()), ("ids", pa.binary()))})
        own = Anchors(slice_of(table), window)
        keys, _, _, at, group = own.probes()
        found, least, *_ = own.extended(answered(replies, 1, keys, buckets)[group], at)

        def by_id(row):
            return row[np.argsort(least[row], kind="stable")]

        return send(table.column("s")[0].as_py(), found, buckets, {
            "keys": lambda row: found[by_id(row)].tobytes(), "ids": lambda row: pack_ids(least[by_id(row)]),
        })

    def remove(table: pa.Table, replies: pa.Table) -> pa.Table:
        if not table.num_rows:
            return pa.table({n: pa.array([], t) for n, t in (("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.string()))[:5 if keep else 4]})
        own = Anchors(slice_of(table), window)
        gone = np.zeros(len(own.hashes), dtype=bool)
        if replies.num_rows:
            keys, _, _, at, group = own.probes()
            found, least, places, group, ids = own.extended(answered(replies, 1, keys, buckets)[group], at)
            # the bits came in the order of ids within each bucket
            order = np.argsort(least, kind="stable")
            smaller = np.zeros(len(found), dtype=bool)
            smaller[order] = answered(replies, 2, found[order], buckets)
            gone = covered(len(own.hashes), places[smaller[group] | (ids > least[group])], window)
        part, digests, texts = own.part, [], []
        for k in range(len(part)):
            words = part.text(k).split()
            out = gone[own.first[k]:own.first[k + 1]]
            if out.any():
                words = [word for word, drop in zip(words, out) if not drop]
            kept = b" ".join(words)
            digests.append(hashlib.sha256(kept).hexdigest())
            if keep:
                texts.append(kept.decode("utf-8", "replace"))
        removed = np.add.reduceat(np.concatenate((gone, [False])).astype(np.int64), own.first[:-1]) if len(gone) else np.zeros(len(part), np.int64)
        counts = np.diff(own.first)
        columns = {
            "doc_id": pa.array(part.ids, pa.int64(), mask=part.ids == NO_ID), "n_words": pa.array(counts, pa.int64()),
            "n_removed": pa.array(np.where(counts > 0, removed, 0), pa.int64()), "kept_sha256": pa.array(digests, pa.string()),
        }
        if keep:
            columns["kept"] = pa.array(texts, pa.string())
        return pa.table(columns)

    # One plan: the texts are dealt once, all three visits to them read the same exchange.
    hits = dealt.groupBy("s").applyInArrow(ask_index, "b int, s int, keys binary").groupBy("b").applyInArrow(seen_twice, ANSWER)
    repeats = (
        dealt.groupBy("s").cogroup(hits.groupBy("s")).applyInArrow(ask_windows, "b int, s int, keys binary, ids binary")
        .groupBy("b").applyInArrow(in_smaller, ANSWER)
    )
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + (", kept string" if keep else "")
    return dealt.groupBy("s").cogroup(hits.unionByName(repeats).groupBy("s")).applyInArrow(remove, schema)
