"""Spelling variants of the corpus vocabulary, by search schemes over a bidirectional FM-index.

The vocabulary is the runs of letters of all texts, counted. Two words are near if one code point inserted,
deleted or replaced makes one from the other. Whatever the error, one half of the word stands in both, at its start
or at its end. So two searches find every near word: one matches the first half exactly from the word's start
and extends to the right across the second, the other matches the second half from the word's end and extends to
the left across the first, and each allows one error on the way. The two directions of the index are two
suffix orders over the delimited vocabulary: of the reversed words, in which a backward step extends to the right,
and of the words, in which it extends to the left. A state of a search is an interval of suffix ranks; all words of a group
take their steps together in numpy.

Half of a word of seven code points or more holds its first or last three, so words are dealt to groups by those: near
words meet in at least one group. Groups are filled up to ``SHARD`` words by hash of the three. Where more words than that
share them, they are dealt over several indexes by hash, and every one of them visits each: the index of a group is
bounded, and no match is lost.

The form of a word is its most frequent near word, if ten times as frequent as the word; forms are followed to
the last one by doubling steps, whose number comes from the largest count, for every step multiplies the count by ten.

Nulls and ties: a null text has no words; a null id counts as the empty text before the colon. Equal rows count each.
Of near words with equal counts the smallest in code-point order is the form. An empty table gives no rows; other columns are
ignored. A long text is read in parts of a few MB. A word is a unit: its index takes about 60 bytes for
each code point, so a single run of letters may have some ten million code points in a task of 1 GB.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varve.llm.common import SLICE_BYTES, Slice, ensure_checkpoints, id_and_bytes, lowered, partitions, slices, word_hashes, word_spans

#: A run's hash divisible by this loses a code point.
NOISE = 31
LEAST_LENGTH, LEAST_COUNT, RATIO = 7, 2, 10
#: Code points by which words are dealt, words of an index, and words that search it at a time.
EDGE, SHARD, AT_ONCE = 3, 1 << 15, 1 << 12

_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
#: The lead byte of U+00C0 to U+00FF and of no other letter.
_LEAD = 0xC3


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = (table >> np.uint32(1)) ^ (np.uint32(0xEDB88320) * (table & np.uint32(1)))
    return table


_CRC = _crc_table()


def crc32_of(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, begun: np.ndarray) -> np.ndarray:
    """crc32 of each ``data[start:end]``, continued from the crc32 values ``begun``; 64 bytes of all runs in steps, the
    rest of longer ones one by one."""
    lengths = ends - starts
    order = np.argsort(-lengths, kind="stable")
    at, state = starts[order], begun[order].astype(np.uint32) ^ np.uint32(0xFFFFFFFF)
    longer = np.searchsorted(-lengths[order], -np.arange(1, 65), side="right")  # runs with that many bytes or more
    for step, count in enumerate(longer):
        if not count:
            break
        own = state[:count]
        state[:count] = (own >> np.uint32(8)) ^ _CRC[(own ^ data[at[:count] + step]) & np.uint32(255)]
    out = np.empty(len(starts), np.uint32)
    out[order] = state ^ np.uint32(0xFFFFFFFF)
    for k in np.flatnonzero(lengths > 64):
        out[k] = zlib.crc32(data[starts[k] + 64:ends[k]], int(out[k]))
    return out


def _counted(part: Slice) -> tuple[list[bytes], np.ndarray]:
    """Words of at least LEAST_LENGTH code points and how often a slice has them; a word may come up twice."""
    lead = part.data == _LEAD
    inside = _LETTER[part.data] | lead
    inside[1:] |= lead[:-1]
    all_starts, all_ends, all_owner = word_spans(part, inside)
    kept = all_ends - all_starts >= LEAST_LENGTH  # bytes, so at least as many as code points
    all_starts, all_ends, all_owner = all_starts[kept], all_ends[kept], all_owner[kept]
    begun = np.array([zlib.crc32(f"{'' if i is None else i}:".encode()) for i in part.ids], np.uint32)
    words: list[bytes] = []
    times: list[np.ndarray] = []
    begin = 0
    while begin < len(all_starts):
        low = int(all_starts[begin])
        end = max(begin + 1, int(np.searchsorted(all_ends, low + SLICE_BYTES, side="right")))
        data = lowered(part.data[low:all_ends[end - 1]])
        starts, ends, owner = all_starts[begin:end] - low, all_ends[begin:end] - low, all_owner[begin:end]
        begin = end
        points = np.zeros(len(data) + 1, np.int32)
        np.cumsum(data != _LEAD, out=points[1:])
        points = points[ends] - points[starts]
        wanted = points >= LEAST_LENGTH
        starts, ends, owner, points = starts[wanted], ends[wanted], owner[wanted], points[wanted]
        noise = crc32_of(data, starts, ends, begun[owner])
        hit = noise % NOISE == 0
        for a, b, h, n in zip(starts[hit], ends[hit], noise[hit], points[hit]):
            if n > LEAST_LENGTH:
                run, at = data[a:b].tobytes().decode(), int(h) % int(n)
                words.append((run[:at] + run[at + 1:]).encode())
                times.append(np.ones(1, np.int64))
        starts, ends = starts[~hit], ends[~hit]
        _, first, count = np.unique(word_hashes(data, starts, ends), return_index=True, return_counts=True)
        words += [data[a:b].tobytes() for a, b in zip(starts[first], ends[first])]
        times.append(count)
    return words, np.concatenate([*times, np.zeros(0, np.int64)])


def vocabulary(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """word, n: the words with at least LEAST_LENGTH code points and LEAST_COUNT occurrences over all texts."""

    def count(batches):
        for batch in batches:
            for part in slices(batch):
                words, times = _counted(part)
                yield pa.RecordBatch.from_arrays([pa.array(words, pa.binary()).cast(pa.string()), pa.array(times, pa.int64())], ["word", "n"])

    found = id_and_bytes(docs, doc_id, text).mapInArrow(count, "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT)


class Index:
    """One direction of the FM-index: suffix ranks over words, each ended by the delimiter 0.

    ``codes`` holds the words reversed, end to end, with a delimiter before each and after the last, so that a backward step
    extends a match to the right. Suffixes compare up to their delimiter, and then by position.
    """

    def __init__(self, codes: np.ndarray):
        size = len(codes)
        borders = np.flatnonzero(codes == 0)
        end = borders[np.searchsorted(borders, np.arange(size))]
        rank, width = codes.astype(np.int64), 1
        while width <= int(np.diff(borders).max(initial=0)):
            nxt = np.arange(size) + width
            further = nxt <= end
            key = rank * (size + 2)
            key[further] += rank[nxt[further]] + 1
            _, rank = np.unique(key, return_inverse=True)
            width *= 2
        order = np.argsort(rank, kind="stable")
        self.before = codes[order - 1].astype(np.int64)  # the character before each suffix, the last one before the first
        ranked = np.argsort(self.before, kind="stable")
        self.size, self.order, self.borders = size, order, borders
        #: (character, rank) of all ranks in order: the place of (c, i) in it is the rank to which a step by c leads.
        self.steps = self.before[ranked] * size + ranked
        self.letters = int(codes.max(initial=0))

    def step(self, c: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of the matches extended by ``c``."""
        return np.searchsorted(self.steps, c * self.size + low), np.searchsorted(self.steps, c * self.size + high)

    def branches(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """State number and character of every extension by a letter: the letters before the ranks of
        an interval, or all letters where it has more ranks than there are letters."""
        sizes = high - low
        few = np.flatnonzero(sizes <= self.letters)
        many = np.flatnonzero(sizes > self.letters)
        state = np.repeat(few, sizes[few])
        within = np.arange(len(state)) - np.repeat(np.cumsum(sizes[few]) - sizes[few], sizes[few])
        pairs = np.unique(state * (self.letters + 1) + self.before[low[state] + within])
        state, c = pairs // (self.letters + 1), pairs % (self.letters + 1)
        state = np.concatenate((state[c > 0], np.repeat(many, self.letters)))
        return state, np.concatenate((c[c > 0], np.tile(np.arange(1, self.letters + 1), len(many))))

    def words(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """State number and word number of the whole words among the matches: those after a delimiter."""
        first, last = self.step(np.zeros(len(low), np.int64), low, high)
        state = np.repeat(np.arange(len(low)), last - first)
        within = np.arange(len(state)) - np.repeat(np.cumsum(last - first) - (last - first), last - first)
        # such a suffix starts behind a delimiter, and the delimiter's number is that of the word
        return state, np.searchsorted(self.borders, self.order[self.steps[first[state] + within]]) - 1


def one_error(index: Index, words: np.ndarray, lengths: np.ndarray, exact: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of each word (a padded row of ``words``) and of the indexed words that begin with its first ``exact``
    code points and differ by exactly one error in the rest; a pair may come up twice."""
    low = np.zeros(len(words), np.int64)
    high = np.full(len(words), len(index.borders), np.int64)
    for place in range(int(exact.max(initial=0))):
        own = np.flatnonzero((place < exact) & (low < high))
        low[own], high[own] = index.step(words[own, place], low[own], high[own])
    alive = np.flatnonzero(low < high)
    query, place, low, high = alive, exact[alive], low[alive], high[alive]
    wrong: list[tuple] = []  # states behind their error
    while len(query):
        state, c = index.branches(low, high)
        to_low, to_high = index.step(c, low[state], high[state])
        open_ = place < lengths[query]
        wrong.append((query[state], place[state], to_low, to_high))  # the other word has one more
        other = open_[state] & (c != words[query[state], np.minimum(place[state], words.shape[1] - 1)])
        wrong.append((query[state][other], place[state][other] + 1, to_low[other], to_high[other]))
        query, place, low, high = query[open_], place[open_], low[open_], high[open_]
        wrong.append((query, place + 1, low, high))  # the other word lacks this one
        low, high = index.step(words[query, place], low, high)
        alive = low < high
        query, place, low, high = query[alive], place[alive] + 1, low[alive], high[alive]
    if not wrong:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    query, place, low, high = (np.concatenate(parts) for parts in zip(*wrong))
    while True:
        alive = low < high
        query, place, low, high = query[alive], place[alive], low[alive], high[alive]
        on = np.flatnonzero(place < lengths[query])
        if not len(on):
            break
        low[on], high[on] = index.step(words[query[on], place[on]], low[on], high[on])
        place[on] += 1
    state, word = index.words(low, high)
    return query[state], word


def search(table: pa.Table) -> pa.Table:
    """The near words that one group finds: its rows are words as they are read (reversed on side 1), and those with
    ``indexed`` make up the index."""
    words, side = table.column("word").to_pylist(), table.column("side").to_numpy()
    count, indexed = table.column("n").to_numpy(), table.column("indexed").to_numpy(zero_copy_only=False)
    lengths = np.array([len(w) for w in words], np.int64)
    letters = np.frombuffer("".join(words).encode("utf-32-le"), "<u4")
    _, code = np.unique(letters, return_inverse=True)
    code, begin = code + 1, np.cumsum(lengths) - lengths
    out: list[tuple] = []
    for which in (0, 1):
        held, asking = np.flatnonzero(indexed & (side == which)), np.flatnonzero(side == which)
        if not len(held):
            continue
        text = np.concatenate([part for k in held for part in ([0], code[begin[k]:begin[k] + lengths[k]][::-1])] + [[0]])
        index = Index(text)
        for some in range(0, len(asking), AT_ONCE):
            rows = asking[some:some + AT_ONCE]
            width = int(lengths[rows].max())
            padded = np.zeros((len(rows), width), np.int64)
            filled = np.arange(width) < lengths[rows][:, None]
            padded[filled] = np.concatenate([code[begin[k]:begin[k] + lengths[k]] for k in rows])
            half = lengths[rows] // 2
            query, word = one_error(index, padded, lengths[rows], half if which == 0 else lengths[rows] - half)
            pairs = np.unique(query * len(held) + word)
            out += [(rows[q], held[w]) for q, w in zip(pairs // len(held), pairs % len(held))]
    turned = [w[::-1] if s else w for w, s in zip(words, side)]
    return pa.table({
        "word": pa.array([turned[a] for a, _ in out], pa.string()), "near": pa.array([turned[b] for _, b in out], pa.string()),
        "near_n": pa.array([count[b] for _, b in out], pa.int64()),
    })


def near_words(words: DataFrame) -> DataFrame:
    """word, near, near_n: every pair of near words, both ways, of a table of distinct words and their counts n."""
    spark = words.sparkSession
    both = words.select("n", F.inline(F.array(
        F.struct(F.lit(0).alias("side"), F.col("word")), F.struct(F.lit(1).alias("side"), F.reverse("word").alias("word")),
    ))).withColumn("edge", F.left("word", F.lit(EDGE)))
    total = 2 * words.count()
    groups = max(4 * total // SHARD + 1, min(partitions(spark), total // 1024 + 1))
    crowded = both.groupBy("side", "edge").count().where(F.col("count") > SHARD).select(
        "side", "edge", F.ceil(F.col("count") / SHARD).cast("int").alias("indexes")
    )
    placed = both.join(crowded, ["side", "edge"], "left").withColumn("home", F.pmod(F.xxhash64("word"), F.coalesce("indexes", F.lit(1))))
    dealt = placed.select(
        "word", "n", "side", "edge", "home", "indexes", F.explode(F.sequence(F.lit(0), F.coalesce("indexes", F.lit(1)) - 1)).alias("at")
    ).select(
        "word", "n", "side", (F.col("at") == F.col("home")).alias("indexed"),
        F.when(F.col("indexes").isNull(), F.pmod(F.xxhash64("side", "edge"), F.lit(groups))).otherwise(F.xxhash64("side", "edge", "at")).alias("g"),
    )
    found = dealt.groupBy("g").applyInArrow(search, "word string, near string, near_n long")
    return found.groupBy("word", "near").agg(F.first("near_n").alias("near_n"))


def variants(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", ratio: int = RATIO) -> DataFrame:
    """word, form, root, n, n_near, form_n: a row for each word of the vocabulary of ``docs``."""
    ensure_checkpoints(docs.sparkSession)
    words = vocabulary(docs, doc_id, text).checkpoint()
    best = near_words(words).groupBy("word").agg(
        F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("minus"), F.col("near"))).alias("best")
    )
    named = words.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
        F.when(-F.col("best.minus") >= ratio * F.col("n"), F.struct(F.col("best.near").alias("form"), (-F.col("best.minus")).alias("n"))).alias("form"),
    ).checkpoint()
    roots = named.where("form IS NOT NULL").select("word", F.col("form.form").alias("root"))
    largest = words.agg(F.max("n")).first()[0] or 1
    longest = int(math.log(max(1, largest / LEAST_COUNT), ratio)) + 1  # forms in a row
    for _ in range(max(0, math.ceil(math.log2(longest)))):
        onward = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        roots = roots.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root")).checkpoint()
    return named.join(roots, "word", "left").select(
        "word", F.col("form.form").alias("form"), F.coalesce("root", "word").alias("root"), "n", "n_near", F.col("form.n").alias("form_n"),
    )
