"""Filter interaction audit: what each filter removes, in every order of the filters.

Every document becomes a row of facts: its part, a bit for each filter that it fails and its labels. The facts
are summed to mask cells, at most one for each part and set of failed filters. A recursive CTE then
starts from the empty prefix of each part and extends every prefix by each letter not yet in it, carries the
bits applied so far, joins the part's mask cells and emits the metrics of that step. Five levels give all
325 prefixes; an order is five of them, so a prefix that many orders share is counted once.

Filters: A under 200 words; B distinct words under half of the words; C over 2 % of the code points in A-Z;
D any of ``#$%&*|``; E the same text with a smaller id anywhere in the table, removed or not.

Nulls: a null text is empty, a null source the part ``''``; a null id counts as larger than all others and has no
labels. Rows of the same id and text are each documents, and neither is the other's copy. A document with
several rows of labels has a label if one of them says so. An empty table gives no rows. Other columns are
ignored, whatever their names. A long text is counted a few MB at a time.

The copies of a text meet as the smallest id only, combined before the exchange, and a row asks by its text and own id
whether it is that one; so neither a text nor a source that a third of all rows share makes a large group.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varve.llm.common import Slice, chunked_word_hashes, ensure_checkpoints, id_and_bytes, mixed, per_text, slices, word_hashes, word_spans
from varve.llm.sliced import NO_ID

LETTERS = "ABCDE"
BIT = {letter: 1 << k for k, letter in enumerate(LETTERS)}
LEAST_WORDS, DISTINCT_PERCENT, CAPITAL_PERCENT = 200, 50, 2
SYMBOLS = b"#$%&*|"
#: Longer texts are counted in parts.
LONG = 8 << 20

_CAPITAL, _SYMBOL = np.zeros(256, bool), np.zeros(256, bool)
_CAPITAL[65:91] = True
_SYMBOL[list(SYMBOLS)] = True


def _words(part: Slice) -> tuple[np.ndarray, np.ndarray]:
    """Words and distinct words of each text."""
    if len(part) == 1 and len(part.data) > LONG:
        count, seen = 0, np.zeros(0, np.uint64)
        for hashes in chunked_word_hashes(part.data):
            count += len(hashes)
            seen = np.union1d(seen, hashes)
        return np.array([count]), np.array([len(seen)])
    starts, ends, owner = word_spans(part)
    keys = mixed(word_hashes(part.data, starts, ends) + owner.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    _, first = np.unique(keys, return_index=True)
    return np.bincount(owner, minlength=len(part)), np.bincount(owner[first], minlength=len(part))


def _failed(part: Slice) -> np.ndarray:
    """Bits of the filters A to D that each text fails."""
    words, distinct = _words(part)
    points = per_text((part.data & 0xC0) != 0x80, part.offsets)
    capitals, symbols = per_text(_CAPITAL[part.data], part.offsets), per_text(_SYMBOL[part.data], part.offsets)
    return (
        (words < LEAST_WORDS) * BIT["A"] + (100 * distinct < DISTINCT_PERCENT * words) * BIT["B"]
        + (100 * capitals > CAPITAL_PERCENT * points) * BIT["C"] + (symbols > 0) * BIT["D"]
    ).astype(np.int32)


def facts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """doc_id (nulls as NO_ID), part, text_key (16 bytes of a hash of the text) and failed (bits of A to D)."""
    rows = id_and_bytes(
        docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.coalesce(F.col(source).cast("string"), F.lit("")).alias("part")),
        carry=("part",),
    )

    def measure(batches):
        for batch in batches:
            parts, done = batch.column("carried").field("part"), 0
            for part in slices(batch):
                yield pa.RecordBatch.from_pydict({
                    "doc_id": pa.array([NO_ID if i is None else i for i in part.ids], pa.int64()),
                    "part": parts.slice(done, len(part)),
                    "text_key": pa.array([hashlib.blake2b(part.data[a:b], digest_size=16).digest() for a, b in zip(part.offsets, part.offsets[1:])], pa.binary()),
                    "failed": pa.array(_failed(part), pa.int32()),
                })
                done += len(part)

    return rows.mapInArrow(measure, "doc_id long, part string, text_key binary, failed int")


def mask_cells(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """part, cells: for each part, at most 32 structs (mask, n, good, toxic) of documents that fail just the filters of the mask."""
    ensure_checkpoints(docs.sparkSession)
    marks = labels.groupBy("doc_id").agg(
        F.max(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("good"), F.max(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("toxic")
    ).where("doc_id IS NOT NULL")
    marked = facts(docs, doc_id, text, source).join(marks, "doc_id", "left").na.fill(0, ["good", "toxic"]).checkpoint()
    least = marked.groupBy("text_key").agg(F.min("doc_id").alias("doc_id"))
    first = marked.join(least, ["text_key", "doc_id"])
    # every row counts as a copy, and the first of a text is then moved to the same mask without E
    moves = marked.select("part", (F.col("failed") + BIT["E"]).alias("mask"), F.lit(1).alias("n"), "good", "toxic").unionByName(
        first.select("part", F.inline(F.array(*(
            F.struct((F.col("failed") + bit).alias("mask"), F.lit(sign).alias("n"), (sign * F.col("good")).alias("good"), (sign * F.col("toxic")).alias("toxic"))
            for bit, sign in ((BIT["E"], -1), (0, 1))
        ))))
    )
    cells = moves.groupBy("part", "mask").agg(*(F.sum(c).alias(c) for c in ("n", "good", "toxic"))).where("n > 0")
    return cells.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))


_ADDED = "aggregate(filter(c.cells, x -> {test}), 0L, (s, x) -> s + x.{what})"
_REMOVED = "(x.mask & p.applied) = 0 AND (x.mask & l.bit) <> 0"

PREFIXES = f"""
WITH RECURSIVE prefixes(part, filter_order, step, letter, applied, kept, removed, redundant, unique_fails, good_lost, toxic_lost) AS (
    SELECT part, '', 0, '', 0, 0L, 0L, 0L, 0L, 0L, 0L FROM {{cells}}
    UNION ALL
    SELECT p.part, concat(p.filter_order, l.letter), p.step + 1, l.letter, p.applied | l.bit,
        {_ADDED.format(test="(x.mask & (p.applied | l.bit)) = 0", what="n")},
        {_ADDED.format(test=_REMOVED, what="n")},
        {_ADDED.format(test="(x.mask & p.applied) <> 0 AND (x.mask & l.bit) <> 0", what="n")},
        {_ADDED.format(test="x.mask = l.bit", what="n")},
        {_ADDED.format(test=_REMOVED, what="good")},
        {_ADDED.format(test=_REMOVED, what="toxic")}
    FROM (
        SELECT *, explode(filter(array({', '.join(f"named_struct('letter', '{x}', 'bit', {BIT[x]})" for x in LETTERS)}),
                                 x -> instr(filter_order, x.letter) = 0)) AS l
        FROM prefixes WHERE step < {len(LETTERS)}
    ) AS p JOIN {{cells}} AS c ON c.part = p.part
)
SELECT * FROM prefixes WHERE step > 0
"""


def prefixes(cells: DataFrame) -> DataFrame:
    """The metrics of the last letter of every prefix of every order, for each part: 325 rows a part."""
    spark, limit = cells.sparkSession, "spark.sql.cteRecursionRowLimit"
    before = spark.conf.get(limit, None)
    spark.conf.set(limit, "-1")  # the limit counts rows, which grow with the number of parts; the levels are five
    try:
        return spark.sql(PREFIXES, cells=cells).checkpoint()
    finally:
        spark.conf.unset(limit) if before is None else spark.conf.set(limit, before)


def audit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley: one row for
    each part, order and step."""
    steps = prefixes(mask_cells(docs, labels, doc_id, text, source).checkpoint())
    metrics = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost"]
    last = len(LETTERS)
    # how many orders begin with a prefix
    orders = F.element_at(F.array(*(F.lit(n) for n in (24, 6, 2, 1, 1))), F.col("step"))
    shares = steps.groupBy("part", "letter").agg(F.sum(F.col("removed") * orders).alias("shapley"))
    full = steps.where(F.col("step") == last).select("part", "filter_order", F.explode(F.sequence(F.lit(1), F.lit(last))).alias("step"))
    placed = full.withColumn("prefix", F.expr("left(filter_order, step)")).withColumn("letter", F.expr("right(prefix, 1)"))
    return placed.join(steps.select("part", F.col("filter_order").alias("prefix"), *metrics), ["part", "prefix"]).join(shares, ["part", "letter"]).select(
        "part", "filter_order", "step", *metrics, "shapley"
    )
