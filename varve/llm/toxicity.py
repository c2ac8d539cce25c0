"""Toxicity by a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

A text's features are the hashed byte n-grams it holds, each once, after lower-casing A-Z. A
sample of labelled texts, of bounded size, gives every n-gram the log ratio of its shares in both
classes; the n-grams that tell the classes apart best are kept, and logistic regression weighs
their ratios. Every text is then scored in whole by table look-ups.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varve.llm.common import ensure_checkpoints, fold, id_and_bytes, lowered, slices

GRAMS = (3, 4, 5, 6)
BITS = 20
#: About so many labelled rows are learnt from, by a hash of their id; all if there are fewer.
TRAIN_ROWS = 8_000
#: So many n-grams have a weight.
FEATURES = 4_096
LEAST_TEXTS = 4
PRIOR = 0.5
PENALTY = 0.02
STEPS = 400
#: Bytes of text whose n-grams are listed in whole at a time, and bytes scored at a time.
FIT_BYTES, SCORE_BYTES = 1 << 19, 1 << 21
THRESHOLD = 0.3
FOLDS, HELD_OUT = 4, 2


def gram_hashes(data: np.ndarray, length: int) -> np.ndarray:
    """A number under 2**BITS for the n-gram at each place."""
    count = max(0, len(data) - length + 1)
    out = np.full(count, length, dtype=np.uint32)
    for k in range(length):
        out *= np.uint32(0x01000193)
        out ^= data[k:k + count]
    out ^= out >> np.uint32(15)
    out *= np.uint32(0x85EBCA6B)
    return out >> np.uint32(32 - BITS)


def hits(part, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct pairs (text of the slice, n-gram) where ``wanted`` holds for the n-gram."""
    data = lowered(part.data)
    found = []
    for length in GRAMS:
        grams = gram_hashes(data, length)
        at = np.flatnonzero(wanted[grams])
        owner = np.searchsorted(part.offsets, at, side="right") - 1
        inside = at + length <= part.offsets[owner + 1]
        found.append(owner[inside] << BITS | grams[at[inside]].astype(np.int64))
    pairs = np.unique(np.concatenate(found))
    return pairs >> BITS, pairs & ((1 << BITS) - 1)


@dataclass
class Model:
    weights: np.ndarray  # by n-gram, 0 where it has none
    bias: float

    def logits(self, part) -> np.ndarray:
        owner, grams = hits(part, self.weights != 0)
        return self.bias + np.bincount(owner, weights=self.weights[grams], minlength=len(part))


def logistic(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(z / 2))


def regress(rows: np.ndarray, columns: np.ndarray, values: np.ndarray, target: np.ndarray, width: int) -> tuple[np.ndarray, float]:
    """Logistic regression with an L2 penalty over sparse features, by accelerated gradients."""
    count = len(target)
    weight, bias = np.zeros(width), float(np.log((target.sum() + 0.5) / (count - target.sum() + 0.5)))
    ahead, ahead_bias = weight.copy(), bias
    # a bound of the curvature: the largest squared norm of a row bounds that of the mean
    square = np.bincount(rows, weights=values * values, minlength=count)
    rate = 1.0 / (0.25 * (np.mean(square) + 1) + PENALTY)
    for step in range(1, STEPS + 1):
        z = ahead_bias + np.bincount(rows, weights=ahead[columns] * values, minlength=count)
        error = (logistic(z) - target) / count
        new = ahead - rate * (np.bincount(columns, weights=error[rows] * values, minlength=width) + PENALTY * ahead / width ** 0.5)
        new_bias = ahead_bias - rate * error.sum()
        push = (step - 1) / (step + 2)
        ahead, ahead_bias = new + push * (new - weight), new_bias + push * (new_bias - bias)
        weight, bias = new, new_bias
    return weight, bias


def fit(
    docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic",
    train_rows: int = TRAIN_ROWS, features: int = FEATURES,
) -> Model:
    """Learn from about ``train_rows`` labelled documents outside the held-out fold.

    A label that is neither 0 nor 1, or null, is left out; a document with both counts as 1.
    Without both classes there is nothing to learn: all scores are then the share of label 1.
    """
    spark = docs.sparkSession
    ensure_checkpoints(spark)
    known = labels.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(label).cast("int").alias("target")).where(
        F.col("doc_id").isNotNull() & F.col("target").isin(0, 1) & (fold(F.col("doc_id"), FOLDS) != HELD_OUT)
    ).groupBy("doc_id").agg(F.max("target").alias("target"))
    total = known.count()
    if total > train_rows:
        share = int(train_rows / total * (1 << 30))
        known = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < share)

    def present(batches):
        everything = np.ones(1 << BITS, dtype=bool)
        for batch in batches:
            targets = batch.column("target").to_numpy()
            begin = 0
            for part in slices(batch, FIT_BYTES):
                owner, grams = hits(part, everything)
                cuts = np.searchsorted(owner, np.arange(len(part) + 1))
                yield pa.RecordBatch.from_pydict({
                    "target": pa.array(targets[begin:begin + len(part)], pa.int32()),
                    "grams": pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(grams, pa.int32())),
                })
                begin += len(part)

    # the sample of labels has a bound, so it can go to every task; the texts stay where they are
    joined = id_and_bytes(docs, doc_id, text).join(F.broadcast(known), "doc_id")
    sample = joined.mapInArrow(present, "target int, grams array<int>").checkpoint()
    sizes = {row["target"]: row["count"] for row in sample.groupBy("target").count().collect()}
    no, yes = sizes.get(0, 0), sizes.get(1, 0)
    if not no or not yes:
        weights = np.zeros(1 << BITS)
        rate = min(max(yes / max(1, yes + no), 1e-6), 1 - 1e-6)
        return Model(weights, float(np.log(rate / (1 - rate))))
    counts = sample.select("target", F.explode("grams").alias("gram")).groupBy("gram").agg(
        F.sum("target").cast("double").alias("yes"), F.count("*").cast("double").alias("all")
    )
    ratio = F.log((F.col("yes") + PRIOR) / (yes + 2 * PRIOR)) - F.log((F.col("all") - F.col("yes") + PRIOR) / (no + 2 * PRIOR))
    expected = F.col("all") * (yes / (yes + no))
    # how far the count in class 1 lies from the expected, in standard deviations
    told = counts.where(F.col("all") >= LEAST_TEXTS).select(
        "gram", ratio.alias("ratio"), (F.abs(F.col("yes") - expected) / F.sqrt(expected)).alias("tells")
    )
    best = told.orderBy(F.desc("tells"), "gram").limit(features).collect()
    index = np.full(1 << BITS, -1, dtype=np.int64)
    ratios = np.zeros(len(best))
    for k, row in enumerate(best):
        index[row["gram"]] = k
        ratios[k] = row["ratio"]

    def only(batches):
        for batch in batches:
            lists = batch.column("grams")
            flat = index[lists.flatten().to_numpy()]
            sums = np.concatenate(([0], np.cumsum(flat >= 0)))
            offsets = lists.offsets.to_numpy()
            yield pa.RecordBatch.from_pydict({
                "target": batch.column("target"),
                "own": pa.ListArray.from_arrays(pa.array(sums[offsets - offsets[0]], pa.int32()), pa.array(flat[flat >= 0], pa.int32())),
            })

    # train_rows rows of at most ``features`` numbers
    table = sample.mapInArrow(only, "target int, own array<int>").toArrow()
    own = table.column("own").combine_chunks()
    if isinstance(own, pa.ChunkedArray):
        own = pa.concat_arrays(own.chunks)
    columns = own.flatten().to_numpy()
    rows = np.repeat(np.arange(len(own)), np.diff(own.offsets.to_numpy()))
    target = table.column("target").to_numpy().astype(float)
    weight, bias = regress(rows, columns, ratios[columns], target, len(best))
    weights = np.zeros(1 << BITS)
    chosen = index >= 0
    weights[chosen] = (weight * ratios)[index[chosen]]
    return Model(weights, bias)


def score(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Per row: doc_id, held_out, score and predicted.

    A null or empty text has the score of a text without any n-gram. A null id stays null (it is in
    the fold of the empty text), repeated rows are scored each, an empty table gives no rows, and
    other columns are not read.
    """
    at = np.flatnonzero(model.weights)
    values, bias = model.weights[at], model.bias

    def run(batches):
        weights = np.zeros(1 << BITS)
        weights[at] = values
        own = Model(weights, bias)
        for batch in batches:
            for part in slices(batch, SCORE_BYTES):
                yield pa.RecordBatch.from_pydict({
                    "doc_id": pa.array(part.ids, pa.int64()), "score": pa.array(logistic(own.logits(part)), pa.float64()),
                })

    return id_and_bytes(docs, doc_id, text).mapInArrow(run, "doc_id long, score double").select(
        "doc_id", (fold(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"), "score",
        F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"),
    )


def keep_clean(docs: DataFrame, model: Model, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose text scores under ``threshold``."""
    at = np.flatnonzero(model.weights)
    values, bias = model.weights[at], model.bias

    def run(batches):
        weights = np.zeros(1 << BITS)
        weights[at] = values
        own = Model(weights, bias)
        for batch in batches:
            data = pc.fill_null(batch.column(batch.schema.get_field_index(text)).cast(pa.string()), "").cast(pa.binary())
            texts = pa.RecordBatch.from_arrays([pa.nulls(len(data), pa.int64()), data], ["doc_id", "data"])
            scores = [logistic(own.logits(part)) for part in slices(texts, SCORE_BYTES)]
            if scores:
                yield batch.filter(pa.array(np.concatenate(scores) < threshold))

    return docs.mapInArrow(run, docs.schema)
