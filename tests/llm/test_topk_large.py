"""Top-k scores that need more than a double, and rows that share an id, against plain integers."""

from __future__ import annotations

import math
import random
from collections import Counter

import pytest

from varve.llm import block_topk


def plain(rows, k=20, every=20) -> Counter:
    good = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for at, (i, v) in enumerate(good):
        if i % every == 0:
            held = lambda s: min(max(s, -(1 << 63)), (1 << 63) - 1)
            scores = sorted((-held(sum(a * b for a, b in zip(v, w))), j) for other, (j, w) in enumerate(good) if other != at)
            out += [(i, rank, j, -minus) for rank, (minus, j) in enumerate(scores[:k], 1)]
    return Counter(out)


def found(spark, rows, **options) -> Counter:
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    return Counter(tuple(r) for r in block_topk.top_k(frame, **options).select("query_id", "rank", "vec_id", "score").collect())


def test_scores_past_a_clamp(spark):
    rows = [(20, [300000.0, 1.0]), (1, [400000.0, 0.0]), (2, [262144.0, 0.0]), (3, [1.0, 1.0]), (3, [2.0, 0.5])]
    got = found(spark, rows)
    assert got == plain(rows)
    assert (20, 1, 1, 491520000000000) in got and (20, 2, 2, 322122547200000) in got and sum(key[2] == 3 for key in got) == 2


@pytest.mark.parametrize("scale", [1.0, 2.0 ** 18, 2.0 ** 22, 2.0 ** 40])
def test_sizes_and_repeated_ids(spark, scale):
    rnd = random.Random(int(math.log2(scale)))
    rows = [(rnd.randrange(60), [rnd.uniform(-1, 1) * scale for _ in range(5)]) for _ in range(300)]
    rows += [(40, [scale] * 5), (40, [scale] * 5), (None, [1.0] * 5), (80, None), (100, [1.0, None]), (120, [float("nan")]), (7, [])]
    assert found(spark, rows, k=7) == plain(rows, k=7)
