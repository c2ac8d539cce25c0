"""MinHash components against all pairs of full sets, and the parts of the search by themselves."""

from __future__ import annotations

import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm import cases
from varve.llm import minhash
from varve.llm.common import Slice, ensure_checkpoints


def plain(rows, size=2, percent=80) -> Counter:
    sets = [cases.shingles(t, size) for _, t in rows]
    parent = list(range(len(rows)))

    def find(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                parent[find(a)] = find(b)
    ids = defaultdict(list)
    for k, (i, _) in enumerate(rows):
        ids[find(k)].append(i)
    least = {k: min((i for i in own if i is not None), default=None) for k, own in ids.items()}
    return Counter((i, len(sets[k]), least[find(k)], i == least[find(k)]) for k, (i, _) in enumerate(rows))


def found(docs, **options) -> Counter:
    return Counter(tuple(r) for r in minhash.near_duplicates(docs, **options).select("doc_id", "n_shingles", "component_id", "kept").collect())


def word(rnd) -> str:
    return "".join(rnd.choice("abcdefghijklm") for _ in range(6))


def family(rnd) -> list[tuple]:
    """Chains of copies just above and below the limit, a large group of near copies, and short sets that share a template."""
    rows, base = [], [word(rnd) for _ in range(80)]
    for k in range(50):
        own = list(base)
        for _ in range(rnd.randint(0, 5)):
            own[rnd.randrange(80)] = word(rnd)
        rows.append((k, " ".join(own)))
    for k in range(50, 80):
        base = base[rnd.randint(6, 10):]
        base += [word(rnd) for _ in range(80 - len(base))]
        rows.append((k, " ".join(base)))
    template = [word(rnd) for _ in range(9)]
    rows += [(k, " ".join(template + [word(rnd) for _ in range(k % 3)])) for k in range(80, 140)]
    return rows


def test_near_duplicates(spark):
    rows = cases.texts()
    assert found(cases.frame(spark)) == plain(rows)
    assert minhash.near_duplicates(cases.frame(spark, [])).count() == 0
    assert found(cases.frame(spark, [(1, None), (2, ""), (None, None)])) == Counter([(1, 0, 1, True), (2, 0, 2, True), (None, 0, None, True)])


@pytest.mark.parametrize("crowd, block, weight", [(256, 2048, 1 << 20), (4, 16, 3000), (0, 5, 1000)])
def test_families(spark, monkeypatch, crowd, block, weight):
    """The same links where lists are merged, where most are skipped, and where families have many blocks."""
    monkeypatch.setattr(minhash, "CROWD", crowd)
    monkeypatch.setattr(minhash, "BLOCK", block)
    monkeypatch.setattr(minhash, "WEIGHT", weight)
    rows = family(random.Random(6))
    assert found(cases.frame(spark, rows)) == plain(rows)


def test_pairs_across_families(spark, monkeypatch):
    """Without stars every link must come from merged lists or, where those are skipped, from blocks of signatures."""
    rows = family(random.Random(11))
    none = lambda posted, percent: posted.sparkSession.createDataFrame([], "a long, b long")
    monkeypatch.setattr(minhash, "centre_pairs", none)
    assert found(cases.frame(spark, rows)) == plain(rows)
    monkeypatch.setattr(minhash, "CROWD", 1)
    monkeypatch.setattr(minhash, "BLOCK", 7)
    assert found(cases.frame(spark, rows)) == plain(rows)


def test_higher_limit(spark):
    rows = family(random.Random(7))
    assert found(cases.frame(spark, rows), percent=92) == plain(rows, percent=92)
    with pytest.raises(ValueError):
        minhash.near_duplicates(cases.frame(spark, rows), percent=70)


def test_large_group_gives_few_pairs(spark):
    rnd = random.Random(3)
    base = [word(rnd) for _ in range(120)]
    rows = [(0, " ".join(base))]
    for k in range(1, 400):
        own = list(base)
        own[rnd.randrange(120)] = word(rnd)
        rows.append((k, " ".join(own)))
    ensure_checkpoints(spark)
    signed = minhash.signed(cases.frame(spark, rows))
    nodes = signed.groupBy("node").agg(F.first("n").alias("n"), F.first("signature").alias("signature")).checkpoint()
    posted = minhash.postings(nodes).checkpoint()
    pairs = minhash.centre_pairs(posted, 80)
    assert pairs.count() <= 3 * 400
    one = posted.withColumn("component", F.lit(7).cast("long"))
    merged, dense = minhash.merged_pairs(one, 80)
    assert merged.count() == 0 and dense.count() == 0


def test_lists_across_families_give_few_pairs(spark):
    """Nodes of different components that share lists of middling size are left to the blocks, not paired in each list."""
    ensure_checkpoints(spark)
    posted = spark.range(8).withColumnRenamed("id", "key").crossJoin(spark.range(250).withColumnRenamed("id", "node")).select(
        "key", "node", F.lit(100).alias("n"), F.lit(0).alias("own"), F.col("node").alias("component"))
    merged, dense = minhash.merged_pairs(posted, 80)
    assert merged.count() <= 8 * posted.count()
    assert dense.count() == 250


def test_signatures_agree_as_sets_do():
    """Agreeing coordinates of sets at known similarities, over many pairs: mean and spread of a binomial count."""
    rnd = np.random.default_rng(5)
    for size, own in ((300, 0.8), (40, 0.8), (300, 0.5)):
        both = round(size * 2 * own / (1 + own))
        counts = []
        for _ in range(200):
            values = rnd.integers(0, 1 << 63, size=2 * size - both, dtype=np.uint64) << np.uint64(1)
            a, b = values[:size], np.concatenate((values[:both], values[size:]))
            signatures = minhash._signatures(np.concatenate((a, b)), np.array([0, size]))
            counts.append(int((signatures[0] == signatures[1]).sum()))
        share = both / (2 * size - both)
        assert abs(np.mean(counts) / 128 - share) < 0.02
        assert np.std(counts) < 1.3 * (128 * share * (1 - share)) ** 0.5


def test_long_text_in_parts(monkeypatch):
    text = " ".join(f"W{k * k % 97}" for k in range(3000)).encode()
    part = Slice([1], np.array([0, len(text)]), np.frombuffer(text, np.uint8))
    whole = minhash._sets(part, 2)[0]
    monkeypatch.setattr(minhash, "LONG", 10)
    from varve.llm import common
    monkeypatch.setattr(common.chunked_word_hashes, "__defaults__", (50,))
    assert (minhash._sets(part, 2)[0] == whole).all()
    for few, n in ((b"", 0), (b" one ", 1), (b"one two", 1), (b"a" * 30, 1)):
        own = Slice([1], np.array([0, len(few)]), np.frombuffer(few, np.uint8))
        assert len(minhash._sets(own, 2)[0]) == n
