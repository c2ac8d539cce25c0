"""Each operator against a plain version, over a table with every awkward row and an empty one."""

from __future__ import annotations

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tests.llm import cases
from varve.llm import (
    anchors, block_topk, components, divergence, jaccard_join, maxent_lm, packing, piece_codec, suffixes, token_counts, toxicity,
)

PIECES = public_tokenizers.path("piece_bpe_32k.model")
BYTES = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def rows():
    return cases.texts()


@pytest.fixture(scope="module")
def docs(spark):
    return cases.frame(spark).cache()


@pytest.fixture(scope="module")
def none(spark):
    return cases.frame(spark, [])


def bag(df, *columns) -> Counter:
    return Counter(tuple(r) for r in df.select(*columns).collect())


@pytest.fixture(scope="module")
def pieces():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=PIECES)


@pytest.mark.parametrize("segment", [16, 1 << 16])
def test_token_counts(docs, none, rows, pieces, segment):
    found = token_counts.token_counts(docs, PIECES, limit=100, segment_bytes=segment, batch_bytes=4096)
    sizes = [(i, len((t or "").encode()), len(pieces.encode(t or ""))) for i, t in rows]
    assert bag(found, "doc_id", "n_bytes", "n_tokens", "over_limit") == Counter((i, b, n, n > 100) for i, b, n in sizes)
    assert token_counts.token_counts(none, PIECES).count() == 0


@pytest.mark.parametrize("entries", [50, 400_000])
def test_piece_codec(docs, none, rows, pieces, entries):
    found = piece_codec.encode_decode(docs, PIECES, entries=entries)
    want = Counter()
    for i, t in rows:
        ids = pieces.encode(t or "")
        shown, back = ",".join(map(str, ids)), pieces.decode(ids)
        want[i, len(ids), hashlib.sha256(shown.encode()).hexdigest(), hashlib.sha256(back.encode()).hexdigest(), shown, back] += 1
    got = Counter((r[0], r[1], r[2], r[3], ",".join(map(str, r[4])), r[5]) for r in found.collect())
    assert got == want
    assert piece_codec.encode_decode(none, PIECES).count() == 0


def test_suffixes(docs, none, rows):
    found = suffixes.dedup(docs, carry=("lang", "n_tokens"))
    assert bag(found, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == cases.dedup_bytes(rows)
    assert {tuple(r.carried) for r in found.collect()} == {("en", 2)}
    assert suffixes.dedup(none).count() == 0


def test_suffixes_cover():
    gaps = {(a - b) % suffixes.PERIOD for a in suffixes.COVER for b in suffixes.COVER}
    assert gaps == set(range(suffixes.PERIOD))


def test_anchors(docs, none, rows):
    found = anchors.dedup(docs)
    assert bag(found, "doc_id", "n_words", "n_removed", "kept_sha256") == cases.dedup_words(rows)
    assert anchors.dedup(none).count() == 0


def test_repeats_at_every_shift(spark):
    """Passages of just enough and just too few words and bytes, at all distances to blocks."""
    rnd = random.Random(3)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(4))
    table = []
    for k in range(26):
        passage = [word() for _ in range(50 - k % 2)]
        table.append((2 * k, " ".join([word() for _ in range(k)] + passage)))
        table.append((2 * k + 1, " ".join([word() for _ in range(k // 2)] + passage + [word()])))
    docs = cases.frame(spark, table)
    assert bag(anchors.dedup(docs, keep=False), "*") == cases.dedup_words(table)
    short = [(i, t[k % 7:][: 49 + k % 3]) for k, (i, t) in enumerate(table)] + [(100 + i, t[3:120]) for i, t in table]
    assert bag(suffixes.dedup(cases.frame(spark, short), keep=False), "*") == cases.dedup_bytes(short)


def test_jaccard(docs, none, rows):
    assert bag(jaccard_join.similar(docs), "doc_id", "n_shingles", "component_id") == cases.groups(rows)
    assert jaccard_join.similar(none).count() == 0


def test_jaccard_chains(spark):
    """Chains of sets near the threshold, a large group of near copies, and a line that all share."""
    rnd = random.Random(9)
    word = lambda: "".join(rnd.choice("abcdefghijklm") for _ in range(6))
    table, base, line = [], [word() for _ in range(60)], [word() for _ in range(24)]
    for k in range(40):
        own = list(base)
        own[rnd.randrange(60)] = word()
        table.append((k, " ".join(own)))
    for k in range(40, 60):
        base = base[4:] + [word() for _ in range(4)]
        table.append((k, " ".join(base)))
    table += [(k, " ".join(line + [word() for _ in range(k % 9)])) for k in range(60, 100)]
    assert bag(jaccard_join.similar(cases.frame(spark, table)), "doc_id", "n_shingles", "component_id") == cases.groups(table)


def test_jaccard_long_lists(spark, monkeypatch):
    """Lists over a size are split by a second shingle and blocks; the rounds before are held back so that
    the last one has all pairs to find."""
    monkeypatch.setattr(jaccard_join, "LIST", 4)
    monkeypatch.setattr(jaccard_join, "WIDE", 8)
    monkeypatch.setattr(jaccard_join, "CENTERS", 1)
    rnd = random.Random(3)
    word = lambda: "".join(rnd.choice("abcdefghijklm") for _ in range(6))
    short, base = [word() for _ in range(7)], [word() for _ in range(50)]
    table = [(k, " ".join([*short, word()])) for k in range(60)]
    for k in range(60, 130):
        own = list(base)
        for _ in range(k % 3 + 1):
            own[rnd.randrange(50)] = rnd.choice(base[:5])
        table.append((k, " ".join(own[: 50 - k % 7])))
    found = jaccard_join.similar(cases.frame(spark, table))
    assert bag(found, "doc_id", "n_shingles", "component_id") == cases.groups(table)


def test_jaccard_blocks_find_what_whole_lists_find(spark, monkeypatch):
    """The last round alone, without any component: every similar pair comes through second shingles and blocks."""
    rnd = random.Random(5)
    word = lambda: "".join(rnd.choice("abcdefghijklm") for _ in range(6))
    base, table = [word() for _ in range(40)], []
    for k in range(50):
        own = list(base)
        own[rnd.randrange(40)] = rnd.choice(base[:4])
        table.append((k, " ".join(own[: 40 - k % 5])))
    rows = jaccard_join.sets(cases.frame(spark, table), "doc_id", "text", 5, 75).where("node is not null").checkpoint()
    nodes = rows.groupBy("node").agg(*[F.first(c).alias(c) for c in ("n", "alone", "shared", "bits")]).checkpoint()
    prefix, none = jaccard_join.prefixes(nodes, 75), spark.createDataFrame([], "node LONG, component LONG")
    in_blocks, sizes = jaccard_join._in_blocks, []

    def seen(*parts):
        found = in_blocks(*parts).checkpoint()
        sizes.append(found.count())
        return found

    monkeypatch.setattr(jaccard_join, "_in_blocks", seen)
    links = []
    for size in (4, 1 << 20):
        monkeypatch.setattr(jaccard_join, "LIST", size)
        pairs = jaccard_join.open_pairs(nodes, prefix, none, 75, None)
        links.append(bag(jaccard_join.linked(nodes, pairs, 75, 1).selectExpr("least(a, b)", "greatest(a, b)"), "*"))
    assert len(sizes) == 1 and sizes[0] > 0
    assert links[0] == links[1] and len(links[0]) > 20


def test_jaccard_template_makes_no_pairs(spark):
    """Many sets of the same template with one own shingle: the bounds exclude the blocks as a whole."""
    sets = spark.range(3 * jaccard_join.LIST).selectExpr(
        "7L AS key", "id AS node", "4 AS n", "3 AS ahead", "id AS component"
    )
    assert jaccard_join.block_pairs(sets, 75)[1].count() == 0
    near = sets.withColumn("ahead", F.lit(4))
    pairs = jaccard_join.block_pairs(near, 75)[1]
    kinds, parts = jaccard_join.KINDS, 1
    assert pairs.count() == kinds * parts * (kinds * parts + 1) // 2


@pytest.mark.parametrize("at_once", [7, 500_000])
def test_components(spark, monkeypatch, at_once):
    monkeypatch.setattr(components, "AT_ONCE", at_once)
    links = [(k, k + 1) for k in range(1, 30)] + [(100, k) for k in range(101, 160)] + [(200, 200), (301, 300)]
    frame = spark.createDataFrame(links, "a long, b long").repartition(12)
    found = {r.node: r.component for r in components.components(frame).collect()}
    assert found == {k: 1 for k in range(1, 31)} | {k: 100 for k in range(100, 160)} | {300: 300, 301: 300}


def test_block_topk(spark):
    rnd = np.random.default_rng(4)
    vectors = {k: rnd.normal(size=6).round(2).tolist() for k in range(0, 900)}
    vectors |= {900 + k: [0.5] * 6 for k in range(200)}  # ties
    table = [*vectors.items(), (None, [1.0] * 6), (2001, None), (2002, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (2003, [math.nan] * 6), (2004, [math.inf] * 6)]
    df = spark.createDataFrame([(i, v, 7, "x") for i, v in table], "vec_id long, embedding array<double>, score int, v string")
    whole = {i: [math.floor(64 * x) for x in v] for i, v in vectors.items()}
    want = Counter()
    for q in whole:
        if q % 20 == 0:
            best = sorted((-sum(a * b for a, b in zip(whole[q], v)), i) for i, v in whole.items() if i != q)[:20]
            want.update((q, n, i, -s) for n, (s, i) in enumerate(best, 1))
    assert bag(block_topk.top_k(df), "query_id", "rank", "vec_id", "score") == want
    few = df.where("vec_id in (0, 1, 2)")
    assert block_topk.top_k(few).count() == 2
    assert block_topk.top_k(df.where("vec_id < 0")).count() == 0


def test_quality(docs, none, rows):
    found = divergence.quality(docs)
    want = Counter()
    for i, t in rows:
        words, lines, repeats = cases.words_of(t), (t or "").split("\n"), set()
        text_words = [w.decode() for w in words]
        places = Counter(tuple(words[k:k + 5]) for k in range(len(words) - 4))
        for k in range(len(words) - 4):
            if places[tuple(words[k:k + 5])] > 1:
                repeats.update(range(k, k + 5))
        lines = [line for line in lines if cases.words_of(line)]
        want[
            i, len(words), sum(map(len, text_words)), sum((t or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)),
            len(repeats), len(words) < 10 or 100 * len(repeats) > 20 * len(words),
        ] += 1
    assert bag(found, "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed") == want
    assert divergence.quality(none).count() == 0


def test_quality_distance(spark, small):
    import duckdb

    found = {r.doc_id: r for r in divergence.quality(spark.read.parquet(f"{small}/documents.parquet")).collect()}
    labels = duckdb.sql(f"SELECT doc_id, quality FROM '{small}/labels.parquet'").fetchall()
    judged = [(found[i], q) for i, q in labels if not found[i].base_failed and found[i].n_words >= 20]
    junk, good = [r.kept for r, q in judged if q == 0], [r.kept for r, q in judged if q == 1]
    assert sum(junk) <= 0.1 * len(junk) and sum(good) >= 0.98 * len(good)
    assert all(0 <= r.char_distance <= 1 for r in found.values() if r.char_distance is not None)


def test_toxicity(spark, small, docs, none):
    labels = spark.read.parquet(f"{small}/labels.parquet")
    model = toxicity.fit(spark.read.parquet(f"{small}/documents.parquet"), labels)
    found = {r.doc_id: r for r in toxicity.score(spark.read.parquet(f"{small}/documents.parquet"), model).collect()}
    marked = [(r.toxic, found[r.doc_id]) for r in labels.collect() if found[r.doc_id].held_out]
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in found.items())
    right = sum(t == r.predicted for t, r in marked)
    assert right >= 0.93 * len(marked)
    assert sum(r.predicted for t, r in marked if t == 0) <= 0.02 * len(marked)
    awkward = toxicity.score(docs, model)
    assert awkward.count() == docs.count() and awkward.where("score between 0 and 1").count() == docs.count()
    assert toxicity.keep_clean(docs, model).columns == docs.columns
    assert toxicity.keep_clean(docs, model).count() == awkward.where("predicted = 0").count()
    assert toxicity.score(none, model).count() == 0


def test_toxicity_without_labels(spark, docs):
    empty = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r.predicted for r in toxicity.score(docs, toxicity.fit(docs, empty)).collect()} == {0}
    odd = spark.createDataFrame([(7, 1), (7, 0), (2, 5), (None, 1), (5, None)], "doc_id long, toxic int")
    assert toxicity.score(docs, toxicity.fit(docs, odd)).count() == docs.count()


def test_packing(docs, none, rows):
    from tokenizers import Tokenizer

    encoder, size = Tokenizer.from_file(BYTES), 64
    found = packing.pack(docs, BYTES, size=size).collect()
    want = Counter()
    for i, t in rows:
        ids = encoder.encode(t or "", add_special_tokens=False).ids + [0]
        first = (len(ids) - 1) % size + 1
        for piece, stop in enumerate(range(first, len(ids) + 1, size)):
            own = ids[max(0, stop - size):stop]
            want[i, piece, stop - len(own), len(own), zlib.crc32(np.array(own, "<u4").tobytes()), tuple(own)] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32, tuple(r.ids)) for r in found) == want
    at: dict[int, list] = {}
    for r in found:
        at.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for spans in at.values():
        spans.sort()
        assert [o for o, _ in spans] == [sum(n for _, n in spans[:k]) for k in range(len(spans))]
        assert sum(n for _, n in spans) <= size
    assert packing.pack(none, BYTES).count() == 0


def test_packing_plan():
    rnd = random.Random(2)
    for _ in range(30):
        lengths = Counter(rnd.randint(1, 100) for _ in range(rnd.randint(0, 400)))
        used, filled = Counter(), Counter()
        for p in packing.plan(dict(lengths), 100):
            used[p.length] += p.count
            for k in range(p.count // p.each):
                filled[p.sequence + k] += p.each * p.length
        total = sum(k * n for k, n in lengths.items())
        assert used == lengths and all(n <= 100 for n in filled.values())
        assert len(filled) <= 1.1 * total / 100 + 2


def test_language_model(spark, docs, none, rows):
    found = maxent_lm.score(docs).collect()
    held = [zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2 for i, _ in rows]
    tokens = [[*(t or "").encode().translate(cases.LOWER).split(), None] for _, t in rows]
    count = Counter(w for own, out in zip(tokens, held) if not out for w in own)
    total = sum(count.values())
    want = Counter()
    for (i, _), own, out in zip(rows, tokens, held):
        base = sum(math.log10((count[w] + 1) / (total + len(count) + 1)) for w in own)
        want[i, out, len(own), sum(count[w] > 0 for w in own), total, round(base, 6)] += 1
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in found) == want
    assert all(math.isfinite(r.score) and r.score <= 1e-6 for r in found)
    assert maxent_lm.score(none).count() == 0


def test_language_model_beats_counts(spark, small):
    found = maxent_lm.score(spark.read.parquet(f"{small}/documents.parquet")).where("held_out").collect()
    assert sum(r.score for r in found) > 0.95 * sum(r.base_score for r in found)


def test_language_model_is_a_distribution():
    """Over all classes the probabilities sum to one for any history."""
    rnd = np.random.default_rng(1)
    model = maxent_lm.Model(rnd.normal(size=maxent_lm.CLASSES))
    model.flat[:] = rnd.normal(size=len(model.flat)) / 3
    joint = model.joint()
    for near, skip in ((0, 5), (maxent_lm.START, maxent_lm.START), (17, 40)):
        own = model.bias + model.rows["near"][near] + model.rows["skip"][skip] + model.rows["pair"][model.pair(np.array([near]), np.array([skip]))[0]]
        assert np.allclose(joint[near * (maxent_lm.START + 1) + skip], own, atol=1e-5)
