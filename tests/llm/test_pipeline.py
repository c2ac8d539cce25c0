"""The pipeline's stages over awkward rows, and as a whole on the smallest tables."""

from __future__ import annotations

from tests.llm import cases

import corpus_pipeline
from varve.llm import divergence


def test_stages_on_awkward_rows(spark, tiny):
    docs = cases.frame(spark).select("doc_id", "text", "lang", "source", "n_chars")
    kept = corpus_pipeline.quality(spark, docs, tiny)
    good = divergence.quality(docs).where("kept").count()
    assert kept.columns == docs.columns and kept.count() == good
    once = corpus_pipeline.near_duplicates(spark, docs, tiny)
    assert once.count() == sum(1 for _ in {(i, t) for i, t in stays(cases.texts())})
    left = corpus_pipeline.substrings(spark, docs, tiny)
    assert left.dtypes == docs.dtypes and left.count() == docs.count()
    assert left.where("n_chars <> char_length(text)").count() == 0


def test_clashing_names_and_empty_tables(spark, tiny):
    """Columns that stages use for themselves come through as they were, and an empty table gives an empty one."""
    docs = cases.frame(spark).select("doc_id", "text", "lang", "source", "n_chars").selectExpr(
        "*", "'v' AS verdict_key", "'t' AS text_key", "'i' AS stay_id", "'k' AS stay_key")
    for stage in (corpus_pipeline.quality, corpus_pipeline.near_duplicates):
        out = stage(spark, docs, tiny)
        assert out.dtypes == docs.dtypes
        assert {tuple(r) for r in out.select("verdict_key", "text_key", "stay_id", "stay_key").distinct().collect()} == {("v", "t", "i", "k")}
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), tiny).count() == 0


def stays(rows):
    """One row of each component by the plain version, with repeated rows once."""
    sets = [cases.shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            if rows[a] == rows[b] or 100 * len(sets[a] & sets[b]) >= 75 * max(1, len(sets[a] | sets[b])):
                parent[find(a)] = find(b)
    out = {}
    for k, (i, t) in enumerate(rows):
        out.setdefault(find(k), (i, t))
    return out.values()


def test_run(spark, tiny):
    found = corpus_pipeline.run(spark, tiny)
    ids = {r.doc_id for r in found.select("doc_id").distinct().collect()}
    assert 100 < len(ids) < spark.read.parquet(f"{tiny}/documents.parquet").count()
    assert corpus_pipeline.STAGES[0][0] == "quality" and len(corpus_pipeline.STAGES) == 5
