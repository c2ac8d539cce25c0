"""The queries of this package over the given tables, with SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from varve.llm import (
    anchors, block_topk, divergence, filter_audit, jaccard_join, maxent_lm, minhash, packing, piece_codec, spelling, suffixes, token_counts, toxicity,
)
from varve.llm.common import documents

PIECES = "piece_bpe_32k.model"
BYTES = "byte_bpe_50k.json"


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(documents(spark, sf_dir), public_tokenizers.path(PIECES))


def op2_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.dedup(documents(spark, sf_dir), keep=False)


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.similar(documents(spark, sf_dir)).select("doc_id", "n_shingles", "component_id")


def op4_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_codec.encode_decode(documents(spark, sf_dir), public_tokenizers.path(PIECES), keep=False)


def op5_block_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return block_topk.top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op6_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.quality(documents(spark, sf_dir))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return toxicity.score(docs, toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def op8_best_two_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), public_tokenizers.path(BYTES), keep_ids=False)


def op9_maxent_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maxent_lm.score(documents(spark, sf_dir))


def op10_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return anchors.dedup(documents(spark, sf_dir), keep=False)


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op12_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(documents(spark, sf_dir))


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(documents(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_counts": op1_token_counts,
    "op2_suffixes": op2_suffixes,
    "op3_jaccard_join": op3_jaccard_join,
    "op4_piece_codec": op4_piece_codec,
    "op5_block_topk": op5_block_topk,
    "op6_divergence": op6_divergence,
    "op7_toxicity": op7_toxicity,
    "op8_best_two_fit": op8_best_two_fit,
    "op9_maxent_lm": op9_maxent_lm,
    "op10_anchors": op10_anchors,
    "op11_filter_audit": op11_filter_audit,
    "op12_minhash": op12_minhash,
    "op13_spelling": op13_spelling,
}

OP5_SQL = """
WITH v AS (
    SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v
    FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
        AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
    SELECT q.row AS query_row, q.vec_id AS query_id, c.vec_id, c.row, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
    FROM v AS q JOIN v AS c ON q.row <> c.row
    WHERE q.vec_id % 20 = 0
), ranked AS (
    SELECT *, CAST(row_number() OVER (PARTITION BY query_row ORDER BY score DESC, vec_id, row) AS INTEGER) AS rank
    FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
"""

_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"

OP2_SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
p AS (SELECT doc_id, unnest(range(0, len(h) // 2 - 49)) AS i, h FROM d),
k AS (SELECT doc_id, i, substr(h, 2 * i + 1, 100) AS k FROM p),
least AS (SELECT k, min(doc_id) AS least FROM k GROUP BY k),
hit AS (SELECT doc_id, i FROM k JOIN least USING (k) WHERE least < doc_id),
gone AS (SELECT DISTINCT doc_id, i + o AS j FROM hit, range(50) AS t(o)),
spans AS (SELECT doc_id, j, lag(j) OVER (PARTITION BY doc_id ORDER BY j) AS b FROM gone),
sums AS (SELECT doc_id, count(*) AS n, count(CASE WHEN b IS NULL OR b < j - 1 THEN 1 END) AS s FROM spans GROUP BY doc_id),
left_over AS (
    SELECT doc_id, string_agg(substr(h, 2 * j + 1, 2), '' ORDER BY j) AS h
    FROM (SELECT doc_id, unnest(range(0, len(h) // 2)) AS j, h FROM d WHERE doc_id IN (SELECT doc_id FROM sums))
    ANTI JOIN gone USING (doc_id, j) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(d.h) // 2 AS BIGINT) AS n_bytes, coalesce(n, 0) AS n_removed, coalesce(s, 0) AS n_spans,
    sha256(unhex(CASE WHEN n IS NULL THEN d.h ELSE coalesce(l.h, '') END)) AS kept_sha256
FROM d LEFT JOIN sums USING (doc_id) LEFT JOIN left_over AS l USING (doc_id)
"""

OP3_SQL = f"""
WITH RECURSIVE d AS (
    SELECT doc_id, {_WORDS.format("translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS w
    FROM documents
), s AS (
    SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS k
    FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM d WHERE len(w) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
links AS (
    SELECT a.doc_id AS a, b.doc_id AS b
    FROM s AS a JOIN s AS b ON a.k = b.k AND a.doc_id <> b.doc_id
    JOIN n AS x ON x.doc_id = a.doc_id JOIN n AS y ON y.doc_id = b.doc_id
    GROUP BY a.doc_id, b.doc_id, x.n, y.n
    HAVING 100 * count(*) >= 75 * (x.n + y.n - count(*))
), reach(a, b) AS (
    SELECT doc_id, doc_id FROM documents
    UNION
    SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b
)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, c.least AS component_id
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS least FROM reach GROUP BY a) AS c USING (doc_id)
"""

OP10_SQL = f"""
WITH d AS (SELECT doc_id, {_WORDS.format("coalesce(text, '')")} AS w FROM documents),
k AS (
    SELECT doc_id, i, array_to_string(w[i:i + 49], ' ') AS k
    FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d)
),
least AS (SELECT k, min(doc_id) AS least FROM k GROUP BY k),
hit AS (SELECT doc_id, i FROM k JOIN least USING (k) WHERE least < doc_id),
gone AS (SELECT DISTINCT doc_id, i + o AS j FROM hit, range(50) AS t(o)),
sums AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id),
left_over AS (
    SELECT doc_id, string_agg(w[j], ' ' ORDER BY j) AS kept
    FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS j FROM d) ANTI JOIN gone USING (doc_id, j) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN sums USING (doc_id) LEFT JOIN left_over USING (doc_id)
"""

OP11_SQL = f"""
WITH RECURSIVE d AS (
    SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, {_WORDS.format("coalesce(text, '')")} AS w,
        coalesce(least.first < doc_id, least.first IS NOT NULL) AS copy
    FROM documents LEFT JOIN (SELECT coalesce(text, '') AS same, min(doc_id) AS first FROM documents GROUP BY ALL) AS least
        ON coalesce(text, '') = same
), l AS (SELECT doc_id, max(CAST(quality = 1 AS INT)) AS good, max(CAST(toxic = 1 AS INT)) AS toxic FROM labels GROUP BY ALL),
cells AS (
    SELECT part, CAST(len(w) < 200 AS INT) + 2 * CAST(100 * len(list_distinct(w)) < 50 * len(w) AS INT)
        + 4 * CAST(100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t) AS INT)
        + 8 * CAST(regexp_matches(t, '[#$%&*|]') AS INT) + 16 * CAST(copy AS INT) AS mask,
        count(*) AS n, coalesce(sum(good), 0) AS good, coalesce(sum(toxic), 0) AS toxic
    FROM d LEFT JOIN l USING (doc_id) GROUP BY ALL
), letters(letter, bit) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
orders(o) AS (SELECT '' UNION ALL SELECT o || letter FROM orders, letters WHERE NOT contains(o, letter)),
steps AS (
    SELECT o AS filter_order, CAST(s AS INT) AS step, l.bit, l.letter,
        CAST(coalesce((SELECT sum(e.bit) FROM letters AS e WHERE contains(left(o, s - 1), e.letter)), 0) AS INT) AS before
    FROM (SELECT o, unnest(range(1, 6)) AS s FROM orders WHERE length(o) = 5) JOIN letters AS l ON l.letter = substr(o, s, 1)
), metrics AS (
    SELECT part, filter_order, step, letter,
        CAST(sum(CASE WHEN mask & (before | bit) = 0 THEN n ELSE 0 END) AS BIGINT) AS kept,
        CAST(sum(CASE WHEN mask & before = 0 AND mask & bit <> 0 THEN n ELSE 0 END) AS BIGINT) AS removed,
        CAST(sum(CASE WHEN mask & before <> 0 AND mask & bit <> 0 THEN n ELSE 0 END) AS BIGINT) AS redundant,
        CAST(sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS BIGINT) AS unique_fails,
        CAST(sum(CASE WHEN mask & before = 0 AND mask & bit <> 0 THEN good ELSE 0 END) AS BIGINT) AS good_lost,
        CAST(sum(CASE WHEN mask & before = 0 AND mask & bit <> 0 THEN toxic ELSE 0 END) AS BIGINT) AS toxic_lost
    FROM cells, steps GROUP BY ALL
)
SELECT * EXCLUDE (letter), CAST(sum(removed) OVER (PARTITION BY part, letter) AS BIGINT) AS shapley FROM metrics
"""

OP12_SQL = f"""
WITH RECURSIVE d AS (
    SELECT doc_id, {_WORDS.format("translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS w
    FROM documents
), s AS (
    SELECT DISTINCT doc_id, array_to_string(w[i:i + 1], ' ') AS k
    FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w), 2))) AS i FROM d WHERE len(w) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
links AS (
    SELECT a.doc_id AS a, b.doc_id AS b
    FROM s AS a JOIN s AS b ON a.k = b.k AND a.doc_id <> b.doc_id
    JOIN n AS x ON x.doc_id = a.doc_id JOIN n AS y ON y.doc_id = b.doc_id
    WHERE 100 * least(x.n, y.n) >= 80 * greatest(x.n, y.n)
    GROUP BY a.doc_id, b.doc_id, x.n, y.n
    HAVING 100 * count(*) >= 80 * (x.n + y.n - count(*))
), reach(a, b) AS (
    SELECT doc_id, doc_id FROM documents
    UNION
    SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b
)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, c.least AS component_id, d.doc_id = c.least AS kept
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS least FROM reach GROUP BY a) AS c USING (doc_id)
"""

# crc32 bit by bit: a byte of the list is added to the state, and each -1 shifts it once.
OP13_SQL = r"""
WITH RECURSIVE r AS (
    SELECT doc_id, run, count(*) AS times FROM (
        SELECT doc_id, translate(unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\x{00C0}-\x{00FF}]+')),
            'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents
    ) WHERE length(run) >= 7 GROUP BY ALL
), h AS (
    SELECT *, xor(4294967295, list_reduce(
        list_prepend(CAST(4294967295 AS BIGINT), flatten(list_transform(
            flatten(list_transform(string_split(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run, ''),
                lambda c: CASE WHEN unicode(c) < 128 THEN [CAST(unicode(c) AS BIGINT)] ELSE [195, unicode(c) - 64] END)),
            lambda b: [b, -1, -1, -1, -1, -1, -1, -1, -1]))),
        lambda s, x: CASE WHEN x >= 0 THEN xor(s, x) ELSE xor(s >> 1, 3988292384 * (s & 1)) END)) AS h
    FROM r
), w AS (
    SELECT word, CAST(sum(times) AS BIGINT) AS n
    FROM (SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, times FROM h)
    GROUP BY word HAVING length(word) >= 7 AND sum(times) >= 2
), less AS (SELECT word, k, substr(word, 1, k - 1) || substr(word, k + 1) AS rest FROM (SELECT word, unnest(range(1, length(word) + 1)) AS k FROM w)),
pairs AS (
    SELECT a.word, b.word AS near FROM less AS a JOIN less AS b ON a.rest = b.rest AND a.k = b.k AND a.word <> b.word
    UNION SELECT a.word, b.word FROM less AS a JOIN w AS b ON b.word = a.rest
    UNION SELECT b.word, a.word FROM less AS a JOIN w AS b ON b.word = a.rest
), ranked AS (
    SELECT p.word, p.near, w.n, count(*) OVER (PARTITION BY p.word) AS n_near, row_number() OVER (PARTITION BY p.word ORDER BY w.n DESC, p.near) AS place
    FROM pairs AS p JOIN w ON w.word = p.near
), named AS (
    SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN r.n >= 10 * w.n THEN r.near END AS form, CASE WHEN r.n >= 10 * w.n THEN r.n END AS form_n
    FROM w LEFT JOIN ranked AS r ON r.word = w.word AND place = 1
), onward(word, root) AS (
    SELECT word, word FROM named
    UNION ALL
    SELECT onward.word, named.form FROM onward JOIN named ON named.word = onward.root WHERE named.form IS NOT NULL
)
SELECT named.word, named.form, onward.root, named.n, named.n_near, named.form_n
FROM named JOIN onward ON onward.word = named.word JOIN named AS last ON last.word = onward.root AND last.form IS NULL
"""

ORACLES: dict[str, str] = {
    "op2_suffixes": OP2_SQL,
    "op3_jaccard_join": OP3_SQL,
    "op5_block_topk": OP5_SQL,
    "op10_anchors": OP10_SQL,
    "op11_filter_audit": OP11_SQL,
    "op12_minhash": OP12_SQL,
    "op13_spelling": OP13_SQL,
}
