"""Queries of the dimension, policy, suite, corpus, coverage and streaming operators."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varve import workload
from varve.functions.encoding import record_hash
from varve.functions.masking import mask_email
from varve.operators import corpus, coverage, policy, scd2, suite
from varve.plans.registry import register
from varve.session import ensure_checkpoint_dir
from varve.sources import changes, standin, tables
from varve.sources.dimension_store import DimensionStore
from varve.streaming import ingest

# --- change logs over the given tables --------------------------------------------------

# Every order is a change; three periods are the batches.
_ORDER_BATCH = (
    "CASE WHEN o_orderdate < DATE '1998-01-01' THEN 1 "
    "WHEN o_orderdate < DATE '2000-01-01' THEN 2 ELSE 3 END"
)
_BATCH_DAY = (
    "CASE batch_id WHEN 1 THEN DATE '1998-01-01' WHEN 2 THEN DATE '2000-01-01' "
    "ELSE DATE '2002-01-01' END"
)
_ORDER_CHANGE = {
    "batch_id": "batch_id",
    "effective_date": _BATCH_DAY,
    "op": "CASE WHEN o_orderkey % 7 = 0 THEN 'D' ELSE 'U' END",
    "customer_id": "o_custkey",
    "name": "'Customer ' || CAST(o_custkey AS STRING)",
    "segment": "o_orderpriority",
    "city": "CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_orderstatus END",
}


def _order_feed(spark, sf_dir) -> DataFrame:
    """Every order as a change, also several of a customer in one period."""
    orders = standin.load(spark, sf_dir).orders.withColumn("batch_id", F.expr(_ORDER_BATCH))
    return standin.derived(orders, _ORDER_CHANGE)


_ORDER_FEED_SQL = (
    "WITH " + standin.oracle_cte("orders") + f""",
    log AS (SELECT {', '.join(f'{e} AS {n}' for n, e in _ORDER_CHANGE.items())}
            FROM (SELECT *, {_ORDER_BATCH} AS batch_id FROM v_orders))"""
)

# Every order is a change of its own day; a batch holds as many of a customer as there are.
_ORDER_STEP = {**_ORDER_CHANGE, "effective_date": "o_orderdate", "seq": "o_orderkey"}
_STEP_SPEC = scd2.Spec(sequence=("effective_date", "seq"), many_per_batch=True)


def _order_steps(spark, sf_dir) -> DataFrame:
    orders = standin.load(spark, sf_dir).orders.withColumn("batch_id", F.expr(_ORDER_BATCH))
    return standin.derived(orders, _ORDER_STEP)


_ORDER_STEP_SQL = (
    "WITH " + standin.oracle_cte("orders") + f""",
    log AS (SELECT {', '.join(f'{e} AS {n}' for n, e in _ORDER_STEP.items())}
            FROM (SELECT *, {_ORDER_BATCH} AS batch_id FROM v_orders))"""
)

# Many changes per user: every event is one, ordered by time.
_EVENT_CHANGE = {
    "batch_id": "1",
    "effective_date": "CAST(ts AS DATE)",
    "op": "CASE WHEN event_type = 'error' THEN 'D' ELSE 'U' END",
    "customer_id": "user_id",
    "name": "'user ' || CAST(user_id AS STRING)",
    "segment": "CASE WHEN event_type IN ('view', 'click') THEN 'browsing' ELSE event_type END",
    "city": "CASE WHEN event_id % 4 = 0 THEN NULL ELSE 'desk' END",
    "ts": "ts",
    "seq": "event_id",
}
_EVENT_SPEC = scd2.Spec(sequence=("ts", "seq"))


def _event_dimension(spark, sf_dir) -> DataFrame:
    log = standin.derived(standin.parquet(spark, sf_dir, "events"), _EVENT_CHANGE)
    return scd2.from_log(log, _EVENT_SPEC)


_EVENT_LOG_SQL = (
    f"WITH log AS (SELECT {', '.join(f'{e} AS {n}' for n, e in _EVENT_CHANGE.items())} FROM events)"
)

_VERSIONS_SQL = """,
    s AS (SELECT *, CASE WHEN op = 'U' THEN coalesce(name, '~') || '|' || coalesce(segment, '~')
                    || '|' || coalesce(city, '~') END AS state FROM log),
    p AS (SELECT *, lag(state) OVER (PARTITION BY customer_id ORDER BY {order}) AS prev FROM s),
    c AS (SELECT *, lead(effective_date) OVER (PARTITION BY customer_id ORDER BY {order}) AS nxt
          FROM p WHERE state IS DISTINCT FROM prev),
    dim AS (SELECT customer_id, name, segment, city, effective_date AS valid_from,
                   nxt AS valid_to, nxt IS NULL AS is_current,
                   sha256(concat_ws('||', name, segment, city)) AS record_hash
            FROM c WHERE state IS NOT NULL)
"""
_STEP_DIM_SQL = _ORDER_STEP_SQL + _VERSIONS_SQL.format(order="effective_date, seq")
_EVENT_DIM_SQL = _EVENT_LOG_SQL + _VERSIONS_SQL.format(order="ts, seq")


def _folded(spark, sf_dir):
    log = _order_steps(spark, sf_dir)
    return scd2.fold(scd2.empty(spark, log, _STEP_SPEC), log, [1, 2, 3], _STEP_SPEC)


def _lookup(spark, sf_dir):
    asked = standin.parquet(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("batch_id"))
    return scd2.log_contains(_order_feed(spark, sf_dir), asked)


register("change_feed_rows", _order_feed,
         _ORDER_FEED_SQL + f" SELECT {', '.join(_ORDER_CHANGE)} FROM log")
register("change_log_contains", _lookup, _ORDER_FEED_SQL + """
    SELECT n_nationkey AS batch_id, n_nationkey IN (SELECT batch_id FROM log) AS loaded
    FROM nation""")
register(
    "record_hash",
    lambda spark, sf_dir: _order_feed(spark, sf_dir).select(
        "batch_id", "customer_id", record_hash(["name", "segment", "city"]).alias("record_hash")
    ),
    _ORDER_FEED_SQL + """
    SELECT batch_id, customer_id, sha256(concat_ws('||', name, segment, city)) AS record_hash
    FROM log""",
)
register("scd2_apply_batches", _folded, _STEP_DIM_SQL + "SELECT * FROM dim")
register("scd2_from_log", _event_dimension, _EVENT_DIM_SQL + "SELECT * FROM dim")
register(
    "scd2_snapshot",
    lambda spark, sf_dir: scd2.snapshot(scd2.from_log(_order_steps(spark, sf_dir), _STEP_SPEC)),
    _STEP_DIM_SQL + """
    SELECT customer_id, name, segment, city, CAST(valid_from AS VARCHAR) AS valid_from,
           CAST(valid_to AS VARCHAR) AS valid_to, is_current FROM dim""",
)
register(
    "scd2_as_of",
    lambda spark, sf_dir: scd2.as_of(_event_dimension(spark, sf_dir), "2024-01-15"),
    _EVENT_DIM_SQL + """SELECT * FROM dim WHERE valid_from <= DATE '2024-01-15'
                        AND (valid_to IS NULL OR valid_to > DATE '2024-01-15')""",
)



def _events_as_of(spark, sf_dir) -> DataFrame:
    """Every event with its user's version of the day before."""
    events = standin.parquet(spark, sf_dir, "events").select("event_id", "user_id", "ts")
    joined = scd2.as_of_join(
        events, _event_dimension(spark, sf_dir), F.col("user_id"), F.date_sub(F.col("ts").cast("date"), 1), _EVENT_SPEC
    )
    return joined.select("event_id", "user_id", *[F.col(f"version.{c}").alias(c) for c in ("segment", "city", "valid_from", "valid_to")])


register("scd2_as_of_join", _events_as_of, _EVENT_DIM_SQL + """
    SELECT event_id, user_id, segment, city, valid_from, valid_to
    FROM events LEFT JOIN dim ON customer_id IS NOT DISTINCT FROM user_id AND valid_from <= CAST(ts AS DATE) - 1
        AND (valid_to IS NULL OR valid_to > CAST(ts AS DATE) - 1)""")

# --- policy -----------------------------------------------------------------------------

_EMAIL = """
    CASE CAST(c_custkey % 8 AS INT)
      WHEN 0 THEN NULL WHEN 1 THEN 'no-address' WHEN 2 THEN '@' || lower(c_mktsegment)
      WHEN 3 THEN lower(c_name) || '@' WHEN 4 THEN 'x@' || c_mktsegment || '@b' WHEN 5 THEN ''
      ELSE lower(c_name) || '@' || lower(c_mktsegment) || '.example' END"""
_MASKED = """
    CASE WHEN email IS NULL THEN NULL
         WHEN strpos(email, '@') <= 1 OR strpos(email, '@') = length(email) THEN '***'
         ELSE substring(email, 1, 1) || '***' || substring(email, strpos(email, '@')) END"""


def _contacts(spark, sf_dir) -> DataFrame:
    return standin.parquet(spark, sf_dir, "customer").select(
        "c_custkey", F.expr(_EMAIL).alias("email"), "c_mktsegment"
    )


_CONTACTS_SQL = f"WITH contacts AS (SELECT c_custkey, {_EMAIL} AS email, c_mktsegment FROM customer)"


def _seen(spark, sf_dir, *policies: str, extra: dict | None = None) -> DataFrame:
    """The contacts as a reader sees them under some policies."""
    access = policy.access(
        {"allow": True, "policies": policies}, {**policy.DEFAULT_RULES, **(extra or {})},
        {"tenant": "BUILDING"}, {"tenantColumn": "c_mktsegment"},
    )
    return access.view(_contacts(spark, sf_dir))


register(
    "mask_email",
    lambda spark, sf_dir: _contacts(spark, sf_dir).select(
        "c_custkey", mask_email(F.col("email")).alias("masked")
    ),
    _CONTACTS_SQL + f" SELECT c_custkey, {_MASKED} AS masked FROM contacts",
)
register(
    "masked_projection",
    lambda spark, sf_dir: _seen(spark, sf_dir, "pii-reader"),
    _CONTACTS_SQL + f" SELECT c_custkey, {_MASKED} AS email, c_mktsegment FROM contacts",
)
register(
    "tenant_filter",
    lambda spark, sf_dir: _seen(spark, sf_dir, "tenant-reader", "pii-reader"),
    _CONTACTS_SQL + f""" SELECT c_custkey, {_MASKED} AS email, c_mktsegment FROM contacts
                         WHERE c_mktsegment = 'BUILDING'""",
)
register(
    "column_allow",
    lambda spark, sf_dir: _seen(spark, sf_dir, "tenant-reader", "key-reader", extra={"key-reader": [
        {"kind": "column_allow", "name": "keys", "parameters": {"columns": ["c_custkey"]}}
    ]}),
    _CONTACTS_SQL + " SELECT c_custkey FROM contacts WHERE c_mktsegment = 'BUILDING'",
)

# --- query suites as data ---------------------------------------------------------------

# Events stand in for timings: three engines, one query per user, a rare failure.
_TIMING = {
    "engine": "'engine ' || CAST(user_id % 3 AS STRING)",
    "query": "'user ' || CAST(user_id AS STRING)",
    "success": "event_id % 197 <> 0",
    "duration_s": "value",
}
_TIMING_SQL = f"WITH t AS (SELECT {', '.join(f'{e} AS {n}' for n, e in _TIMING.items())} FROM events)"


def _timings(spark, sf_dir) -> DataFrame:
    return standin.derived(standin.parquet(spark, sf_dir, "events"), _TIMING)


register(
    "bench_median",
    lambda spark, sf_dir: suite.query_medians(_timings(spark, sf_dir)).withColumn(
        "duration_s", F.col("duration_s").cast("decimal(18,4)")
    ),
    _TIMING_SQL + """ SELECT engine, query, CAST(median(duration_s) AS DECIMAL(18,4)) AS duration_s
                      FROM t WHERE success GROUP BY engine, query""",
)
register(
    "bench_summary",
    lambda spark, sf_dir: suite.run_summary(_timings(spark, sf_dir)),
    _TIMING_SQL + """,
    q AS (SELECT engine, query, bool_and(success) AS ok,
                 CAST(median(duration_s) AS DECIMAL(28,6)) AS m FROM t GROUP BY engine, query)
    SELECT engine, count(*) AS queries, count(CASE WHEN ok THEN 1 END) AS succeeded,
           CAST(sum(CASE WHEN ok THEN m END) AS DECIMAL(38,6)) AS total_s
    FROM q GROUP BY engine""",
)


def _stored(spark, sf_dir, total: str, keep: str, ordinal: str) -> DataFrame:
    """Orders summed by priority and status, as the stored rows of one query per priority."""
    sums = standin.load(spark, sf_dir).orders.groupBy("o_orderpriority", "o_orderstatus").agg(
        F.count(F.lit(1)).alias("n"), F.sum("o_totalprice").alias("total")
    )
    return sums.where(keep).select(
        F.col("o_orderpriority").alias("query"), F.expr(ordinal).alias("ordinal"),
        F.array("o_orderstatus", F.col("n").cast("string"),
                F.expr(total).cast("decimal(20,3)").cast("string")).alias("cells"),
    )


_FORWARD = "instr('FOP', o_orderstatus)"


def _suite_verdicts(spark, sf_dir):
    ran = _stored(spark, sf_dir, "total", "true", _FORWARD)
    expected = _stored(
        spark, sf_dir,
        # within tolerance, then off by one
        "CASE o_orderpriority WHEN '1-URGENT' THEN total + 0.004 "
        "WHEN '4-NOT SPECIFIED' THEN total * 1.5 + 1 ELSE total END",
        # a missing row, and a query without any reference
        "NOT (o_orderpriority = '3-MEDIUM' AND o_orderstatus = 'P') AND o_orderpriority <> '5-LOW'",
        # rows in another order
        f"CASE WHEN o_orderpriority = '2-HIGH' THEN 4 - {_FORWARD} ELSE {_FORWARD} END",
    )
    outcomes = ran.select("query").distinct().select(
        "query", F.lit(True).alias("success"), F.lit(None).cast("string").alias("error")
    )
    return suite.verdicts(outcomes, ran, expected).select("query", "verdict")


register(
    "suite_verdicts",
    _suite_verdicts,
    "WITH " + standin.oracle_cte("orders") + """,
    a AS (SELECT o_orderpriority, o_orderstatus, count(*) AS n, sum(o_totalprice) AS total
          FROM v_orders GROUP BY ALL),
    b AS (SELECT o_orderpriority, o_orderstatus, n,
                 CASE o_orderpriority WHEN '1-URGENT' THEN total + 0.004
                 WHEN '4-NOT SPECIFIED' THEN total * 1.5 + 1 ELSE total END AS total
          FROM a WHERE NOT (o_orderpriority = '3-MEDIUM' AND o_orderstatus = 'P')
                   AND o_orderpriority <> '5-LOW'),
    j AS (SELECT a.o_orderpriority AS query, count(*) AS na, count(b.n) AS nb,
                 count(CASE WHEN abs(a.total - b.total)
                            <= greatest(0.01, 1e-9 * abs(b.total)) THEN 1 END) AS same
          FROM a LEFT JOIN b USING (o_orderpriority, o_orderstatus) GROUP BY 1)
    SELECT query, CASE WHEN nb = 0 OR na = same THEN 'PASSED' ELSE 'FAILED' END AS verdict FROM j""",
)

def _stored_rows(spark, sf_dir):
    """A query result as the stored rows of its evidence: every cell as text."""
    sums = standin.load(spark, sf_dir).orders.groupBy("o_orderpriority", "o_orderstatus").agg(
        F.count(F.lit(1)).alias("n"), F.sum("o_totalprice").alias("total"),
        F.max("o_orderdate").alias("last"),
        F.max(F.when(F.col("o_orderstatus") == "P", F.lit(True))).alias("partial"),
    )
    stored = tables.result_rows(sums.orderBy("o_orderpriority", "o_orderstatus"), "orders by state")
    return stored.select("query", "ordinal", F.array_join("cells", "|", "NULL").alias("cells"))


register("stored_rows", _stored_rows, "WITH " + standin.oracle_cte("orders") + """
    SELECT 'orders by state' AS query,
           row_number() OVER (ORDER BY o_orderpriority, o_orderstatus) - 1 AS ordinal,
           concat_ws('|', o_orderpriority, o_orderstatus, CAST(n AS VARCHAR),
                     CAST(total AS VARCHAR), CAST(last AS VARCHAR),
                     CASE WHEN o_orderstatus = 'P' THEN 'true' ELSE 'NULL' END) AS cells
    FROM (SELECT o_orderpriority, o_orderstatus, count(*) AS n, sum(o_totalprice) AS total,
                 max(o_orderdate) AS last FROM v_orders GROUP BY ALL)""")

# --- corpus -----------------------------------------------------------------------------

# Rules for the given prose; java, python and re2 read these patterns alike.
_TEXT_RULES = (
    corpus.Rule("mail_address", r"[A-Za-z0-9]@[A-Za-z0-9-]+\.[a-z]+", "mail", "PERSONAL", factors=("@",)),
    corpus.Rule("ip_address", r"[0-9]{1,3}(\.[0-9]{1,3}){3}", "network", "PERSONAL", factors=(".",)),
    corpus.Rule("license_line", r"(?i)licen[sc]e", "license", "LEGAL", factors=("licen",)),
    corpus.Rule("assigned_token", r"token = \"[0-9a-f]+", "secret", "SECRET", factors=("token = ",)),
    corpus.Rule("table_row", r"\|.*\|", "layout", "LAYOUT", factors=("|",)),
)


def _files(spark, sf_dir) -> DataFrame:
    return standin.parquet(spark, sf_dir, "documents").select(
        F.concat(F.col("source"), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt"))
        .alias("file"), "text", "lang", "source",
    )


def _findings(spark, sf_dir) -> DataFrame:
    return corpus.findings(_files(spark, sf_dir), _TEXT_RULES, python=False)


def _quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_LINES_SQL = r"""
    WITH l AS (SELECT file, lang, source, unnest(parts) AS body,
                      generate_subscripts(parts, 1) AS line, len(parts) AS n
               FROM (SELECT source || '/' || CAST(doc_id AS VARCHAR) || '.txt' AS file, lang, source,
                            string_split_regex(text, '\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e]') AS parts
                     FROM documents)),
    lines AS (SELECT * FROM l WHERE NOT (line = n AND body = ''))"""
_FINDINGS_SQL = _LINES_SQL + ",\n hits AS (" + " UNION ALL ".join(
    f"SELECT file, CAST(line AS INT) AS line, '{r.key}' AS rule, '{r.capability}' AS capability, "
    f"'{r.classification}' AS classification, '' AS alternative, "
    "trim(body) AS text FROM lines "
    f"WHERE regexp_matches(body, {_quote(r.pattern)})"
    for r in _TEXT_RULES
) + ")"

register("corpus_rule_hits", _findings, _FINDINGS_SQL + " SELECT * FROM hits")
register(
    "corpus_hits_by_class",
    lambda spark, sf_dir: corpus.hits_by_class(_findings(spark, sf_dir)),
    _FINDINGS_SQL + " SELECT classification, count(*) AS hits FROM hits GROUP BY 1",
)


def _loc(spark, sf_dir) -> DataFrame:
    files = _files(spark, sf_dir)
    counted = corpus.code_lines(
        files.withColumn("file", F.concat_ws("#", "file", "lang", "source")), python=False
    )
    # language and source travel in the file name, so no join is needed to get them back
    place = F.split("file", "#")
    return corpus.loc_totals(counted.select(
        F.when(place[1] == "en", "shared").otherwise(place[1]).alias("group"),
        place[2].alias("category"), "loc",
    ))


_LOC_SQL = _LINES_SQL + """,
    f AS (SELECT file, CASE WHEN lang = 'en' THEN 'shared' ELSE lang END AS grp, source,
                 count(CASE WHEN trim(body) <> '' AND NOT starts_with(trim(body), '#')
                            THEN 1 END) AS loc
          FROM lines GROUP BY ALL),
    t AS (SELECT grp AS "group", source AS category, count(*) AS files,
                 CAST(sum(loc) AS BIGINT) AS loc FROM f GROUP BY ALL)"""
register("corpus_loc", _loc, _LOC_SQL + " SELECT * FROM t")
register(
    "corpus_shared_ratio",
    lambda spark, sf_dir: corpus.shared_ratio(_loc(spark, sf_dir)),
    _LOC_SQL + """
    SELECT o."group", o.category, coalesce(s.loc, 0) AS shared_loc, o.loc AS specific_loc,
           round(coalesce(s.loc, 0) / nullif(coalesce(s.loc, 0) + o.loc, 0), 4) AS score
    FROM t o LEFT JOIN (SELECT * FROM t WHERE "group" = 'shared') s ON s.category = o.category
    WHERE o."group" <> 'shared'""",
)

# Code-shaped files: every line of a document becomes a function with a docstring, a comment
# and a statement that name a construct. These values are lines of the fixture.
_CONSTRUCTS = (
    'x = dbutils.widgets.get("a")', "display(x)", "from databricks.connect import DatabricksSession",
    "from databricks.sdk import WorkspaceClient", 'spark.conf.set("spark.databricks.io.cache", 1)',
    'open("/dbfs/tmp/a")', 'p = "/Volumes/a/b"', 'reader.format("cloudFiles")', "import dlt",
    "create streaming table a", "CREATE OR REPLACE MATERIALIZED VIEW v AS SELECT 1", "READ_FILES (x)",
    "select ai_query(m, p)", "vector_search(i)", "secret ( 'scope')", "CREATE TABLE t CLUSTER BY AUTO",
    "ALTER TABLE t SET ROW FILTER f", "select * from system.billing.usage",
    "CREATE OR REPLACE TABLE t LOCATION a", "ALTER TABLE t SET TBLPROPERTIES (a)", "# MAGIC %sql",
    "%sql", "x = my.display(1)", "x = 1", "redisplay(x)",
)
_KINDS, _MARKERS = ("py", "sql", "yml", "scala"), ("#", "--", "#", "//")


def _code_files(spark, sf_dir) -> DataFrame:
    """One file for each document: ``(file, text)``. The length of a text picks its kind."""
    docs = standin.parquet(spark, sf_dir, "documents").select(
        "doc_id", "source", F.coalesce(F.length("text") % len(_KINDS), F.lit(0)).alias("kind"),
        # once for the whole text; each line uses it several times
        F.split(F.regexp_replace("text", "[^A-Za-z0-9 \n]+", ""), "\n", -1).alias("plain"),
    )
    kind = F.col("kind")
    constructs = F.array(*map(F.lit, _CONSTRUCTS))
    marker = F.get(F.array(*map(F.lit, _MARKERS)), kind)

    def block(plain, i):
        construct = F.get(constructs, (F.length(plain) + i) % len(_CONSTRUCTS))
        return F.concat_ws(
            "\n", F.concat(F.lit("def f"), i.cast("string"), F.lit("(x):")),
            F.concat(F.lit('    """'), construct, F.lit(" "), plain, F.lit('."""')),
            F.concat(F.lit("    "), marker, F.lit(" "), construct),
            F.concat(F.when(i % 2 == 0, "").otherwise("    "), construct, F.lit("  "), marker, F.lit(" "), plain),
        )

    name = F.concat(
        F.lit("repo/"), F.coalesce("source", F.lit("none")), F.lit("/"), F.col("doc_id").cast("string"),
        F.lit("."), F.get(F.array(*map(F.lit, _KINDS)), kind),
    )
    return docs.select(
        name.alias("file"), F.concat_ws("\n", F.transform("plain", block)).alias("text")
    )


def _list(values) -> str:
    return "[" + ", ".join(map(_quote, values)) + "]"


_QUOTES = "repeat(chr(34), 3)"
_CODE_LINES_SQL = rf"""
    WITH d AS (SELECT source, doc_id, coalesce(length(text) % {len(_KINDS)}, 0) AS kind,
                      string_split(text, chr(10)) AS parts FROM documents),
    f AS (SELECT 'repo/' || coalesce(source, 'none') || '/' || CAST(doc_id AS VARCHAR) || '.'
                   || {_list(_KINDS)}[kind + 1] AS file, {_list(_KINDS)}[kind + 1] AS kind,
                 {_list(_MARKERS)}[kind + 1] AS marker, parts FROM d),
    b AS (SELECT file, kind, marker, generate_subscripts(parts, 1) - 1 AS i,
                 regexp_replace(unnest(parts), '[^A-Za-z0-9 ]', '', 'g') AS plain FROM f),
    c AS (SELECT *, {_list(_CONSTRUCTS)}[(length(plain) + i) % {len(_CONSTRUCTS)} + 1] AS construct FROM b),
    lines AS (
      SELECT file, kind, 4 * i + 1 AS line, 'def f' || CAST(i AS VARCHAR) || '(x):' AS body, false AS doc FROM c
      UNION ALL SELECT file, kind, 4 * i + 2, '    ' || {_QUOTES} || construct || ' ' || plain || '.' || {_QUOTES},
                       kind = 'py' FROM c
      UNION ALL SELECT file, kind, 4 * i + 3, '    ' || marker || ' ' || construct, false FROM c
      UNION ALL SELECT file, kind, 4 * i + 4,
                       CASE WHEN i % 2 = 0 THEN '' ELSE '    ' END || construct || '  ' || marker || ' ' || plain,
                       false FROM c),
    code AS (SELECT file, kind, CAST(line AS INT) AS line, body, trim(body) AS bare FROM lines WHERE NOT doc)"""

# re2 has no lookbehind; this says the same for a test.
_RE2 = {r.key: r.pattern for r in corpus.RULES} | {"display": r"(^|[^\w.])display\("}
_CODE_HITS_SQL = _CODE_LINES_SQL + ",\n hits AS (" + " UNION ALL ".join(
    f"SELECT file, line, '{r.key}' AS rule, {_quote(r.capability)} AS capability, "
    f"'{r.classification}' AS classification, {_quote(r.alternative)} AS alternative, bare AS text FROM code "
    f"WHERE regexp_matches(body, {_quote(_RE2[r.key])}) AND NOT ("
    "kind = 'py' AND starts_with(bare, '#') AND NOT contains(body, 'MAGIC') "
    "OR kind = 'yml' AND starts_with(bare, '#') OR kind = 'sql' AND starts_with(bare, '--'))"
    for r in corpus.RULES
) + ")"
register(
    "corpus_code_hits",
    lambda spark, sf_dir: corpus.findings(_code_files(spark, sf_dir)),
    _CODE_HITS_SQL + " SELECT * FROM hits",
)

# Path patterns of the code files; a file may stand in several groups.
_INVENTORY = {
    "shared": {"transformation": ["src?/*.py", "none/*.*"], "orchestration": ["src1?/*.py", "src1?/*.yml"]},
    "lakehouse": {"transformation": ["src*/*.sql"], "orchestration": ["src1?/*.yml", "src*/*.scala"]},
}


def _code_loc(spark, sf_dir) -> DataFrame:
    counted = corpus.code_lines(_code_files(spark, sf_dir))
    return corpus.loc_totals(corpus.classified(counted, "repo", _INVENTORY))


_PLACE_SQL = "(VALUES " + ", ".join(
    f"('{group}', '{category}', {_list('repo/' + p for p in patterns)})"
    for group, categories in _INVENTORY.items() for category, patterns in categories.items()
) + ') AS p("group", category, patterns)'
register(
    "corpus_code_loc", _code_loc,
    _CODE_LINES_SQL + f""",
    n AS (SELECT file, count(CASE WHEN bare <> '' AND NOT starts_with(
                         bare, CASE kind WHEN 'sql' THEN '--' ELSE '#' END) THEN 1 END) AS loc
          FROM code GROUP BY file),
    every AS (SELECT f.file, CASE WHEN f.parts IS NULL THEN 0 ELSE loc END AS loc FROM f LEFT JOIN n ON n.file = f.file)
    SELECT "group", category, count(*) AS files, CAST(sum(loc) AS BIGINT) AS loc
    FROM every, {_PLACE_SQL}
    WHERE len(list_filter(patterns, lambda g: file GLOB g)) > 0 GROUP BY ALL""",
)

# --- coverage and rules -----------------------------------------------------------------

_STATUS = (
    "CASE event_type WHEN 'purchase' THEN 'NATIVE' WHEN 'view' THEN 'ALTERNATIVE' "
    "WHEN 'click' THEN 'WORKAROUND' WHEN 'error' THEN 'MISSING' ELSE 'NOT_ASSESSED' END"
)
register(
    "coverage_rollup",
    lambda spark, sf_dir: coverage.coverage_rollup(
        standin.parquet(spark, sf_dir, "events"), "user_id", F.expr(_STATUS),
        F.col("event_id") % 2 == 0,
    ),
    f"""
    WITH e AS (SELECT user_id, {_STATUS} AS s, event_id % 2 = 0 AS req FROM events),
    c AS (SELECT user_id,
            {', '.join(f"count(CASE WHEN s = '{s}' THEN 1 END) AS {s.lower()}"
                       for s in coverage.STATUSES)},
            count(CASE WHEN s <> 'NOT_ASSESSED' THEN 1 END) AS total,
            count(CASE WHEN s IN ('NATIVE', 'ALTERNATIVE', 'WORKAROUND') THEN 1 END) AS covered,
            count(CASE WHEN req AND s IN ('NATIVE', 'ALTERNATIVE', 'WORKAROUND') THEN 1 END)
              AS required_covered,
            count(CASE WHEN req AND s <> 'NOT_ASSESSED' THEN 1 END) AS required_total
          FROM e GROUP BY user_id)
    SELECT *, round(covered / nullif(total, 0), 4) AS outcome_coverage,
           round(native / nullif(total, 0), 4) AS native_parity FROM c""",
)


def _violations(spark, sf_dir):
    events = standin.parquet(spark, sf_dir, "events").withColumn(
        "props", F.expr("CASE WHEN event_id % 9 <> 0 THEN props END")
    )
    lines = standin.parquet(spark, sf_dir, "lineitem")
    found = {
        "events": coverage.rule_violations(
            events, required=["props", "user_id"],
            allowed={"event_type": ["view", "click", "purchase"]}, unique=[["event_id"]],
        ),
        "lineitem": coverage.rule_violations(
            lines, required=["l_orderkey"], allowed={"l_returnflag": ["A", "N"]},
            unique=[["l_orderkey", "l_linenumber"]],
        ),
    }
    return found["events"].withColumn("table_name", F.lit("events")).unionByName(
        found["lineitem"].withColumn("table_name", F.lit("lineitem"))
    )


register("rule_violations", _violations, """
    SELECT 'events' AS table_name, 'required' AS rule, 'props' AS column_name,
           CAST(NULL AS VARCHAR) AS value, count(*) AS rows
    FROM events WHERE event_id % 9 = 0 OR props IS NULL HAVING count(*) > 0
    UNION ALL
    SELECT 'events', 'required', 'user_id', NULL, count(*) FROM events WHERE user_id IS NULL
    HAVING count(*) > 0
    UNION ALL
    SELECT 'lineitem', 'required', 'l_orderkey', NULL, count(*) FROM lineitem
    WHERE l_orderkey IS NULL HAVING count(*) > 0
    UNION ALL
    SELECT 'events', 'allowed', 'event_type', event_type, count(*) FROM events
    WHERE event_type NOT IN ('view', 'click', 'purchase') GROUP BY event_type
    UNION ALL
    SELECT 'lineitem', 'allowed', 'l_returnflag', l_returnflag, count(*) FROM lineitem
    WHERE l_returnflag NOT IN ('A', 'N') GROUP BY l_returnflag
    UNION ALL
    SELECT 'lineitem', 'unique', 'l_orderkey,l_linenumber', NULL,
           count(*) - count(DISTINCT (l_orderkey, l_linenumber))
    FROM lineitem HAVING count(*) > count(DISTINCT (l_orderkey, l_linenumber))""")

# --- streaming --------------------------------------------------------------------------


def _scratch(spark) -> str:
    """A new folder below the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark)}/varve-{uuid.uuid4().hex}"


def _stream_bronze(spark, sf_dir):
    """The events file as a stream into a bronze folder."""
    base = _scratch(spark)
    schema = standin.parquet(spark, sf_dir, "events").schema
    stream = ingest.read_files(spark, f"{sf_dir}/event[s].parquet", schema)
    ingest.to_bronze(stream, f"{base}/table", f"{base}/progress", "stream-1")
    return spark.read.parquet(f"{base}/table").select(
        "event_id", "user_id", "event_type", "value", "_batch_id",
        F.regexp_extract("_source_file", "[^/]+$", 0).alias("_source_file"),
    )


#: Most rows of one change file.
_FEED_ROWS = 500_000
_STEP_SCHEMA = f"{changes.SCHEMA}, seq BIGINT"


def _order_store(spark, base: str, name: str) -> DimensionStore:
    return DimensionStore(spark, f"{base}/{name}", _STEP_SCHEMA, _STEP_SPEC)


def _store_dimension(spark, sf_dir):
    """The order log ingested batch by batch and applied from the stored log."""
    store = _order_store(spark, _scratch(spark), "dimension")
    log = _order_steps(spark, sf_dir)
    for batch_id in (1, 2, 3):
        store.ingest(batch_id, log.where(F.col("batch_id") == batch_id))
        store.apply_pending()
    return store.dimension()


def _stream_dimension(spark, sf_dir):
    """The order log as change files that a stream folds into the dimension.

    At least six files in three micro-batches, and more files where there are more orders, so
    that a micro-batch has work for many tasks.
    """
    base = _scratch(spark)
    log = _order_steps(spark, sf_dir)
    each = max(1, min(_FEED_ROWS, -(-log.count() // 6)))
    log.write.option("maxRecordsPerFile", each).parquet(f"{base}/feed")
    store = _order_store(spark, base, "dimension")
    files = len(spark.read.schema(store.changes_schema).parquet(f"{base}/feed").inputFiles())
    stream = ingest.read_files(
        spark, f"{base}/feed", store.changes_schema, max_files=-(-files // 3)
    )
    ingest.to_dimension(stream, store, f"{base}/progress")
    return store.dimension()


def _replayed(spark, sf_dir):
    """The order log fed to a store batch by batch, and all of it again."""
    log = _order_steps(spark, sf_dir)
    return workload.incremental_replay(
        _order_store(spark, _scratch(spark), "dimension"),
        {b: log.where(F.col("batch_id") == b) for b in (1, 2, 3)},
    )


register(
    "incremental_replay", _replayed,
    _STEP_DIM_SQL + """,
    b AS (SELECT * FROM (VALUES (1, DATE '1998-01-01'), (2, DATE '2000-01-01'), (3, NULL)) AS v(batch_id, until))
    SELECT b.batch_id, true AS added, true AS applied, true AS refused_again, false AS applied_again,
           count(*) AS versions,
           count(CASE WHEN c.nxt IS NULL OR c.nxt >= b.until THEN 1 END) AS current_versions,
           CAST(0 AS BIGINT) AS unlike_log
    FROM b JOIN c ON c.batch_id <= b.batch_id AND c.state IS NOT NULL GROUP BY b.batch_id""",
)
register("scd2_store", _store_dimension, _STEP_DIM_SQL + "SELECT * FROM dim")
register("stream_scd2", _stream_dimension, _STEP_DIM_SQL + "SELECT * FROM dim")

register("stream_bronze", _stream_bronze, """
    SELECT event_id, user_id, event_type, value, 'stream-1' AS _batch_id,
           'events.parquet' AS _source_file FROM events""")
