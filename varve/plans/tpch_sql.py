"""The 22 queries as ANSI SQL text that Spark and DuckDB both run.

The DataFrame plans in ``varve.plans.tpch`` are what the library runs at scale; these
texts say the same in SQL, for users who bring SQL, and as the oracle the plans are
tested against. ``text`` fills in the parameters and, when asked, other table names.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from varve import schema
from varve.plans.tpch import PARAMETERS

_NET = "l_extendedprice * (1 - l_discount)"

TEXTS: dict[str, str] = {
    "q01": f"""
        WITH s AS (
          SELECT l_returnflag, l_linestatus, count(*) AS n,
                 CAST(sum(l_quantity) AS DECIMAL(38,2)) AS qty,
                 CAST(sum(l_extendedprice) AS DECIMAL(38,2)) AS base,
                 CAST(sum({_NET}) AS DECIMAL(38,4)) AS disc_price,
                 CAST(sum({_NET} * (1 + l_tax)) AS DECIMAL(38,6)) AS charge,
                 CAST(sum(l_discount) AS DECIMAL(38,2)) AS disc
          FROM [lineitem] WHERE l_shipdate <= DATE '{{until}}' - INTERVAL '{{days}}' DAY
          GROUP BY l_returnflag, l_linestatus)
        SELECT l_returnflag, l_linestatus, qty AS sum_qty, base AS sum_base_price,
               disc_price AS sum_disc_price, charge AS sum_charge,
               CAST(CAST(qty AS DOUBLE) / n AS DECIMAL(19,6)) AS avg_qty,
               CAST(CAST(base AS DOUBLE) / n AS DECIMAL(19,6)) AS avg_price,
               CAST(CAST(disc AS DOUBLE) / n AS DECIMAL(19,6)) AS avg_disc, n AS count_order
        FROM s ORDER BY l_returnflag, l_linestatus""",
    "q02": """
        WITH offer AS (
          SELECT ps_partkey, ps_suppkey, ps_supplycost, s_acctbal, s_name, n_name, s_address,
                 s_phone, s_comment
          FROM [partsupp]
          JOIN [supplier] ON s_suppkey = ps_suppkey
          JOIN [nation] ON n_nationkey = s_nationkey
          JOIN [region] ON r_regionkey = n_regionkey AND r_name = '{region}')
        SELECT s_acctbal, s_name, n_name, p_partkey, p_mfgr, s_address, s_phone, s_comment
        FROM [part] JOIN offer o ON o.ps_partkey = p_partkey
        WHERE p_size = {size} AND p_type LIKE '%{type_suffix}'
          AND o.ps_supplycost = (SELECT min(i.ps_supplycost) FROM offer i
                                 WHERE i.ps_partkey = p_partkey)
        ORDER BY s_acctbal DESC, n_name, s_name, p_partkey LIMIT {top}""",
    "q03": f"""
        SELECT l_orderkey, CAST(sum({_NET}) AS DECIMAL(38,4)) AS revenue, o_orderdate, o_shippriority
        FROM [lineitem]
        JOIN [orders] ON o_orderkey = l_orderkey AND o_orderdate < DATE '{{date}}'
        JOIN [customer] ON c_custkey = o_custkey AND c_mktsegment = '{{segment}}'
        WHERE l_shipdate > DATE '{{date}}'
        GROUP BY l_orderkey, o_orderdate, o_shippriority
        ORDER BY revenue DESC, o_orderdate, l_orderkey LIMIT {{top}}""",
    "q04": """
        SELECT o_orderpriority, count(*) AS order_count FROM [orders]
        WHERE o_orderdate >= DATE '{start}' AND o_orderdate < DATE '{start}' + INTERVAL {span}
          AND EXISTS (SELECT 1 FROM [lineitem]
                      WHERE l_orderkey = o_orderkey AND l_commitdate < l_receiptdate)
        GROUP BY o_orderpriority ORDER BY o_orderpriority""",
    "q05": f"""
        SELECT n_name, CAST(sum({_NET}) AS DECIMAL(38,4)) AS revenue
        FROM [lineitem]
        JOIN [orders] ON o_orderkey = l_orderkey
        JOIN [customer] ON c_custkey = o_custkey
        JOIN [supplier] ON s_suppkey = l_suppkey AND s_nationkey = c_nationkey
        JOIN [nation] ON n_nationkey = s_nationkey
        JOIN [region] ON r_regionkey = n_regionkey AND r_name = '{{region}}'
        WHERE o_orderdate >= DATE '{{start}}' AND o_orderdate < DATE '{{start}}' + INTERVAL {{span}}
        GROUP BY n_name ORDER BY revenue DESC""",
    "q06": """
        SELECT CAST(sum(l_extendedprice * l_discount) AS DECIMAL(38,4)) AS revenue FROM [lineitem]
        WHERE l_shipdate >= DATE '{start}' AND l_shipdate < DATE '{start}' + INTERVAL {span}
          AND l_discount BETWEEN {low} AND {high} AND l_quantity < {quantity}""",
    "q07": f"""
        SELECT a.n_name AS supp_nation, b.n_name AS cust_nation,
               CAST(extract(YEAR FROM l_shipdate) AS INT) AS l_year,
               CAST(sum({_NET}) AS DECIMAL(38,4)) AS revenue
        FROM [lineitem]
        JOIN [supplier] ON s_suppkey = l_suppkey
        JOIN [nation] a ON a.n_nationkey = s_nationkey
        JOIN [orders] ON o_orderkey = l_orderkey
        JOIN [customer] ON c_custkey = o_custkey
        JOIN [nation] b ON b.n_nationkey = c_nationkey
        WHERE l_shipdate BETWEEN DATE '{{start}}' AND DATE '{{end}}'
          AND (a.n_name = '{{first}}' AND b.n_name = '{{second}}'
               OR a.n_name = '{{second}}' AND b.n_name = '{{first}}')
        GROUP BY 1, 2, 3 ORDER BY 1, 2, 3""",
    "q08": f"""
        WITH sale AS (
          SELECT CAST(extract(YEAR FROM o_orderdate) AS INT) AS o_year, {_NET} AS volume,
                 origin.n_name AS nation
          FROM [lineitem]
          JOIN [part] ON p_partkey = l_partkey AND p_type = '{{part_type}}'
          JOIN [supplier] ON s_suppkey = l_suppkey
          JOIN [nation] origin ON origin.n_nationkey = s_nationkey
          JOIN [orders] ON o_orderkey = l_orderkey
          JOIN [customer] ON c_custkey = o_custkey
          JOIN [nation] home ON home.n_nationkey = c_nationkey
          JOIN [region] ON r_regionkey = home.n_regionkey AND r_name = '{{region}}'
          WHERE o_orderdate BETWEEN DATE '{{start}}' AND DATE '{{end}}')
        SELECT o_year,
               round(CAST(sum(CASE WHEN nation = '{{nation}}' THEN volume ELSE 0 END) AS DOUBLE)
                     / CAST(sum(volume) AS DOUBLE), 4) AS mkt_share
        FROM sale GROUP BY o_year ORDER BY o_year""",
    "q09": f"""
        SELECT n_name AS nation, CAST(extract(YEAR FROM o_orderdate) AS INT) AS o_year,
               CAST(sum({_NET} - ps_supplycost * l_quantity) AS DECIMAL(38,4)) AS sum_profit
        FROM [lineitem]
        JOIN [part] ON p_partkey = l_partkey AND p_name LIKE '%{{word}}%'
        JOIN [partsupp] ON ps_partkey = l_partkey AND ps_suppkey = l_suppkey
        JOIN [supplier] ON s_suppkey = l_suppkey
        JOIN [nation] ON n_nationkey = s_nationkey
        JOIN [orders] ON o_orderkey = l_orderkey
        GROUP BY 1, 2 ORDER BY 1, 2 DESC""",
    "q10": f"""
        SELECT c_custkey, c_name, CAST(sum({_NET}) AS DECIMAL(38,4)) AS revenue, c_acctbal, n_name,
               c_address, c_phone, c_comment
        FROM [lineitem]
        JOIN [orders] ON o_orderkey = l_orderkey
        JOIN [customer] ON c_custkey = o_custkey
        JOIN [nation] ON n_nationkey = c_nationkey
        WHERE l_returnflag = '{{flag}}'
          AND o_orderdate >= DATE '{{start}}' AND o_orderdate < DATE '{{start}}' + INTERVAL {{span}}
        GROUP BY c_custkey, c_name, c_acctbal, c_phone, n_name, c_address, c_comment
        ORDER BY revenue DESC, c_custkey LIMIT {{top}}""",
    "q11": """
        WITH stock AS (
          SELECT ps_partkey, CAST(sum(ps_supplycost * ps_availqty) AS DECIMAL(38,2)) AS value
          FROM [partsupp]
          JOIN [supplier] ON s_suppkey = ps_suppkey
          JOIN [nation] ON n_nationkey = s_nationkey AND n_name = '{nation}'
          GROUP BY ps_partkey)
        SELECT ps_partkey, value FROM stock
        WHERE value > (SELECT CAST(sum(value) AS DECIMAL(26,2)) * {fraction} FROM stock)
        ORDER BY value DESC, ps_partkey""",
    "q12": """
        SELECT l_shipmode,
               count(CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 1 END)
                 AS high_line_count,
               count(CASE WHEN o_orderpriority NOT IN ('1-URGENT', '2-HIGH') THEN 1 END)
                 AS low_line_count
        FROM [lineitem] JOIN [orders] ON o_orderkey = l_orderkey
        WHERE l_shipmode IN ({modes}) AND l_shipdate < l_commitdate AND l_commitdate < l_receiptdate
          AND l_receiptdate >= DATE '{start}' AND l_receiptdate < DATE '{start}' + INTERVAL {span}
        GROUP BY l_shipmode ORDER BY l_shipmode""",
    "q13": """
        WITH placed AS (
          SELECT c_custkey, count(o_orderkey) AS c_count
          FROM [customer] LEFT JOIN [orders]
            ON o_custkey = c_custkey AND o_comment NOT LIKE '%{first}%{second}%'
          GROUP BY c_custkey)
        SELECT c_count, count(*) AS custdist FROM placed
        GROUP BY c_count ORDER BY custdist DESC, c_count DESC""",
    "q14": f"""
        SELECT round(100 * CAST(sum(CASE WHEN p_type LIKE '{{prefix}}%' THEN {_NET} ELSE 0 END)
                                AS DOUBLE) / CAST(sum({_NET}) AS DOUBLE), 4) AS promo_revenue
        FROM [lineitem] JOIN [part] ON p_partkey = l_partkey
        WHERE l_shipdate >= DATE '{{start}}' AND l_shipdate < DATE '{{start}}' + INTERVAL {{span}}""",
    "q15": f"""
        WITH revenue AS (
          SELECT l_suppkey AS supplier_no, CAST(sum({_NET}) AS DECIMAL(38,4)) AS total_revenue
          FROM [lineitem]
          WHERE l_shipdate >= DATE '{{start}}' AND l_shipdate < DATE '{{start}}' + INTERVAL {{span}}
          GROUP BY l_suppkey)
        SELECT s_suppkey, s_name, s_address, s_phone, total_revenue
        FROM revenue JOIN [supplier] ON s_suppkey = supplier_no
        WHERE total_revenue = (SELECT max(total_revenue) FROM revenue)
        ORDER BY s_suppkey""",
    "q16": """
        SELECT p_brand, p_type, p_size, count(DISTINCT ps_suppkey) AS supplier_cnt
        FROM [partsupp] JOIN [part] ON p_partkey = ps_partkey
        WHERE p_brand <> '{brand}' AND p_type NOT LIKE '{type_prefix}%' AND p_size IN ({sizes})
          AND ps_suppkey NOT IN (SELECT s_suppkey FROM [supplier]
                                 WHERE s_comment LIKE '%{first}%{second}%')
        GROUP BY p_brand, p_type, p_size
        ORDER BY supplier_cnt DESC, p_brand, p_type, p_size""",
    "q17": """
        WITH usual AS (
          SELECT l_partkey AS part, CAST(sum(l_quantity) AS DECIMAL(28,2)) AS quantity, count(*) AS n
          FROM [lineitem] GROUP BY l_partkey)
        SELECT round(CAST(sum(l_extendedprice) AS DOUBLE) / 7.0, 4) AS avg_yearly
        FROM [lineitem] JOIN [part] ON p_partkey = l_partkey JOIN usual ON part = l_partkey
        WHERE p_brand = '{brand}' AND p_container = '{container}'
          AND l_quantity * n < {fraction} * quantity""",
    "q18": """
        SELECT c_name, c_custkey, o_orderkey, o_orderdate, o_totalprice,
               CAST(sum(l_quantity) AS DECIMAL(38,2)) AS sum_quantity
        FROM [orders]
        JOIN [customer] ON c_custkey = o_custkey
        JOIN [lineitem] ON l_orderkey = o_orderkey
        WHERE o_orderkey IN (SELECT l_orderkey FROM [lineitem] GROUP BY l_orderkey
                             HAVING sum(l_quantity) > {quantity})
        GROUP BY c_name, c_custkey, o_orderkey, o_orderdate, o_totalprice
        ORDER BY o_totalprice DESC, o_orderdate, o_orderkey LIMIT {top}""",
    "q19": f"""
        SELECT CAST(sum({_NET}) AS DECIMAL(38,4)) AS revenue
        FROM [lineitem] JOIN [part] ON p_partkey = l_partkey
        WHERE l_shipmode IN ({{modes}}) AND l_shipinstruct = '{{instruct}}' AND ({{offers}})""",
    "q20": """
        WITH shipped AS (
          SELECT l_partkey, l_suppkey, sum(l_quantity) AS quantity FROM [lineitem]
          WHERE l_shipdate >= DATE '{start}' AND l_shipdate < DATE '{start}' + INTERVAL {span}
          GROUP BY l_partkey, l_suppkey)
        SELECT s_name, s_address FROM [supplier]
        JOIN [nation] ON n_nationkey = s_nationkey AND n_name = '{nation}'
        WHERE s_suppkey IN (
          SELECT ps_suppkey FROM [partsupp]
          JOIN shipped ON l_partkey = ps_partkey AND l_suppkey = ps_suppkey
          WHERE ps_availqty > 0.5 * quantity
            AND ps_partkey IN (SELECT p_partkey FROM [part] WHERE p_name LIKE '{prefix}%'))
        ORDER BY s_name""",
    "q21": """
        SELECT s_name, count(*) AS numwait
        FROM [lineitem] mine
        JOIN [orders] ON o_orderkey = mine.l_orderkey AND o_orderstatus = '{status}'
        JOIN [supplier] ON s_suppkey = mine.l_suppkey
        JOIN [nation] ON n_nationkey = s_nationkey AND n_name = '{nation}'
        WHERE mine.l_receiptdate > mine.l_commitdate
          AND EXISTS (SELECT 1 FROM [lineitem] other WHERE other.l_orderkey = mine.l_orderkey
                      AND other.l_suppkey <> mine.l_suppkey)
          AND NOT EXISTS (SELECT 1 FROM [lineitem] late WHERE late.l_orderkey = mine.l_orderkey
                          AND late.l_suppkey <> mine.l_suppkey
                          AND late.l_receiptdate > late.l_commitdate)
        GROUP BY s_name ORDER BY numwait DESC, s_name LIMIT {top}""",
    "q22": """
        WITH called AS (
          SELECT c_custkey, c_acctbal, substring(c_phone, 1, 2) AS cntrycode FROM [customer]
          WHERE substring(c_phone, 1, 2) IN ({codes}))
        SELECT cntrycode, count(*) AS numcust, CAST(sum(c_acctbal) AS DECIMAL(38,2)) AS totacctbal
        FROM called
        WHERE c_acctbal > (SELECT avg(c_acctbal) FROM called WHERE c_acctbal > 0)
          AND NOT EXISTS (SELECT 1 FROM [orders] WHERE o_custkey = c_custkey)
        GROUP BY cntrycode ORDER BY cntrycode""",
}


def _literals(values) -> str:
    return ", ".join(str(v) if isinstance(v, int) else f"'{v}'" for v in values)


def _offer(brand: str, containers, quantity: int, size: int) -> str:
    return (
        f"p_brand = '{brand}' AND p_container IN ({_literals(containers)}) AND l_quantity BETWEEN "
        f"{quantity} AND {quantity + 10} AND p_size BETWEEN 1 AND {size}"
    )


def _render(key: str, value) -> str:
    if key == "offers":
        return " OR ".join(f"({_offer(*offer)})" for offer in value)
    return _literals(value) if isinstance(value, tuple) else str(value)


def table_names(name: str) -> list[str]:
    """Tables a query reads."""
    return [t for t in schema.tables() if f"[{t}]" in TEXTS[name]]


def text(name: str, table=lambda t: t, **overrides) -> str:
    """SQL of a query; ``table`` maps a canonical table name to the name to read."""
    values = {k: _render(k, v) for k, v in {**PARAMETERS[name], **overrides}.items()}
    filled = re.sub(r"\[(\w+)\]", lambda m: table(m.group(1)), TEXTS[name]).format(**values)
    return "\n".join(line.strip() for line in filled.strip().splitlines())


def run_sql(spark: SparkSession, name: str, table=lambda t: t, **overrides) -> DataFrame:
    """The SQL text on Spark, over tables or views of the given names."""
    return spark.sql(text(name, table, **overrides))
