"""The eight canonical tables, derived from a narrower star schema.

The given parquet tables hold fewer columns than the declared schema, keep money as
DOUBLE and dates as midnight timestamps, and have no ``partsupp``. Each missing column
is derived by a row-local expression, so the canonical queries run unchanged on them.

The expressions are ANSI SQL that Spark and DuckDB both parse. ``load`` applies them as
a projection over the scan: Catalyst prunes what a query does not read and pushes date
ranges through the cast to the parquet reader.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from varve import schema


class Tables:
    """The eight tables as DataFrames, each read on first use.

    ``read`` maps a table name to a DataFrame: over paths, the catalog or derived columns.
    """

    def __init__(self, read: Callable[[str], DataFrame]):
        self._read = read
        self._seen: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_") or name not in schema.COLUMNS:
            raise AttributeError(name)
        if name not in self._seen:
            self._seen[name] = self._read(name)
        return self._seen[name]

    def items(self) -> list[tuple[str, DataFrame]]:
        return [(name, getattr(self, name)) for name in schema.tables()]

    def replaced(self, **frames: DataFrame) -> Tables:
        """The same tables with some of them exchanged."""
        return Tables(lambda name: frames[name] if name in frames else getattr(self, name))


def _choice(key: str, *values: str) -> str:
    arms = " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values))
    return f"CASE CAST(({key}) % {len(values)} AS INT) {arms} END"


def _money(column: str) -> str:
    return f"CAST({column} AS DECIMAL(15,2))"


def _text(column: str) -> str:
    return f"CAST({column} AS STRING)"


def _phone(nation: str, key: str) -> str:
    return (
        f"{_text(f'10 + {nation}')} || '-' || lpad({_text(f'{key} % 1000')}, 3, '0') "
        f"|| '-' || lpad({_text(f'({key} * 7) % 10000')}, 4, '0')"
    )


# output column -> expression over the given table, in declared order
PROJECTIONS: dict[str, dict[str, str]] = {
    "region": {
        "r_regionkey": "r_regionkey",
        "r_name": "r_name",
        "r_comment": "'region ' || r_name",
    },
    "nation": {
        "n_nationkey": "n_nationkey",
        "n_name": "n_name",
        "n_regionkey": "n_regionkey",
        "n_comment": "'nation ' || n_name",
    },
    "supplier": {
        "s_suppkey": "s_suppkey",
        "s_name": "s_name",
        "s_address": f"'Dock ' || {_text('s_suppkey % 97')}",
        "s_nationkey": "s_nationkey",
        "s_phone": _phone("s_nationkey", "s_suppkey"),
        "s_acctbal": _money("s_acctbal"),
        "s_comment": (
            "CASE WHEN s_acctbal < 0 THEN 'Customer filed Complaints' ELSE 'in good standing' END"
        ),
    },
    "customer": {
        "c_custkey": "c_custkey",
        "c_name": "c_name",
        "c_address": f"'Quay ' || {_text('c_custkey % 89')}",
        "c_nationkey": "c_nationkey",
        "c_phone": _phone("c_nationkey", "c_custkey"),
        "c_acctbal": _money("c_acctbal"),
        "c_mktsegment": "c_mktsegment",
        "c_comment": "'buys for ' || c_mktsegment",
    },
    "part": {
        "p_partkey": "p_partkey",
        "p_name": "p_name",
        "p_mfgr": f"'Manufacturer#' || {_text('1 + p_partkey % 5')}",
        "p_brand": "p_brand",
        "p_type": "p_type",
        "p_size": "p_size",
        "p_container": _choice("p_partkey", "SM CASE", "MED BOX", "LG PACK", "SM BOX", "MED PKG",
                               "LG CASE", "SM PKG", "MED BAG", "LG BOX", "JUMBO JAR"),
        "p_retailprice": _money("p_retailprice"),
        "p_comment": "'part ' || p_name",
    },
    "orders": {
        "o_orderkey": "o_orderkey",
        "o_custkey": "o_custkey",
        "o_orderstatus": "o_orderstatus",
        "o_totalprice": _money("o_totalprice"),
        "o_orderdate": "CAST(o_orderdate AS DATE)",
        "o_orderpriority": "o_orderpriority",
        "o_clerk": f"'Clerk#' || lpad({_text('o_custkey % 1000')}, 9, '0')",
        "o_shippriority": "0",
        "o_comment": (
            "CASE WHEN o_orderpriority LIKE '%URGENT%' THEN 'special handling requests' "
            "ELSE 'plain order' END"
        ),
    },
    "lineitem": {
        "l_orderkey": "l_orderkey",
        "l_partkey": "l_partkey",
        "l_suppkey": "l_suppkey",
        "l_linenumber": "CAST(l_linenumber AS BIGINT)",
        "l_quantity": _money("l_quantity"),
        "l_extendedprice": _money("l_extendedprice"),
        "l_discount": _money("l_discount"),
        "l_tax": _money("l_tax"),
        "l_returnflag": "l_returnflag",
        "l_linestatus": "l_linestatus",
        "l_shipdate": "CAST(l_shipdate AS DATE)",
        "l_commitdate": "CAST(l_shipdate AS DATE) + CAST(l_partkey % 60 - 20 AS INT)",
        "l_receiptdate": "CAST(l_shipdate AS DATE) + CAST(1 + l_suppkey % 30 AS INT)",
        "l_shipinstruct": _choice("l_suppkey + l_linenumber", "DELIVER IN PERSON",
                                  "COLLECT COD", "NONE", "TAKE BACK RETURN"),
        "l_shipmode": _choice("l_partkey + l_linenumber", "MAIL", "SHIP", "AIR", "AIR REG",
                              "RAIL", "TRUCK", "FOB"),
        "l_comment": f"'line ' || {_text('l_linenumber')}",
    },
}

# partsupp: one row per (part, supplier) pair seen on any line
PARTSUPP_AGGREGATES: dict[str, str] = {
    "ps_availqty": "CAST(sum(l_quantity) AS BIGINT)",
    "ps_supplycost": _money("min(l_extendedprice)"),
}
PARTSUPP_COMMENT = f"'pair ' || {_text('ps_partkey % 10')}"


# Schemas of the given files. Declaring them saves a job per read that opens a footer.
GIVEN: dict[str, str] = {
    "region": "r_regionkey INT, r_name STRING",
    "nation": "n_nationkey INT, n_name STRING, n_regionkey INT",
    "supplier": "s_suppkey BIGINT, s_name STRING, s_nationkey INT, s_acctbal DOUBLE",
    "customer": (
        "c_custkey BIGINT, c_name STRING, c_nationkey INT, c_acctbal DOUBLE, c_mktsegment STRING"
    ),
    "part": (
        "p_partkey BIGINT, p_name STRING, p_brand STRING, p_type STRING, p_size INT, "
        "p_retailprice DOUBLE"
    ),
    "orders": (
        "o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus STRING, o_totalprice DOUBLE, "
        "o_orderdate TIMESTAMP_NTZ, o_orderpriority STRING"
    ),
    "lineitem": (
        "l_orderkey BIGINT, l_partkey BIGINT, l_suppkey BIGINT, l_linenumber INT, "
        "l_quantity DOUBLE, l_extendedprice DOUBLE, l_discount DOUBLE, l_tax DOUBLE, "
        "l_returnflag STRING, l_linestatus STRING, l_shipdate TIMESTAMP_NTZ"
    ),
    "events": (
        "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE, "
        "props STRING"
    ),
    "documents": "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT",
}


def _path(sf_dir: str, table: str) -> str:
    return f"{sf_dir.rstrip('/')}/{table}.parquet"


def parquet(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A given file with its known schema."""
    return spark.read.schema(GIVEN[table]).parquet(_path(sf_dir, table))


def inferred(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A given file with whatever schema it has."""
    return spark.read.parquet(_path(sf_dir, table))


def derived(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Select named expressions. A column under its own name gets no alias: an alias would
    make two uses of one plan look different and keep them from sharing an exchange."""
    return df.selectExpr(
        *[name if expression == name else f"{expression} AS {name}"
          for name, expression in columns.items()]
    )


def load(spark: SparkSession, sf_dir: str) -> Tables:
    """All eight tables, lazily, over the given directory."""

    def read(table: str) -> DataFrame:
        if table == "partsupp":
            return partsupp(parquet(spark, sf_dir, "lineitem"))
        columns = PROJECTIONS[table]
        return derived(parquet(spark, sf_dir, table), columns)

    return Tables(read)


def partsupp(raw_lineitem: DataFrame) -> DataFrame:
    pairs = (
        raw_lineitem
        .groupBy(F.col("l_partkey").alias("ps_partkey"), F.col("l_suppkey").alias("ps_suppkey"))
        .agg(*[F.expr(e).alias(n) for n, e in PARTSUPP_AGGREGATES.items()])
    )
    return pairs.selectExpr("*", f"{PARTSUPP_COMMENT} AS ps_comment")


def oracle_cte(table: str) -> str:
    """The same projection as a DuckDB common table expression named ``v_<table>``."""
    if table == "partsupp":
        aggregates = ", ".join(f"{e} AS {n}" for n, e in PARTSUPP_AGGREGATES.items())
        return (
            f"v_partsupp AS (SELECT *, {PARTSUPP_COMMENT} AS ps_comment FROM ("
            f"SELECT l_partkey AS ps_partkey, l_suppkey AS ps_suppkey, {aggregates} "
            f"FROM lineitem GROUP BY 1, 2))"
        )
    body = ", ".join(f"{e} AS {n}" for n, e in PROJECTIONS[table].items())
    return f"v_{table} AS (SELECT {body} FROM {table})"
