"""Queries over the warehouse tables: gold layer and the 22 decision-support queries."""

from __future__ import annotations

from varve.plans import gold, variants
from varve.plans.registry import register
from varve.sources import standin


def _gold(spark, sf_dir):
    t = standin.load(spark, sf_dir)
    return gold.revenue_by_nation_year(t.orders, t.lineitem, t.customer, t.nation)


GOLD_SQL = """
    SELECT n_name AS nation, CAST(year(o_orderdate) AS INT) AS order_year,
           count(DISTINCT o_orderkey) AS orders,
           CAST(sum(l_quantity) AS DECIMAL(25,2)) AS quantity,
           CAST(sum(l_extendedprice * (1 - l_discount)) AS DECIMAL(38,4)) AS net_revenue
    FROM {orders} JOIN {lineitem} ON l_orderkey = o_orderkey
    JOIN {customer} ON c_custkey = o_custkey JOIN {nation} ON n_nationkey = c_nationkey
    GROUP BY ALL"""


def with_views(tables: list[str], body: str) -> str:
    """A DuckDB text whose ``{table}`` placeholders read the stand-in projections."""
    ctes = ",\n".join(standin.oracle_cte(t) for t in tables)
    return f"WITH {ctes}\n" + body.format(**{t: f"v_{t}" for t in tables}).strip()


GOLD_TABLES = ["orders", "lineitem", "customer", "nation"]
GOLD_ORACLE = with_views(GOLD_TABLES, GOLD_SQL)

register("gold_revenue_by_nation_year", _gold, GOLD_ORACLE)

for _name in variants.PARAMETERS:
    register(
        f"tpch_{_name}",
        lambda spark, sf_dir, name=_name: variants.run(name, standin.load(spark, sf_dir)),
        variants.oracle(_name),
    )

register(
    "tpch_q22_recent_orders",
    lambda spark, sf_dir: variants.idle_customers(standin.load(spark, sf_dir)),
    variants.oracle("q22", variants.RECENT_ORDERS),
)
