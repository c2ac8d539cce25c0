"""Parameters under which the 22 queries select rows from the stand-in tables.

The given tables have other nation names, brands, part types and dates than the
specification's generator, so its validation parameters would select nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varve.plans import tpch, tpch_sql
from varve.sources import standin

PARAMETERS: dict[str, dict] = {
    "q01": {},
    "q02": {"type_suffix": "UM"},
    "q03": {"date": "1998-03-15"},
    "q04": {"start": "1996-07-01"},
    "q05": {"start": "1996-01-01"},
    "q06": {"start": "1996-01-01"},
    "q07": {"first": "NATION_6", "second": "NATION_7", "start": "1996-01-01", "end": "1997-12-31"},
    "q08": {"nation": "NATION_2", "part_type": "ECONOMY", "start": "1996-01-01",
            "end": "1997-12-31"},
    "q09": {"word": "red"},
    "q10": {"start": "1996-10-01"},
    "q11": {"nation": "NATION_7", "fraction": "0.001"},
    "q12": {"start": "1996-01-01"},
    "q13": {},
    "q14": {"start": "1996-09-01"},
    "q15": {},
    "q16": {"brand": "Brand#4", "type_prefix": "MEDIUM"},
    "q17": {},
    "q18": {},
    "q19": {"offers": (("Brand#12", ("SM CASE", "SM BOX", "SM PKG"), 1, 25),
                       ("Brand#23", ("MED BAG", "MED BOX", "MED PKG"), 10, 30),
                       ("Brand#5", ("LG CASE", "LG BOX", "LG PACK"), 20, 45))},
    "q20": {"prefix": "red", "nation": "NATION_3", "start": "1996-01-01"},
    "q21": {"nation": "NATION_20"},
    "q22": {},
}

# Every customer here has an order, so q22 itself selects none. A form of its own asks for
# customers without a recent completed order.
RECENT_ORDERS = "o_orderdate >= DATE '2000-01-01' AND o_orderstatus = 'F'"


def run(name: str, tables: standin.Tables) -> DataFrame:
    return tpch.run(name, tables, **PARAMETERS[name])


def idle_customers(tables: standin.Tables) -> DataFrame:
    """q22 over recent completed orders only."""
    return run("q22", tables.replaced(orders=tables.orders.where(F.expr(RECENT_ORDERS))))


def oracle(name: str, orders: str | None = None) -> str:
    """The query's SQL over the given tables, with the stand-in columns as CTEs; ``orders``
    is a condition on the orders it reads."""
    ctes = [standin.oracle_cte(t) for t in tpch_sql.table_names(name)]
    body = tpch_sql.text(name, lambda t: f"v_{t}", **PARAMETERS[name])
    if orders:
        ctes.append(f"recent AS (SELECT * FROM v_orders WHERE {orders})")
        body = body.replace("FROM v_orders", "FROM recent")
    joined = ",\n".join(ctes)
    if body.startswith("WITH "):
        return f"WITH {joined},\n{body[5:]}"
    return f"WITH {joined}\n{body}"
