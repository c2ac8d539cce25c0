"""The 22 decision-support queries as DataFrame plans.

Each function takes the eight tables and the query's parameters, and returns a lazy
DataFrame with the query's columns. Three habits keep them usable on very large tables:

* filters and the narrowest dimensions come first, so scans are pruned and the big
  tables meet small inputs;
* a big table is summed by its join key before it is joined wherever the query allows,
  so it is shuffled as partial sums and a hot key is one row per task;
* membership tests join against distinct keys.

No hint forces a broadcast: Spark broadcasts a side only under its size threshold.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from varve.operators.joins import exists_in, missing_from, not_in
from varve.plans.gold import net_price
from varve.sources.standin import Tables

col = F.col


def _day(text: str) -> Column:
    return F.expr(f"DATE '{text}'")


def _from(column: str, start: str, span: str) -> Column:
    """Half-open range: ``start <= column < start + span``."""
    return (col(column) >= _day(start)) & (col(column) < F.expr(f"DATE '{start}' + INTERVAL {span}"))


def _ratio(top: Column, bottom: Column) -> Column:
    return F.round(top.cast("double") / bottom.cast("double"), 4)


def _mean(total: str) -> Column:
    """Average from a sum and the row count, in the type Spark gives avg(DECIMAL(15,2))."""
    return (col(total).cast("double") / col("count_order")).cast("decimal(19,6)")


def _revenue() -> Column:
    return F.sum(net_price()).cast("decimal(38,4)")


def _nations_of(t: Tables, region: str) -> DataFrame:
    return t.nation.join(
        t.region.where(col("r_name") == region), col("n_regionkey") == col("r_regionkey")
    ).select("n_nationkey", "n_name")


def q01(t: Tables, *, until: str, days: int) -> DataFrame:
    lines = t.lineitem.where(col("l_shipdate") <= F.expr(f"DATE '{until}' - INTERVAL '{days}' DAY"))
    sums = lines.groupBy("l_returnflag", "l_linestatus").agg(
        F.sum("l_quantity").cast("decimal(38,2)").alias("sum_qty"),
        F.sum("l_extendedprice").cast("decimal(38,2)").alias("sum_base_price"),
        _revenue().alias("sum_disc_price"),
        F.sum(net_price() * (F.lit(1) + col("l_tax"))).cast("decimal(38,6)").alias("sum_charge"),
        F.sum("l_discount").alias("sum_discount"),
        F.count(F.lit(1)).alias("count_order"),
    )
    return sums.select(
        "l_returnflag", "l_linestatus", "sum_qty", "sum_base_price", "sum_disc_price", "sum_charge",
        _mean("sum_qty").alias("avg_qty"),
        _mean("sum_base_price").alias("avg_price"),
        _mean("sum_discount").alias("avg_disc"),
        "count_order",
    ).orderBy("l_returnflag", "l_linestatus")


def q02(t: Tables, *, size: int, type_suffix: str, region: str, top: int) -> DataFrame:
    parts = t.part.where((col("p_size") == size) & col("p_type").endswith(type_suffix))
    sellers = t.supplier.join(_nations_of(t, region), col("s_nationkey") == col("n_nationkey"))
    offers = t.partsupp.join(
        parts.select("p_partkey", "p_mfgr"), col("ps_partkey") == col("p_partkey")
    ).join(sellers, col("ps_suppkey") == col("s_suppkey"))
    lowest = offers.groupBy(col("ps_partkey").alias("cheap_part")).agg(
        F.min("ps_supplycost").alias("cheap_cost")
    )
    return (
        offers.join(
            lowest,
            (col("ps_partkey") == col("cheap_part")) & (col("ps_supplycost") == col("cheap_cost")),
        )
        .select("s_acctbal", "s_name", "n_name", "p_partkey", "p_mfgr", "s_address", "s_phone",
                "s_comment")
        .orderBy(col("s_acctbal").desc(), "n_name", "s_name", "p_partkey")
        .limit(top)
    )


def q03(t: Tables, *, segment: str, date: str, top: int) -> DataFrame:
    buyers = t.customer.where(col("c_mktsegment") == segment).select("c_custkey")
    open_orders = t.orders.where(col("o_orderdate") < _day(date)).join(
        buyers, col("o_custkey") == col("c_custkey")
    )
    pending = t.lineitem.where(col("l_shipdate") > _day(date)).groupBy("l_orderkey").agg(
        F.sum(net_price()).alias("net")
    )
    return (
        pending.join(open_orders, col("l_orderkey") == col("o_orderkey"))
        .groupBy("l_orderkey", "o_orderdate", "o_shippriority")
        .agg(F.sum("net").cast("decimal(38,4)").alias("revenue"))
        .select("l_orderkey", "revenue", "o_orderdate", "o_shippriority")
        .orderBy(col("revenue").desc(), "o_orderdate", "l_orderkey")
        .limit(top)
    )


def q04(t: Tables, *, start: str, span: str) -> DataFrame:
    late = t.lineitem.where(col("l_commitdate") < col("l_receiptdate"))
    placed = t.orders.where(_from("o_orderdate", start, span))
    return (
        exists_in(placed, late, o_orderkey="l_orderkey")
        .groupBy("o_orderpriority")
        .agg(F.count(F.lit(1)).alias("order_count"))
        .orderBy("o_orderpriority")
    )


def q05(t: Tables, *, region: str, start: str, span: str) -> DataFrame:
    nations = _nations_of(t, region)
    buyers = t.customer.join(nations, col("c_nationkey") == col("n_nationkey"), "left_semi").select(
        "c_custkey", "c_nationkey"
    )
    placed = (
        t.orders.where(_from("o_orderdate", start, span))
        .join(buyers, col("o_custkey") == col("c_custkey"))
        .select("o_orderkey", "c_nationkey")
    )
    # at most one row per supplier and nation is left to meet the suppliers
    by_seller = (
        t.lineitem.join(placed, col("l_orderkey") == col("o_orderkey"))
        .groupBy("l_suppkey", "c_nationkey")
        .agg(F.sum(net_price()).alias("net"))
    )
    sellers = t.supplier.join(nations, col("s_nationkey") == col("n_nationkey")).select(
        "s_suppkey", "s_nationkey", "n_name"
    )
    return (
        by_seller.join(
            sellers,
            (col("l_suppkey") == col("s_suppkey")) & (col("c_nationkey") == col("s_nationkey")),
        )
        .groupBy("n_name")
        .agg(F.sum("net").cast("decimal(38,4)").alias("revenue"))
        .orderBy(col("revenue").desc())
    )


def q06(t: Tables, *, start: str, span: str, low: str, high: str, quantity: int) -> DataFrame:
    return t.lineitem.where(
        _from("l_shipdate", start, span)
        & col("l_discount").between(F.expr(low), F.expr(high))
        & (col("l_quantity") < quantity)
    ).agg(F.sum(col("l_extendedprice") * col("l_discount")).cast("decimal(38,4)").alias("revenue"))


def q07(t: Tables, *, first: str, second: str, start: str, end: str) -> DataFrame:
    pair = t.nation.where(col("n_name").isin(first, second))
    sellers = t.supplier.join(pair, col("s_nationkey") == col("n_nationkey")).select(
        "s_suppkey", col("n_name").alias("supp_nation")
    )
    buyers = t.customer.join(pair, col("c_nationkey") == col("n_nationkey")).select(
        "c_custkey", col("n_name").alias("cust_nation")
    )
    shipped = (
        t.lineitem.where(col("l_shipdate").between(_day(start), _day(end)))
        .join(sellers, col("l_suppkey") == col("s_suppkey"))
        .select("l_orderkey", "supp_nation", F.year("l_shipdate").alias("l_year"),
                net_price().alias("volume"))
    )
    placed = t.orders.join(buyers, col("o_custkey") == col("c_custkey")).select(
        "o_orderkey", "cust_nation"
    )
    return (
        shipped.join(
            placed,
            (col("l_orderkey") == col("o_orderkey")) & (col("supp_nation") != col("cust_nation")),
        )
        .groupBy("supp_nation", "cust_nation", "l_year")
        .agg(F.sum("volume").cast("decimal(38,4)").alias("revenue"))
        .orderBy("supp_nation", "cust_nation", "l_year")
    )


def q08(t: Tables, *, nation: str, region: str, part_type: str, start: str, end: str) -> DataFrame:
    parts = t.part.where(col("p_type") == part_type).select("p_partkey")
    buyers = t.customer.join(
        _nations_of(t, region), col("c_nationkey") == col("n_nationkey"), "left_semi"
    ).select("c_custkey")
    placed = (
        t.orders.where(col("o_orderdate").between(_day(start), _day(end)))
        .join(buyers, col("o_custkey") == col("c_custkey"))
        .select("o_orderkey", F.year("o_orderdate").alias("o_year"))
    )
    # a few rows per supplier are left to meet the suppliers
    by_seller = (
        t.lineitem.join(parts, col("l_partkey") == col("p_partkey"))
        .join(placed, col("l_orderkey") == col("o_orderkey"))
        .groupBy("l_suppkey", "o_year")
        .agg(F.sum(net_price()).alias("volume"))
    )
    sellers = t.supplier.join(t.nation, col("s_nationkey") == col("n_nationkey")).select(
        "s_suppkey", (col("n_name") == nation).alias("is_nation")
    )
    return (
        by_seller.join(sellers, col("l_suppkey") == col("s_suppkey"))
        .groupBy("o_year")
        .agg(_ratio(F.sum(F.when(col("is_nation"), col("volume")).otherwise(F.lit(0))),
                    F.sum("volume")).alias("mkt_share"))
        .orderBy("o_year")
    )


def q09(t: Tables, *, word: str) -> DataFrame:
    parts = t.part.where(col("p_name").contains(word)).select("p_partkey")
    offers = t.partsupp.join(parts, col("ps_partkey") == col("p_partkey")).select(
        "ps_partkey", "ps_suppkey", "ps_supplycost"
    )
    amount = net_price() - col("ps_supplycost") * col("l_quantity")
    by_seller = (
        t.lineitem.join(
            offers, (col("l_partkey") == col("ps_partkey")) & (col("l_suppkey") == col("ps_suppkey"))
        )
        .join(t.orders, col("l_orderkey") == col("o_orderkey"))
        .groupBy("l_suppkey", F.year("o_orderdate").alias("o_year"))
        .agg(F.sum(amount).alias("profit"))
    )
    sellers = t.supplier.join(t.nation, col("s_nationkey") == col("n_nationkey")).select(
        "s_suppkey", col("n_name").alias("nation")
    )
    return (
        by_seller.join(sellers, col("l_suppkey") == col("s_suppkey"))
        .groupBy("nation", "o_year")
        .agg(F.sum("profit").cast("decimal(38,4)").alias("sum_profit"))
        .orderBy("nation", col("o_year").desc())
    )


def q10(t: Tables, *, start: str, span: str, flag: str, top: int) -> DataFrame:
    returned = t.lineitem.where(col("l_returnflag") == flag).groupBy("l_orderkey").agg(
        F.sum(net_price()).alias("net")
    )
    by_buyer = (
        t.orders.where(_from("o_orderdate", start, span))
        .join(returned, col("o_orderkey") == col("l_orderkey"))
        .groupBy("o_custkey")
        .agg(F.sum("net").alias("net"))
    )
    details = ["c_custkey", "c_name", "c_acctbal", "c_phone", "n_name", "c_address", "c_comment"]
    return (
        t.customer.join(by_buyer, col("c_custkey") == col("o_custkey"))
        .join(t.nation, col("c_nationkey") == col("n_nationkey"))
        .groupBy(*details)
        .agg(F.sum("net").cast("decimal(38,4)").alias("revenue"))
        .select("c_custkey", "c_name", "revenue", "c_acctbal", "n_name", "c_address", "c_phone",
                "c_comment")
        .orderBy(col("revenue").desc(), "c_custkey")
        .limit(top)
    )


def q11(t: Tables, *, nation: str, fraction: str) -> DataFrame:
    sellers = t.supplier.join(
        t.nation.where(col("n_name") == nation), col("s_nationkey") == col("n_nationkey")
    ).select("s_suppkey")
    stock = (
        t.partsupp.join(sellers, col("ps_suppkey") == col("s_suppkey"))
        .groupBy("ps_partkey")
        .agg(F.sum(col("ps_supplycost") * col("ps_availqty")).cast("decimal(38,2)").alias("value"))
    )
    # one uncorrelated scalar row, not a join
    bar = stock.agg((F.sum("value").cast("decimal(26,2)") * F.expr(fraction)).alias("bar")).scalar()
    return stock.where(col("value") > bar).orderBy(col("value").desc(), "ps_partkey")


def q12(t: Tables, *, modes: tuple[str, ...], start: str, span: str) -> DataFrame:
    late = t.lineitem.where(
        col("l_shipmode").isin(*modes)
        & (col("l_commitdate") < col("l_receiptdate"))
        & (col("l_shipdate") < col("l_commitdate"))
        & _from("l_receiptdate", start, span)
    ).select("l_orderkey", "l_shipmode")
    urgent = col("o_orderpriority").isin("1-URGENT", "2-HIGH")
    return (
        late.join(t.orders, col("l_orderkey") == col("o_orderkey"))
        .groupBy("l_shipmode")
        .agg(F.count_if(urgent).alias("high_line_count"),
             F.count_if(~urgent).alias("low_line_count"))
        .orderBy("l_shipmode")
    )


def q13(t: Tables, *, first: str, second: str) -> DataFrame:
    ordinary = t.orders.where(~col("o_comment").like(f"%{first}%{second}%"))
    placed = ordinary.groupBy("o_custkey").agg(F.count("o_orderkey").alias("n_orders"))
    per_customer = (
        t.customer.join(placed, col("c_custkey") == col("o_custkey"), "left")
        .groupBy("c_custkey")
        .agg(F.sum(F.coalesce(col("n_orders"), F.lit(0))).alias("c_count"))
    )
    return (
        per_customer.groupBy("c_count")
        .agg(F.count(F.lit(1)).alias("custdist"))
        .orderBy(col("custdist").desc(), col("c_count").desc())
    )


def q14(t: Tables, *, start: str, span: str, prefix: str) -> DataFrame:
    by_part = t.lineitem.where(_from("l_shipdate", start, span)).groupBy("l_partkey").agg(
        F.sum(net_price()).alias("net")
    )
    promo = F.sum(F.when(col("p_type").startswith(prefix), col("net")).otherwise(F.lit(0)))
    return by_part.join(t.part, col("l_partkey") == col("p_partkey")).agg(
        F.round(100 * promo.cast("double") / F.sum("net").cast("double"), 4).alias("promo_revenue")
    )


def q15(t: Tables, *, start: str, span: str) -> DataFrame:
    revenue = (
        t.lineitem.where(_from("l_shipdate", start, span))
        .groupBy(col("l_suppkey").alias("supplier_no"))
        .agg(_revenue().alias("total_revenue"))
    )
    best = revenue.agg(F.max("total_revenue").alias("best_revenue"))
    # An equality join against one row. Supplier keys are matched by <=> (they are not NULL),
    # which keeps a NULL test out of the sums, so that both uses of them share one exchange.
    known = t.supplier.where(col("s_suppkey").isNotNull())
    return (
        revenue.join(best, col("total_revenue") == col("best_revenue"))
        .join(known, col("supplier_no").eqNullSafe(col("s_suppkey")))
        .select("s_suppkey", "s_name", "s_address", "s_phone", "total_revenue")
        .orderBy("s_suppkey")
    )


def q16(t: Tables, *, brand: str, type_prefix: str, sizes: tuple[int, ...], first: str,
        second: str) -> DataFrame:
    parts = t.part.where(
        (col("p_brand") != brand) & ~col("p_type").startswith(type_prefix) & col("p_size").isin(*sizes)
    ).select("p_partkey", "p_brand", "p_type", "p_size")
    refused = t.supplier.where(col("s_comment").like(f"%{first}%{second}%"))
    offers = t.partsupp.select("ps_partkey", "ps_suppkey").join(
        parts, col("ps_partkey") == col("p_partkey")
    )
    return (
        not_in(offers, "ps_suppkey", refused, "s_suppkey")
        .groupBy("p_brand", "p_type", "p_size")
        .agg(F.count_distinct("ps_suppkey").alias("supplier_cnt"))
        .orderBy(col("supplier_cnt").desc(), "p_brand", "p_type", "p_size")
    )


def q17(t: Tables, *, brand: str, container: str, fraction: str) -> DataFrame:
    parts = t.part.where((col("p_brand") == brand) & (col("p_container") == container))
    # The lines of a part collapse to one row per distinct quantity before its window, so a
    # part on any number of lines is a handful of rows there, and the lines are read once.
    sold = (
        t.lineitem.join(parts.select("p_partkey"), col("l_partkey") == col("p_partkey"))
        .groupBy("l_partkey", "l_quantity")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("l_extendedprice").alias("price"))
    )
    # quantity < fraction * average, without a division
    part = Window.partitionBy("l_partkey")
    small = col("l_quantity") * F.sum("n").over(part) < F.expr(fraction) * F.sum(
        col("l_quantity") * col("n")
    ).over(part).cast("decimal(28,2)")
    return sold.withColumn("small", small).where("small").agg(
        F.round(F.sum("price").cast("double") / 7.0, 4).alias("avg_yearly")
    )


def q18(t: Tables, *, quantity: int, top: int) -> DataFrame:
    large = (
        t.lineitem.groupBy("l_orderkey")
        .agg(F.sum("l_quantity").alias("quantity"))
        .where(col("quantity") > quantity)
    )
    keys = ["c_name", "c_custkey", "o_orderkey", "o_orderdate", "o_totalprice"]
    return (
        t.orders.join(large, col("o_orderkey") == col("l_orderkey"))
        .join(t.customer, col("o_custkey") == col("c_custkey"))
        .groupBy(*keys)
        .agg(F.sum("quantity").cast("decimal(38,2)").alias("sum_quantity"))
        .orderBy(col("o_totalprice").desc(), "o_orderdate", "o_orderkey")
        .limit(top)
    )


def q19(t: Tables, *, offers: tuple[tuple[str, tuple[str, ...], int, int], ...],
        modes: tuple[str, ...], instruct: str) -> DataFrame:
    """``offers`` holds (brand, containers, lowest quantity, largest size) alternatives."""

    def fits(offer) -> Column:
        brand, containers, quantity, size = offer
        return (
            (col("p_brand") == brand)
            & col("p_container").isin(*containers)
            & col("l_quantity").between(quantity, quantity + 10)
            & col("p_size").between(1, size)
        )

    handed = t.lineitem.where(
        col("l_shipmode").isin(*modes) & (col("l_shipinstruct") == instruct)
    )
    return handed.join(
        t.part, (col("l_partkey") == col("p_partkey")) & reduce(or_, map(fits, offers))
    ).agg(_revenue().alias("revenue"))


def q20(t: Tables, *, prefix: str, nation: str, start: str, span: str) -> DataFrame:
    parts = t.part.where(col("p_name").startswith(prefix))
    shipped = (
        exists_in(t.lineitem.where(_from("l_shipdate", start, span)), parts, l_partkey="p_partkey")
        .groupBy("l_partkey", "l_suppkey")
        .agg(F.sum("l_quantity").alias("quantity"))
    )
    surplus = t.partsupp.join(
        shipped,
        (col("ps_partkey") == col("l_partkey"))
        & (col("ps_suppkey") == col("l_suppkey"))
        & (2 * col("ps_availqty") > col("quantity")),
    )
    local = t.supplier.join(
        t.nation.where(col("n_name") == nation), col("s_nationkey") == col("n_nationkey")
    )
    return (
        exists_in(local, surplus, s_suppkey="ps_suppkey")
        .select("s_name", "s_address")
        .orderBy("s_name")
    )


def q21(t: Tables, *, nation: str, status: str, top: int) -> DataFrame:
    """One pass over the lines instead of a self join, a semi join and an anti join.

    A supplier kept an order waiting when the order has several suppliers and this one
    alone was late: per order the smallest and largest supplier key differ, while those
    of the late lines are equal.
    """
    late = F.when(col("l_receiptdate") > col("l_commitdate"), col("l_suppkey"))
    waiting = (
        t.lineitem.groupBy("l_orderkey")
        .agg(
            F.min("l_suppkey").alias("low"), F.max("l_suppkey").alias("high"),
            F.min(late).alias("late_low"), F.max(late).alias("late_high"),
            F.count(late).alias("late_lines"),
        )
        .where((col("low") != col("high")) & (col("late_low") == col("late_high")))
    )
    by_seller = (
        t.orders.where(col("o_orderstatus") == status)
        .join(waiting, col("o_orderkey") == col("l_orderkey"))
        .groupBy("late_low")
        .agg(F.sum("late_lines").alias("late_lines"))
    )
    local = t.supplier.join(
        t.nation.where(col("n_name") == nation), col("s_nationkey") == col("n_nationkey")
    )
    return (
        local.join(by_seller, col("s_suppkey") == col("late_low"))
        .groupBy("s_name")
        .agg(F.sum("late_lines").alias("numwait"))
        .orderBy(col("numwait").desc(), "s_name")
        .limit(top)
    )


def q22(t: Tables, *, codes: tuple[str, ...]) -> DataFrame:
    called = t.customer.select(
        "c_custkey", "c_acctbal", F.substring("c_phone", 1, 2).alias("cntrycode")
    ).where(col("cntrycode").isin(*codes))
    usual = called.where(col("c_acctbal") > 0).agg(F.avg("c_acctbal").alias("usual")).scalar()
    idle = missing_from(called.where(col("c_acctbal") > usual), t.orders, c_custkey="o_custkey")
    return (
        idle.groupBy("cntrycode")
        .agg(F.count(F.lit(1)).alias("numcust"),
             F.sum("c_acctbal").cast("decimal(38,2)").alias("totacctbal"))
        .orderBy("cntrycode")
    )


PLANS: dict[str, Callable[..., DataFrame]] = {
    f"q{n:02d}": globals()[f"q{n:02d}"] for n in range(1, 23)
}

# Validation parameters of the TPC-H specification v3, clause 2.4.
PARAMETERS: dict[str, dict] = {
    "q01": {"until": "1998-12-01", "days": 90},
    "q02": {"size": 15, "type_suffix": "BRASS", "region": "EUROPE", "top": 100},
    "q03": {"segment": "BUILDING", "date": "1995-03-15", "top": 10},
    "q04": {"start": "1993-07-01", "span": "'3' MONTH"},
    "q05": {"region": "ASIA", "start": "1994-01-01", "span": "'1' YEAR"},
    "q06": {"start": "1994-01-01", "span": "'1' YEAR", "low": "0.05", "high": "0.07", "quantity": 24},
    "q07": {"first": "FRANCE", "second": "GERMANY", "start": "1995-01-01", "end": "1996-12-31"},
    "q08": {"nation": "BRAZIL", "region": "AMERICA", "part_type": "ECONOMY ANODIZED STEEL",
            "start": "1995-01-01", "end": "1996-12-31"},
    "q09": {"word": "green"},
    "q10": {"start": "1993-10-01", "span": "'3' MONTH", "flag": "R", "top": 20},
    "q11": {"nation": "GERMANY", "fraction": "0.0001000000"},
    "q12": {"modes": ("MAIL", "SHIP"), "start": "1994-01-01", "span": "'1' YEAR"},
    "q13": {"first": "special", "second": "requests"},
    "q14": {"start": "1995-09-01", "span": "'1' MONTH", "prefix": "PROMO"},
    "q15": {"start": "1996-01-01", "span": "'3' MONTH"},
    "q16": {"brand": "Brand#45", "type_prefix": "MEDIUM POLISHED",
            "sizes": (49, 14, 23, 45, 19, 3, 36, 9), "first": "Customer", "second": "Complaints"},
    "q17": {"brand": "Brand#23", "container": "MED BOX", "fraction": "0.2"},
    "q18": {"quantity": 300, "top": 100},
    "q19": {"offers": (("Brand#12", ("SM CASE", "SM BOX", "SM PACK", "SM PKG"), 1, 5),
                       ("Brand#23", ("MED BAG", "MED BOX", "MED PKG", "MED PACK"), 10, 10),
                       ("Brand#34", ("LG CASE", "LG BOX", "LG PACK", "LG PKG"), 20, 15)),
            "modes": ("AIR", "AIR REG"), "instruct": "DELIVER IN PERSON"},
    "q20": {"prefix": "forest", "nation": "CANADA", "start": "1994-01-01", "span": "'1' YEAR"},
    "q21": {"nation": "SAUDI ARABIA", "status": "F", "top": 100},
    "q22": {"codes": ("13", "31", "23", "29", "30", "18", "17")},
}


def run(name: str, tables: Tables, **overrides) -> DataFrame:
    """A query with the specification's parameters, or with some of them replaced."""
    return PLANS[name](tables, **{**PARAMETERS[name], **overrides})
