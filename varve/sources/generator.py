"""Synthetic raw data with the shape of the eight declared tables, at any scale.

Every row is computed from its own number with ``spark.range`` and seeded hashes: no
shuffle, no state, any number of files in parallel, the same rows on every run. Schema, keys,
relations and row counts are those of the specification; the values are not those of its
generator, only drawn from the same domains.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from varve import schema

# Domains of the TPC-H specification v3, clause 4.2 (colours: a selection).
REGIONS = ("AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST")
NATIONS = (
    ("ALGERIA", 0), ("ARGENTINA", 1), ("BRAZIL", 1), ("CANADA", 1), ("EGYPT", 4), ("ETHIOPIA", 0),
    ("FRANCE", 3), ("GERMANY", 3), ("INDIA", 2), ("INDONESIA", 2), ("IRAN", 4), ("IRAQ", 4),
    ("JAPAN", 2), ("JORDAN", 4), ("KENYA", 0), ("MOROCCO", 0), ("MOZAMBIQUE", 0), ("PERU", 1),
    ("CHINA", 2), ("ROMANIA", 3), ("SAUDI ARABIA", 4), ("VIETNAM", 2), ("RUSSIA", 3),
    ("UNITED KINGDOM", 3), ("UNITED STATES", 1),
)
SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "MACHINERY", "HOUSEHOLD")
PRIORITIES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")
MODES = ("REG AIR", "AIR", "RAIL", "SHIP", "TRUCK", "MAIL", "FOB", "AIR REG")
INSTRUCTIONS = ("DELIVER IN PERSON", "COLLECT COD", "NONE", "TAKE BACK RETURN")
TYPE_WORDS = (
    ("STANDARD", "SMALL", "MEDIUM", "LARGE", "ECONOMY", "PROMO"),
    ("ANODIZED", "BURNISHED", "PLATED", "POLISHED", "BRUSHED"),
    ("TIN", "NICKEL", "BRASS", "STEEL", "COPPER"),
)
CONTAINER_WORDS = (
    ("SM", "LG", "MED", "JUMBO", "WRAP"),
    ("CASE", "BOX", "BAG", "JAR", "PKG", "PACK", "CAN", "DRUM"),
)
COLOURS = (
    "almond", "azure", "beige", "black", "blue", "brown", "chocolate", "coral", "cyan", "forest",
    "gold", "green", "grey", "indian", "ivory", "khaki", "lace", "lemon", "lime", "linen",
    "magenta", "maroon", "navy", "olive", "orange", "pink", "plum", "purple", "red", "white",
)
FIRST_DAY, LAST_DAY, TODAY = "1992-01-01", "1998-08-02", "1995-06-17"
DAYS = 2406  # from the first to the last order date

_SUPPLIERS_PER_PART = 4


def _draw(seed: str, limit: int, *keys: str) -> Column:
    """A number in [0, limit) that depends on the seed and the keys only."""
    return F.pmod(F.xxhash64(F.lit(seed), *[F.col(k) for k in keys]), F.lit(limit))


def _pick(values, index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


def _money(cents: Column) -> Column:
    return (cents.cast("decimal(17,0)") / 100).cast("decimal(15,2)")


def _numbered(prefix: str, key: str) -> Column:
    return F.concat(F.lit(f"{prefix}#"), F.lpad(F.col(key).cast("string"), 9, "0"))


def _phone(nation: Column, key: str) -> Column:
    digits = [F.lpad(_draw(f"phone{i}", n, key).cast("string"), len(str(n - 1)), "0")
              for i, n in enumerate((1000, 1000, 10_000))]
    return F.concat_ws("-", (nation + 10).cast("string"), *digits)


def _words(seed: str, count: int, key: str) -> Column:
    return F.concat_ws(" ", *[_pick(COLOURS, _draw(f"{seed}{i}", len(COLOURS), key))
                              for i in range(count)])


class Generator:
    """Tables of one scale factor as lazy DataFrames."""

    def __init__(self, spark: SparkSession, scale_factor: float, chunks: int = 1):
        self.spark, self.scale_factor, self.chunks = spark, scale_factor, chunks
        self.size = {
            t: schema.expected_rows(t, scale_factor) for t in schema.tables() if t != "lineitem"
        }
        # the count of lines is published for some scales only
        self.size["lineitem"] = (
            schema.expected_rows("lineitem", scale_factor) or 4 * self.size["orders"]
        )

    def _rows(self, table: str) -> DataFrame:
        return self.spark.range(0, self.size[table], 1, self.chunks)

    def table(self, name: str) -> DataFrame:
        columns = getattr(self, f"_{name}")()
        typed = [F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.struct(name).fields]
        return columns.select(*typed)

    def _region(self) -> DataFrame:
        key = F.col("id")
        return self._rows("region").select(
            key.alias("r_regionkey"), _pick(REGIONS, key).alias("r_name"),
            _words("rc", 4, "id").alias("r_comment"),
        )

    def _nation(self) -> DataFrame:
        key = F.col("id")
        return self._rows("nation").select(
            key.alias("n_nationkey"), _pick([n for n, _ in NATIONS], key).alias("n_name"),
            _pick([r for _, r in NATIONS], key).alias("n_regionkey"),
            _words("nc", 4, "id").alias("n_comment"),
        )

    def _supplier(self) -> DataFrame:
        nation = _draw("sn", 25, "s_suppkey")
        complaint = _draw("sx", 1000, "s_suppkey") < 5
        return self._rows("supplier").select((F.col("id") + 1).alias("s_suppkey")).select(
            "s_suppkey", _numbered("Supplier", "s_suppkey").alias("s_name"),
            _words("sa", 2, "s_suppkey").alias("s_address"), nation.alias("s_nationkey"),
            _phone(nation, "s_suppkey").alias("s_phone"),
            _money(_draw("sb", 1_100_000, "s_suppkey") - 99_999).alias("s_acctbal"),
            F.when(complaint, "Customer has open Complaints")
            .otherwise(_words("sc", 5, "s_suppkey")).alias("s_comment"),
        )

    def _customer(self) -> DataFrame:
        nation = _draw("cn", 25, "c_custkey")
        return self._rows("customer").select((F.col("id") + 1).alias("c_custkey")).select(
            "c_custkey", _numbered("Customer", "c_custkey").alias("c_name"),
            _words("ca", 2, "c_custkey").alias("c_address"), nation.alias("c_nationkey"),
            _phone(nation, "c_custkey").alias("c_phone"),
            _money(_draw("cb", 1_100_000, "c_custkey") - 99_999).alias("c_acctbal"),
            _pick(SEGMENTS, _draw("cs", 5, "c_custkey")).alias("c_mktsegment"),
            _words("cc", 6, "c_custkey").alias("c_comment"),
        )

    def _part(self) -> DataFrame:
        def phrase(seed: str, words) -> Column:
            return F.concat_ws(" ", *[_pick(w, _draw(f"{seed}{i}", len(w), "p_partkey"))
                                      for i, w in enumerate(words)])

        maker = _draw("pm", 5, "p_partkey") + 1
        brand = maker * 10 + _draw("pb", 5, "p_partkey") + 1
        return self._rows("part").select((F.col("id") + 1).alias("p_partkey")).select(
            "p_partkey", _words("pn", 5, "p_partkey").alias("p_name"),
            F.concat(F.lit("Manufacturer#"), maker.cast("string")).alias("p_mfgr"),
            F.concat(F.lit("Brand#"), brand.cast("string")).alias("p_brand"),
            phrase("pt", TYPE_WORDS).alias("p_type"),
            (_draw("ps", 50, "p_partkey") + 1).alias("p_size"),
            phrase("pc", CONTAINER_WORDS).alias("p_container"),
            _money(self._price("p_partkey")).alias("p_retailprice"),
            _words("pd", 3, "p_partkey").alias("p_comment"),
        )

    @staticmethod
    def _price(part: str) -> Column:
        """Retail price of a part in cents."""
        key = F.col(part)
        return 90_000 + F.pmod(F.floor(key / 10), F.lit(20_001)) + 100 * F.pmod(key, F.lit(1000))

    def _supplier_of(self, part: Column, slot: Column) -> Column:
        """The supplier in one of a part's four slots; the four differ."""
        suppliers = self.size["supplier"]
        stride = max(1, suppliers // _SUPPLIERS_PER_PART)
        return F.pmod(part + slot * stride, F.lit(suppliers)) + 1

    def _partsupp(self) -> DataFrame:
        part = F.floor(F.col("id") / _SUPPLIERS_PER_PART) + 1
        slot = F.pmod("id", F.lit(_SUPPLIERS_PER_PART))
        return self._rows("partsupp").select(
            part.alias("ps_partkey"), self._supplier_of(part, slot).alias("ps_suppkey"),
            (_draw("pq", 9999, "id") + 1).alias("ps_availqty"),
            _money(_draw("pk", 99_901, "id") + 100).alias("ps_supplycost"),
            _words("px", 6, "id").alias("ps_comment"),
        )

    @staticmethod
    def _order_day(order: str) -> Column:
        return F.date_add(F.lit(FIRST_DAY).cast("date"), _draw("od", DAYS, order).cast("int"))

    def _orders(self) -> DataFrame:
        # every third customer never orders
        customers = self.size["customer"]
        buyer = _draw("oc", max(1, customers // 3 * 2), "id")
        customer = F.floor(buyer / 2) * 3 + F.pmod(buyer, F.lit(2)) + 1
        day = self._order_day("id")
        status = (
            F.when(day < F.date_sub(F.lit(TODAY).cast("date"), 121), "F")
            .when(day > F.lit(TODAY).cast("date"), "O").otherwise("P")
        )
        special = _draw("ox", 100, "id") < 2
        return self._rows("orders").select(
            (F.col("id") + 1).alias("o_orderkey"), customer.alias("o_custkey"),
            status.alias("o_orderstatus"),
            _money(_draw("ot", 50_000_000, "id") + 100_000).alias("o_totalprice"),
            day.alias("o_orderdate"),
            _pick(PRIORITIES, _draw("op", 5, "id")).alias("o_orderpriority"),
            F.concat(F.lit("Clerk#"), F.lpad((_draw("ok", 1000, "id") + 1).cast("string"), 9, "0"))
            .alias("o_clerk"),
            F.lit(0).alias("o_shippriority"),
            F.when(special, "special packaging requests").otherwise(_words("om", 6, "id"))
            .alias("o_comment"),
        )

    def _lineitem(self) -> DataFrame:
        """Line i belongs to the order whose span of line numbers holds i.

        Order k starts at ``floor(k * lines / orders)`` plus 0 to 3, so orders have 1 to 8
        lines, the total is exact, and a line finds its order without any join.
        """
        lines, orders = self.size["lineitem"], self.size["orders"]

        def start(order: Column) -> Column:
            jitter = F.when((order <= 0) | (order >= orders), F.lit(0)).otherwise(
                F.pmod(F.xxhash64(F.lit("lj"), order), F.lit(4))
            )
            even = F.floor(order.cast("decimal(20,0)") * lines / orders).cast("bigint")
            return F.when(order < 0, F.lit(-1)).otherwise(even + jitter)

        # the even split names the order or its neighbour
        near = F.floor(F.col("id").cast("decimal(20,0)") * orders / lines).cast("bigint")
        placed = self._rows("lineitem").select("id", F.least(near + 1, F.lit(orders - 1)).alias("k"))
        for _ in range(2):
            placed = placed.select(
                "id", F.when(start(F.col("k")) > F.col("id"), F.col("k") - 1)
                .otherwise(F.col("k")).alias("k"),
            )
        part = _draw("lp", self.size["part"], "id") + 1
        # a few bulk orders take large quantities on every line
        quantity = F.when(_draw("lb", 100, "k") < 2, 50 - _draw("lq", 8, "id")).otherwise(
            _draw("lq", 50, "id") + 1
        )
        base = placed.select(
            "id", "k", (F.col("id") - start(F.col("k")) + 1).alias("l_linenumber"),
            part.alias("l_partkey"), quantity.alias("quantity"),
            F.date_add(self._order_day("k"), (_draw("ls", 121, "id") + 1).cast("int")).alias("ship"),
        )
        received = F.date_add("ship", (_draw("lr", 30, "id") + 1).cast("int"))
        committed = F.date_add(self._order_day("k"), (_draw("lc", 61, "id") + 30).cast("int"))
        today = F.lit(TODAY).cast("date")
        return base.select(
            (F.col("k") + 1).alias("l_orderkey"), "l_partkey",
            self._supplier_of(F.col("l_partkey"), _draw("lu", _SUPPLIERS_PER_PART, "id"))
            .alias("l_suppkey"),
            "l_linenumber", F.col("quantity").alias("l_quantity"),
            _money(F.col("quantity") * self._price("l_partkey")).alias("l_extendedprice"),
            _money(_draw("ld", 11, "id")).alias("l_discount"),
            _money(_draw("lt", 9, "id")).alias("l_tax"),
            F.when(received > today, "N").otherwise(_pick(("R", "A"), _draw("lf", 2, "id")))
            .alias("l_returnflag"),
            F.when(F.col("ship") > today, "O").otherwise("F").alias("l_linestatus"),
            F.col("ship").alias("l_shipdate"), committed.alias("l_commitdate"),
            received.alias("l_receiptdate"),
            _pick(INSTRUCTIONS, _draw("li", 4, "id")).alias("l_shipinstruct"),
            _pick(MODES, _draw("lm", 8, "id")).alias("l_shipmode"),
            _words("lx", 3, "id").alias("l_comment"),
        )


def generate(
    spark: SparkSession, scale_factor: float, raw_root: str, chunks: int | None = None
) -> DataFrame:
    """Write all eight tables below ``raw_root`` and return ``(table_name, rows, files)``.

    One parquet file per chunk and table, zstd-compressed; by default one chunk per unit of
    scale factor. Fixed tables get a single file.
    """
    parts = chunks or max(1, -int(-scale_factor // 1))
    layout = schema.Layout(scale_factor, raw_root)
    manifest = []
    for name in schema.tables():
        files = 1 if name in schema.CONSTANT_ROWS else parts
        made = Generator(spark, scale_factor, files)
        made.table(name).write.mode("overwrite").option("compression", "zstd").parquet(
            layout.raw_path(name)
        )
        manifest.append((name, made.size[name], files))
    return spark.createDataFrame(manifest, "table_name STRING, rows BIGINT, files INT")
