"""The catalogue over the driver's tables: canonical views as DataFrames, and the same views as SQL for the oracle.

The mapping is ours: it lets the operators run on tables of another trade. Both forms are kept side by side so that
they can be compared line by line.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from basketry.functions.money import agorot
from basketry.operators.windows import latest_by

#: The moment that "now" is in every query; nothing reads the clock.
NOW = "1998-06-01 00:00:00"
#: Where the shopper stands.
ORIGIN = (32.0, 34.8)
RADIUS_KM = 100.0
PROMO_DAYS = 14

# Delivery tariffs of three service types (slot, lower bound, upper bound, fee, membership).
TARIFFS = [
    (0, "standard", None, 150.0, 35.9, None),
    (0, "standard", 150.0, 500.0, 29.9, None),
    (0, "standard", 500.0, None, 0.0, None),
    (0, "standard", 150.0, None, 9.9, "club"),
    (1, "standard", 0.0, 400.0, 25.0, None),
    (1, "standard", 400.0, None, 15.0, None),
    (2, "express", None, None, 45.0, None),
    (2, "standard", 300.0, None, 19.9, None),
]


def tables(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Catalogue:
    """Views over one folder of driver tables; each is a plan, nothing is read before an action."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def raw(self, name: str) -> DataFrame:
        return tables(self.spark, self.sf_dir, name)

    @cached_property
    def chain(self) -> DataFrame:
        return self.raw("nation").select(F.col("n_nationkey").cast("long").alias("chain_id"), F.col("n_name").alias("chain_name"))

    @cached_property
    def store(self) -> DataFrame:
        k = F.col("s_suppkey")
        return self.raw("supplier").select(
            k.alias("store_id"),
            F.col("s_nationkey").cast("long").alias("chain_id"),
            F.col("s_name").alias("store_name"),
            F.concat(F.lit("city_"), (k % 12).cast("string")).alias("city"),
            (F.lit(29.5) + (k % 37) * 0.1).alias("lat"),
            (F.lit(34.2) + (k % 17) * 0.1).alias("lng"),
            F.when(k % 10 == 0, "online").when(k % 10 == 1, "pickup").when(k % 10 == 2, "warehouse").when(k % 10 != 3, "branch").alias("store_kind"),
            F.when(k % 7 == 0, False).when(k % 7 != 1, True).alias("in_coverage"),
        )

    @cached_property
    def product(self) -> DataFrame:
        k = F.col("p_partkey")
        return self.raw("part").select(
            k.alias("product_id"),
            F.col("p_name").alias("name"),
            F.col("p_brand").alias("brand"),
            F.col("p_type").alias("category"),
            F.col("p_size").cast("double").alias("size_qty"),
            F.when(k % 3 == 0, "g").when(k % 3 == 1, "ml").otherwise("unit").alias("size_unit"),
            (F.lit(7290000000000) + k).cast("string").alias("gtin"),
        )

    @cached_property
    def price_point(self) -> DataFrame:
        """Price history: one row per observation; the store's chain comes from the small store table."""
        rows = self.raw("lineitem").join(self.store.select("store_id", "chain_id"), F.col("l_suppkey") == F.col("store_id"))
        return rows.select(
            (F.col("l_partkey") * 100 + F.col("chain_id")).alias("listing_id"),
            F.col("l_partkey").alias("product_id"),
            "chain_id",
            "store_id",
            agorot(F.col("l_extendedprice") / F.col("l_quantity")).alias("price"),
            F.col("l_shipdate").alias("source_ts"),
            (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("arrival"),
        )

    @cached_property
    def listing(self) -> DataFrame:
        return self.price_point.select("listing_id", "product_id", "chain_id", F.col("product_id").cast("string").alias("item_code")).distinct()

    @cached_property
    def store_price(self) -> DataFrame:
        """The current price per listing and store: the newest observation, ties by arrival, then price."""
        return latest_by(self.price_point, ["listing_id", "store_id"], ["source_ts", "arrival", "price"], ["product_id", "chain_id", "price", "source_ts"])

    @cached_property
    def dealt_price(self) -> DataFrame:
        """store_price dealt out by product, to which a listing belongs: what is grouped by product, or by product and store, isn't shuffled again."""
        return latest_by(self.price_point.repartition("product_id"), ["product_id", "listing_id", "store_id"], ["source_ts", "arrival", "price"], ["price"])

    @cached_property
    def promotion(self) -> DataFrame:
        k = F.col("o_orderkey")
        kind = k % 6
        return self.raw("orders").select(
            k.alias("promotion_id"),
            (F.col("o_custkey") % 25).alias("chain_id"),
            F.when(k % 4 == 0, F.col("o_custkey") % 100 + 1).alias("promo_store_id"),
            F.concat(F.lit("P"), k.cast("string")).alias("promo_code"),
            F.when(kind == 0, "n_for_price").when(kind == 1, "simple_discount").when(kind == 2, "second_unit_pct").when(kind == 3, "club_price").when(kind == 4, "spend_threshold").otherwise("other").alias("kind"),
            F.when(kind == 0, 2.0).alias("n"),
            F.when(kind.isin(0, 3), agorot(F.col("o_totalprice") / 100)).alias("promo_price"),
            F.when(kind == 2, 50.0).alias("percent"),
            F.when(kind == 1, (k % 40 + 5).cast("double")).alias("rate"),
            F.when((kind == 1) & (k % 5 == 0), agorot(F.col("o_totalprice") / 50)).alias("discounted_price"),
            F.when((kind == 1) & (k % 2 == 0), 2.0).alias("min_qty"),
            (k % 7 == 0).alias("club_only"),
            F.col("o_orderdate").alias("start_ts"),
            (F.col("o_orderdate") + F.expr(f"INTERVAL {PROMO_DAYS} DAYS")).alias("end_ts"),
        )

    @cached_property
    def promotion_item(self) -> DataFrame:
        return self.raw("lineitem").select(F.col("l_orderkey").alias("promotion_id"), F.col("l_partkey").alias("product_id")).distinct()

    @cached_property
    def tariff(self) -> DataFrame:
        return self.spark.createDataFrame(TARIFFS, "service_type int, slot string, min_subtotal double, max_subtotal double, fee double, membership string")

    @cached_property
    def service(self) -> DataFrame:
        """Delivery services: every online, pickup and warehouse store is one."""
        rows = self.store.where(F.col("store_kind").isin("online", "pickup", "warehouse"))
        return rows.select(
            "store_id",
            "chain_id",
            (F.col("store_id") % 3).cast("int").alias("service_type"),
            F.when(F.col("store_id") % 4 == 0, 99.0).alias("minimum_order"),
            F.when(F.col("store_id") % 5 == 0, 2.0).alias("service_pct"),
            "city",
        )

    @cached_property
    def usage(self) -> DataFrame:
        return self.raw("events").select(F.col("user_id").alias("api_key_id"), F.col("event_type").alias("route"), F.col("value").alias("latency_ms"), F.col("ts").alias("created_at"), "event_id")

    @cached_property
    def basket_line(self) -> DataFrame:
        """Shopping lists: an order's lines, one per product, with small quantities."""
        rows = self.raw("lineitem")
        return rows.groupBy(F.col("l_orderkey").alias("basket_id"), F.col("l_partkey").alias("product_id")).agg(F.max(F.col("l_quantity") % 4 + 1).alias("qty"))

    @cached_property
    def dealt_line(self) -> DataFrame:
        """basket_line dealt out by product."""
        rows = self.raw("lineitem").select(F.col("l_orderkey").alias("basket_id"), F.col("l_partkey").alias("product_id"), (F.col("l_quantity") % 4 + 1).alias("qty")).repartition("product_id")
        return rows.groupBy("basket_id", "product_id").agg(F.max("qty").alias("qty"))


def now() -> Column:
    return F.to_timestamp(F.lit(NOW))


# The same views as SQL.
SQL = {
    "chain": "SELECT CAST(n_nationkey AS BIGINT) AS chain_id, n_name AS chain_name FROM nation",
    "store": """SELECT s_suppkey AS store_id, CAST(s_nationkey AS BIGINT) AS chain_id, s_name AS store_name, 'city_' || CAST(s_suppkey % 12 AS VARCHAR) AS city,
        29.5e0 + (s_suppkey % 37) * 0.1e0 AS lat, 34.2e0 + (s_suppkey % 17) * 0.1e0 AS lng,
        CASE s_suppkey % 10 WHEN 0 THEN 'online' WHEN 1 THEN 'pickup' WHEN 2 THEN 'warehouse' WHEN 3 THEN NULL ELSE 'branch' END AS store_kind,
        CASE s_suppkey % 7 WHEN 0 THEN FALSE WHEN 1 THEN NULL ELSE TRUE END AS in_coverage FROM supplier""",
    "product": """SELECT p_partkey AS product_id, p_name AS name, p_brand AS brand, p_type AS category, CAST(p_size AS DOUBLE) AS size_qty,
        CASE p_partkey % 3 WHEN 0 THEN 'g' WHEN 1 THEN 'ml' ELSE 'unit' END AS size_unit, CAST(7290000000000 + p_partkey AS VARCHAR) AS gtin FROM part""",
    "price_point": """SELECT l_partkey * 100 + chain_id AS listing_id, l_partkey AS product_id, chain_id, store_id,
        floor(l_extendedprice / l_quantity * 100 + 0.5e0) / 100 AS price, l_shipdate AS source_ts, l_orderkey * 10 + l_linenumber AS arrival
        FROM lineitem JOIN store ON l_suppkey = store_id""",
    "listing": "SELECT DISTINCT listing_id, product_id, chain_id, CAST(product_id AS VARCHAR) AS item_code FROM price_point",
    "store_price": """SELECT listing_id, store_id, product_id, chain_id, price, source_ts FROM (SELECT *, row_number() OVER (PARTITION BY listing_id, store_id
        ORDER BY source_ts DESC, arrival DESC, price DESC) AS rn FROM price_point) WHERE rn = 1""",
    "promotion": f"""SELECT o_orderkey AS promotion_id, o_custkey % 25 AS chain_id, CASE WHEN o_orderkey % 4 = 0 THEN o_custkey % 100 + 1 END AS promo_store_id,
        'P' || CAST(o_orderkey AS VARCHAR) AS promo_code,
        CASE o_orderkey % 6 WHEN 0 THEN 'n_for_price' WHEN 1 THEN 'simple_discount' WHEN 2 THEN 'second_unit_pct' WHEN 3 THEN 'club_price' WHEN 4 THEN 'spend_threshold' ELSE 'other' END AS kind,
        CASE WHEN o_orderkey % 6 = 0 THEN 2e0 END AS n,
        CASE WHEN o_orderkey % 6 IN (0, 3) THEN floor(o_totalprice / 100 * 100 + 0.5e0) / 100 END AS promo_price,
        CASE WHEN o_orderkey % 6 = 2 THEN 50e0 END AS percent,
        CASE WHEN o_orderkey % 6 = 1 THEN CAST(o_orderkey % 40 + 5 AS DOUBLE) END AS rate,
        CASE WHEN o_orderkey % 6 = 1 AND o_orderkey % 5 = 0 THEN floor(o_totalprice / 50 * 100 + 0.5e0) / 100 END AS discounted_price,
        CASE WHEN o_orderkey % 6 = 1 AND o_orderkey % 2 = 0 THEN 2e0 END AS min_qty,
        o_orderkey % 7 = 0 AS club_only, o_orderdate AS start_ts, o_orderdate + INTERVAL {PROMO_DAYS} DAY AS end_ts FROM orders""",
    "promotion_item": "SELECT DISTINCT l_orderkey AS promotion_id, l_partkey AS product_id FROM lineitem",
    "tariff": "SELECT * FROM (VALUES "
    + ", ".join("(" + ", ".join("NULL" if x is None else f"'{x}'" if isinstance(x, str) else f"CAST({x} AS DOUBLE)" if isinstance(x, float) else str(x) for x in row) + ")" for row in TARIFFS)
    + ") AS t(service_type, slot, min_subtotal, max_subtotal, fee, membership)",
    "service": """SELECT store_id, chain_id, CAST(store_id % 3 AS INTEGER) AS service_type, CASE WHEN store_id % 4 = 0 THEN 99e0 END AS minimum_order,
        CASE WHEN store_id % 5 = 0 THEN 2e0 END AS service_pct, city FROM store WHERE store_kind IN ('online', 'pickup', 'warehouse')""",
    "usage": "SELECT user_id AS api_key_id, event_type AS route, value AS latency_ms, ts AS created_at, event_id FROM events",
    "basket_line": "SELECT l_orderkey AS basket_id, l_partkey AS product_id, max(l_quantity % 4 + 1) AS qty FROM lineitem GROUP BY 1, 2",
}
NEEDS = {"price_point": ["store"], "listing": ["store", "price_point"], "store_price": ["store", "price_point"], "service": ["store"]}

#: Tables of the SQL that several others read: made once, whatever the planner would do.
ONCE = {"store_price", "basket_line", "lines", "reference", "costs", "orders_in", "fees", "plans"}


def oracle(select: str, *views: str, **more: str) -> str:
    """SQL with the named views, then the further ones given by keyword, as common table expressions before the select."""
    names: list[str] = []
    for v in views:
        for x in (*NEEDS.get(v, ()), v):
            if x not in names:
                names.append(x)
    parts = [f"{n} AS {'MATERIALIZED ' if n in ONCE else ''}({s})" for n, s in [*((n, SQL[n]) for n in names), *more.items()]]
    return f"WITH {', '.join(parts)} {select}" if parts else select
