"""Prices and promotions set-at-a-time: every product, store and line in one job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketry.functions import geo, promo
from basketry.functions.dates import active
from basketry.functions.money import agorot, unit_price
from basketry.operators.windows import first_per

MECHANIC = ["kind", "n", "promo_price", "percent", "rate", "discounted_price", "min_qty"]


def shoppable(stores: DataFrame) -> DataFrame:
    """Branches (an unknown kind counts as one) that aren't known to be out of reach."""
    return stores.where((F.col("store_kind").isNull() | (F.col("store_kind") == "branch")) & F.coalesce(F.col("in_coverage"), F.lit(True)))


def within(stores: DataFrame, origin: tuple[float, float], radius_km: float) -> DataFrame:
    """Stores in the radius with km; the box is a filter that reaches the scan."""
    near = stores.where(geo.in_box(F.col("lat"), F.col("lng"), origin, radius_km))
    km = geo.haversine_km(F.lit(origin[0]), F.lit(origin[1]), F.col("lat"), F.col("lng"))
    return near.withColumn("km", km).where(F.col("km") <= radius_km)


def active_items(promotions: DataFrame, items: DataFrame, now: Column) -> DataFrame:
    """Promotions that hold now, one row per product in them. The interval filter comes first, so only live promotions are joined."""
    live = promotions.where(active(F.col("start_ts"), F.col("end_ts"), now))
    return live.join(items, "promotion_id")


def scoped(prices: DataFrame, live: DataFrame) -> DataFrame:
    """Prices with the promotions that apply to them: those of the store itself, and those of its whole chain.

    Two equi joins and a union rather than one join on a disjunction, which would be a nested loop.
    """
    columns = [c for c in live.columns if c not in ("product_id", "chain_id", "promo_store_id")]
    own = live.where(F.col("promo_store_id").isNotNull()).select("product_id", F.col("promo_store_id").alias("store_id"), F.col("chain_id"), *columns)
    whole = live.where(F.col("promo_store_id").isNull()).select("product_id", "chain_id", *columns)
    a = prices.join(own, ["product_id", "store_id", "chain_id"])
    return a.unionByName(prices.join(whole, ["product_id", "chain_id"]))


def best_promotion(prices: DataFrame, live: DataFrame, keys: list[str], qty: Column) -> DataFrame:
    """keys, promo_code, promo_total and club_only of the promotion with the least total under the list price; ties by code.

    The least of (total, code) is an aggregate, so it is reduced before the shuffle.
    """
    rows = scoped(prices.withColumn("qty", qty), live)
    total = promo.line_total(F.col("price"), F.col("qty"), *(F.col(c) for c in MECHANIC))
    rows = rows.withColumn("total", total).where(F.col("total") < F.col("price") * F.col("qty"))
    best = F.min(F.struct("total", "promo_code", "club_only")).alias("best")
    return rows.groupBy(*keys).agg(best).select(*keys, F.col("best.promo_code"), F.col("best.total").alias("promo_total"), F.col("best.club_only"))


def compare_prices(prices: DataFrame, stores: DataFrame, chains: DataFrame, live: DataFrame, origin: tuple[float, float], radius_km: float, limit: int = 500) -> DataFrame:
    """Per product, stores in reach by effective price, then distance: at most `limit` each."""
    near = within(shoppable(stores), origin, radius_km).select("store_id", "store_name", "km")
    rows = prices.where(F.col("price") > 0).join(near, "store_id").join(chains, "chain_id")
    best = best_promotion(rows.select("listing_id", "store_id", "product_id", "chain_id", "price"), live, ["listing_id", "store_id"], F.lit(1.0))
    rows = rows.join(best, ["listing_id", "store_id"], "left").withColumn("effective", agorot(F.coalesce("promo_total", "price")))
    order = [F.col("effective"), F.col("km"), F.col("store_id"), F.col("listing_id")]
    rows = first_per(rows, ["product_id"], order, limit, "place")
    return rows.select("product_id", "place", "store_id", "chain_name", "price", "effective", "promo_code", F.floor(F.col("km") * 1000 + 0.5).cast("long").alias("metres"))


def cheapest_unit(prices: DataFrame, products: DataFrame) -> DataFrame:
    """Per product its cheapest price and unit price, with the attributes that substitutes are chosen by."""
    cheapest = prices.groupBy("product_id").agg(F.min(F.struct("price", "listing_id", "store_id")).alias("c"))
    rows = cheapest.join(products, "product_id").withColumn("price", F.col("c.price"))
    return rows.select("product_id", "name", "brand", "category", "size_unit", "price", unit_price(F.col("price"), F.col("size_qty"), F.col("size_unit")).alias("unit_price"))


def substitutes(cheapest: DataFrame, k: int = 3) -> DataFrame:
    """Per product up to k cheaper products of its category and unit, by unit price.

    Within a (category, unit) the next cheaper products in the order of unit price are what a running window sees, so no pairs are made:
    the k cheapest of the group are found by an aggregate first, and every product is compared with those alone.
    """
    usable = cheapest.where(F.col("unit_price") > 0)
    top = first_per(usable, ["category", "size_unit"], [F.col("unit_price"), F.col("product_id")], k + 1)
    top = top.select("category", "size_unit", F.col("product_id").alias("other_id"), F.col("brand").alias("other_brand"), F.col("unit_price").alias("other_unit_price"))
    pairs = usable.join(top, ["category", "size_unit"]).where((F.col("other_id") != F.col("product_id")) & (F.col("other_unit_price") < F.col("unit_price")))
    rows = first_per(pairs, ["product_id"], [F.col("other_unit_price"), F.col("other_id")], k, "place")
    saving = agorot((F.col("unit_price") - F.col("other_unit_price")) / F.col("unit_price") * 100)
    reason = F.when(F.col("brand") == F.col("other_brand"), "same_brand").otherwise("same_category")
    return rows.select("product_id", "place", "other_id", saving.alias("saving_pct"), reason.alias("reason"))
