"""Catalogue audits: duplicates, conflicts, places, freshness, outliers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from basketry.functions.geo import haversine_km, valid_place
from basketry.functions.text import URL_ONLY, name_similarity, scrubbed, tokens
from basketry.operators.windows import first_per


def duplicates(df: DataFrame, keys: list[str], name: str) -> DataFrame:
    """(check, groups, extra_rows) of rows that share keys."""
    groups = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return groups.agg(F.count(F.lit(1)).alias("groups"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("extra_rows")).select(F.lit(name).alias("check"), "groups", "extra_rows")


def integrity_report(parts: list[tuple[DataFrame, list[str], str]]) -> DataFrame:
    return reduce(DataFrame.unionByName, (duplicates(*p) for p in parts))


def place_quality(stores: DataFrame, far_km: float = 15.0) -> DataFrame:
    """One row of counts: stores, with a place, outside the country, without, and far from the centre of their city."""
    good = valid_place(F.col("lat"), F.col("lng"))
    centre = Window.partitionBy("city")
    rows = stores.withColumn("c_lat", F.avg(F.when(good, F.col("lat"))).over(centre)).withColumn("c_lng", F.avg(F.when(good, F.col("lng"))).over(centre))
    far = good & (haversine_km(F.col("lat"), F.col("lng"), F.col("c_lat"), F.col("c_lng")) > far_km)
    return rows.agg(
        F.count(F.lit(1)).alias("stores"), F.count_if(good).alias("placed"), F.count_if(F.col("lat").isNotNull() & ~good).alias("outside"), F.count_if(F.col("lat").isNull()).alias("unplaced"), F.count_if(far).alias("far")
    )


def gtin_conflicts(listings: DataFrame, least: float = 0.2, severe: float = 0.1) -> DataFrame:
    """Listings whose name is unlike their product's or whose class differs; at least one listing of a product is always kept.

    listings (listing_id, product_id, listing_name, product_name, listing_class, product_class).
    """
    rows = listings.withColumn("similarity", name_similarity(F.col("listing_name"), F.col("product_name")))
    by_name = F.col("similarity") < least
    by_class = F.coalesce(F.col("listing_class") != F.col("product_class"), F.lit(False))
    rows = rows.where(by_name | by_class).withColumn("reason", F.when(by_name & by_class, "name_and_class").when(by_name, "name").otherwise("class")).withColumn("severe", F.col("similarity") < severe)
    sizes = listings.groupBy("product_id").agg(F.count(F.lit(1)).alias("listings"))
    rows = rows.join(sizes, "product_id")
    bad = Window.partitionBy("product_id").orderBy(F.col("similarity"), F.col("listing_id"))
    rows = rows.withColumn("nth", F.row_number().over(bad)).where(F.col("nth") < F.col("listings"))
    return rows.select("listing_id", "product_id", "similarity", "reason", "severe")


def class_outliers(prices: DataFrame, key: str, ratio: float = 3.0, least: int = 5) -> DataFrame:
    """Rows whose price is far above the median of their class, in classes with enough rows."""
    medians = prices.groupBy(key).agg(F.percentile("price", 0.5).alias("median"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    return prices.join(medians, key).where(F.col("price") > F.col("median") * ratio)


def staleness(prices: DataFrame, now: Column, hours: int = 48) -> DataFrame:
    """One row: prices seen lately, stores with any, the newest observation."""
    recent = (F.col("source_ts") >= now - F.expr(f"INTERVAL {hours} HOURS")) & (F.col("source_ts") <= now)
    return prices.agg(F.count_if(recent).alias("recent"), F.count_distinct(F.when(recent, F.col("store_id"))).alias("recent_stores"), F.max("source_ts").alias("newest"))


def run_status(rows: Column, files: Column, errors: Column) -> Column:
    """failed, empty, degraded or success by a run's counters."""
    return F.when((files == 0) & (errors > 0), "failed").when(rows == 0, "empty").when(errors / F.greatest(files, F.lit(1)) > 0.5, "failed").when(errors > 0, "degraded").otherwise("success")


# What messages of failures that may pass by themselves hold.
TRANSIENT = [
    "client is closed", "connection terminated", "server sent fin", "econnreset", "epipe", "etimedout", "server closed the connection", "fetch failed", "operation was aborted", "timeouterror", "econnrefused", "ehostunreach",
    "too many clients", "terminating connection", "timeout exceeded when trying to connect", "ftp pool acquire timeout",
]


def transient(message: Column) -> Column:
    """Whether an error may pass by itself, so that a retry is worth it."""
    return F.coalesce(F.lower(message).rlike("|".join(TRANSIENT)), F.lit(False))


def empty_chains(expected: DataFrame, found: DataFrame) -> DataFrame:
    """(chain_id, reason) of chains that were expected and have no rows: not discovered, or discovered without any."""
    seen = found.groupBy("chain_id").agg(F.sum("rows").alias("rows"))
    rows = expected.join(seen, "chain_id", "left").where(F.coalesce("rows", F.lit(0)) == 0)
    return rows.select("chain_id", F.when(F.col("rows").isNull(), "not_discovered").otherwise("no_rows").alias("reason"))


def nearest_rank(df: DataFrame, keys: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """Percentiles that are values of the data."""
    return df.groupBy(*keys).agg(*(F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY {value})").alias(n) for n, p in shares.items()))


def rate_window(events: DataFrame, key: str, ts: str, tie: str, seconds: int = 60) -> DataFrame:
    """events with the calls of the same key in the seconds up to and including each."""
    w = Window.partitionBy(key).orderBy(F.unix_micros(ts)).rangeBetween(-seconds * 1_000_000 + 1, 0)
    return events.withColumn("calls", F.count(F.lit(1)).over(w))


def unique_hits(hits: DataFrame, least_km: float = 0.15) -> DataFrame:
    """Per store the one place its search found, if all hits closer than least_km are taken as one and one is left."""
    anchor = first_per(hits, ["store_id"], [F.col("lat"), F.col("lng")]).select("store_id", F.col("lat").alias("a_lat"), F.col("lng").alias("a_lng"))
    rows = hits.join(anchor, "store_id").withColumn("off", haversine_km(F.col("lat"), F.col("lng"), F.col("a_lat"), F.col("a_lng")))
    got = rows.groupBy("store_id").agg(F.max("off").alias("spread"), F.min(F.struct("lat", "lng")).alias("p"))
    return got.where(F.col("spread") < least_km).select("store_id", "p.lat", "p.lng")


def fixed_stores(stores: DataFrame) -> DataFrame:
    """stores (address, city, store_kind) with what feeds get wrong put right: entities and line ends in addresses, zeros for cities; an address that is only a link is none, and its store online."""
    link = F.coalesce(F.col("address").rlike(URL_ONLY), F.lit(False))
    city = F.trim("city")
    fixed = {"address": F.when(~link, scrubbed(F.col("address"))), "city": F.when(~city.isin("", "0"), city), "store_kind": F.when(link, "online").otherwise(F.coalesce("store_kind", F.lit("branch")))}
    return stores.select(*(fixed[c].alias(c) if c in fixed else F.col(c) for c in stores.columns))


def repaired_class(name: Column, cls: Column, rules: list[tuple[str, str]]) -> Column:
    """The class of the first rule (pattern, class) that the name matches, else the one it has."""
    return F.coalesce(*(F.when(name.rlike(pattern), to) for pattern, to in rules), cls) if rules else cls


def label_precision(rows: DataFrame, label: str, name: str, words: list[str]) -> DataFrame:
    """Per label how many rows have it, of how many the name has one of the words, and the share."""
    named = F.arrays_overlap(tokens(F.col(name)), F.array(*map(F.lit, words)).cast("array<string>"))
    counts = rows.groupBy(label).agg(F.count(F.lit(1)).alias("total"), F.count_if(named).alias("named"))
    return counts.withColumn("precision", F.col("named") / F.col("total"))


def price_source(store_kind: Column, scraped: Column) -> Column:
    """Where a store's prices come from: a marketplace's page, an online shop's feed, or the shelf's feed."""
    return F.when(F.coalesce(scraped, F.lit(False)), "scraped").when(store_kind == "online", "online_feed").otherwise("feed")


def place_accuracy(geo_source: Column, lat: Column, lng: Column) -> Column:
    """How sure a store's place is: exact for a feed's own or an address's, city for a town's centre, unknown without one."""
    placed = valid_place(lat, lng)
    return F.when(placed & geo_source.isin("feed", "address", "poi"), "exact").when(placed & (geo_source == "city_centroid"), "city").otherwise("unknown")


def usage_by_minute(usage: DataFrame) -> DataFrame:
    """(api_key_id, minute, calls, slowest) of calls (api_key_id, created_at, latency_ms): what is recorded of them."""
    minute = F.date_trunc("minute", "created_at").alias("minute")
    return usage.groupBy("api_key_id", minute).agg(F.count(F.lit(1)).alias("calls"), F.max("latency_ms").alias("slowest"))


def rate_limits(keys: DataFrame, minutes: DataFrame, by_role: dict[str, int], default: int) -> DataFrame:
    """(api_key_id, per_minute, most_calls, minutes_over): each key's own limit, else its role's, else the default, and how its recorded minutes stand to it.

    keys (api_key_id, role, own_limit); a key without calls has none over.
    """
    roles = F.create_map(*(F.lit(x) for kv in by_role.items() for x in kv)) if by_role else F.create_map().cast("map<string,int>")
    limit = F.coalesce(F.when(F.col("own_limit") > 0, F.col("own_limit")), F.try_element_at(roles, F.col("role")), F.lit(default)).cast("long")
    rows = keys.select("api_key_id", limit.alias("per_minute")).join(minutes, "api_key_id", "left")
    return rows.groupBy("api_key_id", "per_minute").agg(F.coalesce(F.max("calls"), F.lit(0).cast("long")).alias("most_calls"), F.count_if(F.col("calls") > F.col("per_minute")).alias("minutes_over"))
