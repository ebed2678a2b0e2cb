"""Sinks: feed batches merged into the catalogue. Every merge is one aggregate over old and new rows, so it is the same however rows arrive in parts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from basketry.functions.text import tokens
from basketry.operators.windows import latest_by

#: A price change below this is none.
CHANGE = 0.0005
#: A full file must show so many rows, and may drop at most this share.
SEEN, DROP = 50, 0.35


def products(old: DataFrame, new: DataFrame) -> DataFrame:
    """(identity, name, brand, category, size_qty, size_unit): the longest name; of other attributes the newest that isn't null.

    Both sides have `arrival`, which orders them; identity is the barcode or else the source's own key.
    """
    rows = old.unionByName(new)
    length = F.char_length("name")
    newest = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("arrival"))).alias(c)
    return rows.groupBy("identity").agg(F.max_by("name", F.struct(length, "arrival")).alias("name"), *map(newest, ("brand", "category", "size_qty", "size_unit")))


def listings(old: DataFrame, new: DataFrame) -> DataFrame:
    """(chain_id, item_code, name, sale_basis, piece_count, confidence): pack facts are taken over by rows at least as sure; names by newer rows."""
    rows = old.unionByName(new)
    facts = F.max_by(F.struct("sale_basis", "piece_count", "confidence"), F.struct("confidence", "arrival")).alias("facts")
    got = rows.groupBy("chain_id", "item_code").agg(F.max_by("name", "arrival").alias("name"), facts)
    return got.select("chain_id", "item_code", "name", "facts.*")


def store_prices(old: DataFrame, new: DataFrame) -> DataFrame:
    """(listing_id, store_id, price, source_ts, last_seen_at): an older observation never takes over, but every one advances last_seen_at."""
    rows = old.unionByName(new)
    best = F.max_by(F.struct("price", "source_ts"), F.struct("source_ts", "arrival", "price")).alias("b")
    return rows.groupBy("listing_id", "store_id").agg(best, F.max("seen_at").alias("last_seen_at")).select("listing_id", "store_id", "b.price", "b.source_ts", "last_seen_at")


def price_changes(observations: DataFrame) -> DataFrame:
    """History: in order of arrival, the observations that weren't late and whose price differs from the one kept before."""
    by = Window.partitionBy("listing_id", "store_id").orderBy("arrival", "price")
    so_far = F.max("source_ts").over(by.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    kept = observations.withColumn("so_far", so_far).where(F.col("source_ts") >= F.col("so_far"))
    before = F.lag("price").over(by)
    rows = kept.withColumn("before", before).where(F.col("before").isNull() | (F.abs(F.col("price") - F.col("before")) > CHANGE))
    return rows.select("listing_id", "store_id", "price", "source_ts", "arrival")


def reconcile(current: DataFrame, full: DataFrame, least: int = SEEN, share: float = DROP) -> DataFrame:
    """current without the rows that a store's full file, started at seen_since, didn't refresh, unless the file looks broken.

    full (store_id, seen_since, rows_seen). Adds nothing; a store whose verdict is no keeps all its rows.
    """
    stale = F.col("seen_since").isNotNull() & F.coalesce(F.col("last_seen_at") < F.col("seen_since"), F.lit(True))
    rows = current.join(F.broadcast(full), "store_id", "left").withColumn("stale", stale)
    verdict = rows.groupBy("store_id").agg((F.count_if("stale") <= F.count(F.lit(1)) * share).alias("few"), (F.max("rows_seen") >= least).alias("enough"))
    kept = rows.join(verdict, "store_id").where(~(F.col("stale") & F.col("few") & F.coalesce("enough", F.lit(False))))
    return kept.select(*current.columns)


def reconcile_report(current: DataFrame, full: DataFrame, least: int = SEEN, share: float = DROP) -> DataFrame:
    """(store_id, stale, verdict) per full file: deleted, too_few_rows, too_many_stale or nothing_stale."""
    stale = F.coalesce(F.col("last_seen_at") < F.col("seen_since"), F.lit(True))
    rows = current.join(F.broadcast(full), "store_id").groupBy("store_id").agg(F.count_if(stale).alias("stale"), F.count(F.lit(1)).alias("n"), F.max("rows_seen").alias("rows_seen"))
    verdict = F.when(F.col("stale") == 0, "nothing_stale").when(F.col("rows_seen") < least, "too_few_rows").when(F.col("stale") > F.col("n") * share, "too_many_stale").otherwise("deleted")
    return rows.select("store_id", "stale", verdict.alias("verdict"))


def ranked_source(old: DataFrame, new: DataFrame, keys: list[str], columns: list[str], trust: Column) -> DataFrame:
    """Per key and column the value of the most trusted row that has one; among equals the newest. For stores and chains."""
    rows = old.unionByName(new).withColumn("_trust", trust)
    pick = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.struct("_trust", "arrival"))).alias(c)
    return rows.groupBy(*keys).agg(*map(pick, columns))


def promotion_items(items: DataFrame, listing: DataFrame) -> DataFrame:
    """items (promotion_id, chain_id, item_code, item_code_norm) with the listing of the raw or the normal code; two equi joins, the raw one first."""
    codes = listing.select("chain_id", F.col("item_code").alias("code"), "listing_id")
    raw = items.join(codes, (items["chain_id"] == codes["chain_id"]) & (items["item_code"] == codes["code"]), "left").select(items["*"], F.col("listing_id").alias("by_raw"))
    both = raw.join(codes, (raw["chain_id"] == codes["chain_id"]) & (raw["item_code_norm"] == codes["code"]), "left")
    return both.select(*(raw[c] for c in items.columns), F.coalesce("by_raw", "listing_id").alias("listing_id"))


def replaced(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """old without the keys that new has, and new: a promotion's or service's rows are replaced as a whole."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def kept_only(old: DataFrame, keep: DataFrame, key: str, scope: Column | None = None) -> DataFrame:
    """old with active = whether its key is to be kept, for the rows in scope (all if none is given).

    An empty list changes nothing, nor do rows outside the scope: both keep the active they have, true where old has none.
    """
    was = F.coalesce("active", F.lit(True)) if "active" in old.columns else F.lit(True)
    some = keep.agg((F.count(F.lit(1)) > 0).alias("some"))
    flags = keep.select(key).distinct().withColumn("listed", F.lit(True))
    rows = old.join(flags, key, "left").join(F.broadcast(some), F.lit(True))
    judged = F.col("some") & (F.lit(True) if scope is None else F.coalesce(scope, F.lit(False)))
    return rows.select(*(c for c in old.columns if c != "active"), F.when(judged, F.col("listed").isNotNull()).otherwise(was).alias("active"))


def changed(old: DataFrame, new: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Keys of new rows that are new or whose content differs: the work list of an incremental index."""
    mark = lambda df: df.select(key, F.xxhash64(*columns).alias("h"))
    was = mark(old).withColumnRenamed("h", "was")
    return mark(new).join(was, key, "left").where(~F.col("h").eqNullSafe(F.col("was"))).select(key, F.when(F.col("was").isNull(), "new").otherwise("changed").alias("reason"))


def expired(df: DataFrame, ts: str, now: Column, days: int) -> DataFrame:
    """df without rows that ended more than `days` before now; with data partitioned by time this drops whole partitions."""
    return df.where(F.col(ts) >= now - F.expr(f"INTERVAL {days} DAYS"))


def misses(old: DataFrame, new: DataFrame) -> DataFrame:
    """(kind, term, hits, last_seen): counters added up."""
    return old.unionByName(new).groupBy("kind", "term").agg(F.sum("hits").alias("hits"), F.max("last_seen").alias("last_seen"))


def newest_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    return latest_by(df, keys, order, [c for c in df.columns if c not in keys])


def quarantined(listings: DataFrame, conflicts: DataFrame) -> DataFrame:
    """listings with the identity they belong to: their product's, or one of their own chain where they were merged by mistake.

    listings (listing_id, product_id, chain_id, item_code), conflicts (listing_id). Nothing is deleted: a quarantined listing keeps its prices under the new identity.
    """
    flags = conflicts.select("listing_id").distinct().withColumn("wrong", F.lit(True))
    rows = listings.join(flags, "listing_id", "left")
    own = F.concat_ws(":", F.lit("chain"), F.col("chain_id").cast("string"), "item_code")
    return rows.select(*listings.columns, F.when(F.col("wrong"), own).otherwise(F.concat_ws(":", F.lit("product"), F.col("product_id").cast("string"))).alias("identity"), F.coalesce("wrong", F.lit(False)).alias("quarantined"))


def demoted(labels: DataFrame, label: str, cls: str, markers: tuple[str, ...], name: str = "name") -> DataFrame:
    """labels without the class `cls` on rows whose name holds none of the few markers."""
    marked = F.lit(False)
    for m in markers:
        marked = marked | F.coalesce(F.contains(name, F.lit(m)), F.lit(False))
    return labels.withColumn(label, F.when((F.col(label) == cls) & ~marked, F.lit(None)).otherwise(F.col(label)))


def kept_storefronts(known: DataFrame, feed: DataFrame, orderable: tuple[str, ...] = ("online", "pickup")) -> DataFrame:
    """(store_id, chain_id, store_kind, origin): the feed's stores, and stores known to take orders that the feed dropped (restored) or calls something else (rescued)."""
    was = known.where(F.col("store_kind").isin(*orderable)).select("store_id", F.col("chain_id").alias("known_chain"), F.col("store_kind").alias("known_kind"))
    rows = feed.withColumn("seen", F.lit(True)).join(was, "store_id", "full")
    origin = F.when(F.col("seen").isNull(), "restored").when(F.col("known_kind").isNotNull() & ~F.coalesce(F.col("store_kind").isin(*orderable), F.lit(False)), "rescued").otherwise("feed")
    rows = rows.withColumn("origin", origin)
    return rows.select("store_id", F.coalesce("chain_id", "known_chain").alias("chain_id"), F.when(F.col("origin") == "feed", F.col("store_kind")).otherwise(F.col("known_kind")).alias("store_kind"), "origin")


def nothing_to_price(chains: DataFrame, stores: DataFrame, orderable: tuple[str, ...] = ("online", "pickup")) -> DataFrame:
    """Chains without a storefront to price: they owe no rows, so a run without them is no failure."""
    return chains.join(stores.where(F.col("store_kind").isin(*orderable)).select("chain_id").distinct(), "chain_id", "left_anti")


def weighted_terms(products: DataFrame) -> DataFrame:
    """(product_id, term, weight): the terms a product is found by, 1 from its name or code, 0.4 from its brand only."""
    named = products.select("product_id", F.explode(F.array_union(tokens(F.col("name")), F.filter(F.array("gtin"), lambda x: x.isNotNull()))).alias("term"), F.lit(1.0).alias("weight"))
    branded = products.select("product_id", F.explode(F.array_distinct(tokens(F.col("brand")))).alias("term"), F.lit(0.4).alias("weight"))
    return named.unionByName(branded).groupBy("product_id", "term").agg(F.max("weight").alias("weight"))
