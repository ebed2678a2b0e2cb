"""Queries of ingestion, merges, audits and maintenance: driver tables stand for feeds."""

from __future__ import annotations

from pyspark.sql import functions as F

from basketry.functions import text as tx
from basketry.operators import merge, quality
from basketry.operators.pricing import within
from basketry.operators.windows import latest_by
from basketry.sources import feeds, marketplace

from .registry import query
from .views import NOW, ORIGIN, Catalogue, now, oracle

SPLIT = "1998-01-01 00:00:00"


def _observed(c: Catalogue):
    return c.price_point.select("listing_id", "store_id", "price", "source_ts", F.col("source_ts").alias("seen_at"), "arrival")


@query(oracle("SELECT name AS identity, arg_max(brand, product_id) AS brand, arg_max(category, product_id) AS category, max(product_id) AS newest FROM product GROUP BY 1", "product"))
def k1_product_upsert(c: Catalogue):
    """Products by identity, here their name: attributes from the newest row that has them."""
    rows = c.product.select(F.col("name").alias("identity"), "name", "brand", "category", "size_qty", "size_unit", F.col("product_id").alias("arrival"))
    got = merge.products(rows.where("arrival % 2 = 0"), rows.where("arrival % 2 = 1"))
    newest = rows.groupBy("identity").agg(F.max("arrival").alias("newest"))
    return got.join(newest, "identity").select("identity", "brand", "category", "newest")


@query(oracle("SELECT listing_id, store_id, arrival, price FROM (SELECT *, row_number() OVER (PARTITION BY listing_id, store_id ORDER BY arrival DESC, price DESC) AS rn FROM price_point) WHERE rn = 1", "price_point"))
def k2_batch_dedup(c: Catalogue):
    return latest_by(c.price_point, ["listing_id", "store_id"], ["arrival", "price"], ["arrival", "price"])


@query(oracle("SELECT chain_id, CAST(product_id % 50 AS VARCHAR) AS item_code, arg_max(product_id, (product_id % 7) * 1000000 + product_id) % 5 AS pieces, max(product_id % 7) AS confidence FROM listing GROUP BY 1, 2", "listing"))
def k3_listing_upsert(c: Catalogue):
    """Pack facts are taken over by rows at least as sure; among equally sure ones by the later."""
    rows = c.listing.select("chain_id", (F.col("product_id") % 50).cast("string").alias("item_code"), F.col("item_code").alias("name"), F.lit("pack").alias("sale_basis"), (F.col("product_id") % 5).alias("piece_count"), (F.col("product_id") % 7).alias("confidence"), F.col("product_id").alias("arrival"))
    return merge.listings(rows.where("arrival % 2 = 0"), rows.where("arrival % 2 = 1")).select("chain_id", "item_code", F.col("piece_count").alias("pieces"), "confidence")


@query(oracle("SELECT listing_id, store_id, price, source_ts, (SELECT max(source_ts) FROM price_point q WHERE q.listing_id = p.listing_id AND q.store_id = p.store_id) AS last_seen_at FROM store_price p", "store_price"))
def k4_price_upsert(c: Catalogue):
    """Late rows never take over; old and new rows merge in one aggregate."""
    rows = _observed(c)
    return merge.store_prices(rows.where(f"source_ts < timestamp '{SPLIT}'"), rows.where(f"source_ts >= timestamp '{SPLIT}'"))


@query(oracle("SELECT listing_id, store_id, price, source_ts FROM (SELECT *, lag(price) OVER (PARTITION BY listing_id, store_id ORDER BY arrival, price) AS before FROM (SELECT * FROM (SELECT *, max(source_ts) OVER (PARTITION BY listing_id, store_id ORDER BY arrival, price ROWS UNBOUNDED PRECEDING) AS so_far FROM price_point) WHERE source_ts >= so_far)) WHERE before IS NULL OR abs(price - before) > 0.0005e0", "price_point"))
def k5_price_changes(c: Catalogue):
    return merge.price_changes(_observed(c)).select("listing_id", "store_id", "price", "source_ts")


def _seen(c: Catalogue):
    return c.store_price.select("listing_id", "store_id", "price", F.col("source_ts").cast("timestamp").alias("last_seen_at"))


def _full(c: Catalogue):
    """Full files of the even stores; each started at the newest sight of its store less 2,000 days and saw so many rows as its number."""
    rows = c.store.where("store_id % 2 = 0").select("store_id", F.col("store_id").cast("int").alias("rows_seen"))
    return rows.withColumn("seen_since", F.to_timestamp(F.lit("1996-06-01 00:00:00")))


_STALE = "SELECT p.store_id, listing_id, price, last.source_ts < TIMESTAMP '1996-06-01 00:00:00' AS stale FROM store_price p JOIN store_price last USING (listing_id, store_id)"


@query(oracle("SELECT s.listing_id, s.store_id, s.price FROM store_price s LEFT JOIN (SELECT store_id, count(*) FILTER (WHERE source_ts < TIMESTAMP '1996-06-01 00:00:00') <= count(*) * 0.35e0 AND store_id >= 50 AS ok FROM store_price WHERE store_id % 2 = 0 GROUP BY 1) v USING (store_id) WHERE NOT (s.source_ts < TIMESTAMP '1996-06-01 00:00:00' AND coalesce(v.ok, FALSE))", "store_price"))
def k6_reconcile(c: Catalogue):
    """Rows that a full file didn't refresh go, unless the file looks broken."""
    return merge.reconcile(_seen(c), _full(c)).select("listing_id", "store_id", "price")


@query(oracle("SELECT store_id, stale, CASE WHEN stale = 0 THEN 'nothing_stale' WHEN store_id < 50 THEN 'too_few_rows' WHEN stale > n * 0.35e0 THEN 'too_many_stale' ELSE 'deleted' END AS verdict FROM (SELECT store_id, count(*) FILTER (WHERE source_ts < TIMESTAMP '1996-06-01 00:00:00') AS stale, count(*) AS n FROM store_price WHERE store_id % 2 = 0 GROUP BY 1)", "store_price"))
def k6_reconcile_report(c: Catalogue):
    return merge.reconcile_report(_seen(c), _full(c))


@query(oracle("SELECT chain_id, chain_name || CASE WHEN chain_id % 2 = 0 THEN '' ELSE ' (fixture)' END AS name FROM chain", "chain"))
def k7_k8_trusted_upsert(c: Catalogue):
    """Names of chains: a fixture's never takes over a real one's, but fills a gap."""
    real = c.chain.select("chain_id", F.when(F.col("chain_id") % 2 == 0, F.col("chain_name")).alias("name"), F.lit(2).alias("trust"), F.lit(1).alias("arrival"))
    fixture = c.chain.select("chain_id", F.concat("chain_name", F.lit(" (fixture)")).alias("name"), F.lit(1).alias("trust"), F.lit(2).alias("arrival"))
    return merge.ranked_source(real, fixture, ["chain_id"], ["name"], F.col("trust"))


@query(oracle("SELECT i.promotion_id, i.product_id, coalesce(a.listing_id, b.listing_id) AS listing_id FROM (SELECT promotion_id, product_id, chain_id FROM promotion_item JOIN promotion USING (promotion_id)) i LEFT JOIN listing a ON a.chain_id = i.chain_id AND a.item_code = '00' || CAST(i.product_id AS VARCHAR) LEFT JOIN listing b ON b.chain_id = i.chain_id AND b.item_code = CAST(i.product_id AS VARCHAR)", "promotion", "promotion_item", "listing"))
def k9_promotion_items(c: Catalogue):
    items = c.promotion_item.join(c.promotion.select("promotion_id", "chain_id"), "promotion_id")
    items = items.select("promotion_id", "product_id", "chain_id", F.concat(F.lit("00"), F.col("product_id").cast("string")).alias("item_code"), F.col("product_id").cast("string").alias("item_code_norm"))
    return merge.promotion_items(items, c.listing).select("promotion_id", "product_id", "listing_id")


@query(oracle("SELECT listing_id FROM listing WHERE product_id % 10 <> 2", "listing"))
def k10_reaped_listings(c: Catalogue):
    """Listings whose classification flipped are dropped by an anti join."""
    return c.listing.select("listing_id").join(c.listing.where("product_id % 10 = 2").select("listing_id"), "listing_id", "left_anti")


@query(oracle(f"SELECT promotion_id FROM promotion WHERE end_ts >= TIMESTAMP '{NOW}' - INTERVAL 14 DAY", "promotion"))
def k11_expiry(c: Catalogue):
    return merge.expired(c.promotion, "end_ts", now(), 14).select("promotion_id")


@query(oracle("SELECT store_id, store_id % 3 = 0 AS active FROM service", "service"))
def k12_keep_list(c: Catalogue):
    return merge.kept_only(c.service.select("store_id"), c.service.where("store_id % 3 = 0").select("store_id"), "store_id")


@query(oracle("SELECT product_id, CASE WHEN product_id % 10 = 1 THEN 'new' ELSE 'changed' END AS reason FROM product WHERE product_id % 10 IN (1, 2)", "product"))
def k13_changed_rows(c: Catalogue):
    """The work list of an index: rows that are new or whose content hash differs."""
    old = c.product.where("product_id % 10 <> 1").withColumn("name", F.when(F.col("product_id") % 10 == 2, F.lit("old")).otherwise(F.col("name")))
    return merge.changed(old, c.product, "product_id", ["name", "brand"])


@query(oracle("SELECT route AS kind, CAST(api_key_id % 10 AS VARCHAR) AS term, count(*) AS hits, max(created_at) AS last_seen FROM usage GROUP BY 1, 2 ORDER BY hits DESC, kind, term LIMIT 25", "usage"))
def k14_miss_counters(c: Catalogue):
    rows = c.usage.select(F.col("route").alias("kind"), (F.col("api_key_id") % 10).cast("string").alias("term"), F.lit(1).cast("long").alias("hits"), F.col("created_at").alias("last_seen"), "event_id")
    got = merge.misses(rows.where("event_id % 2 = 0").drop("event_id"), rows.where("event_id % 2 = 1").drop("event_id"))
    return got.orderBy(F.desc("hits"), "kind", "term").limit(25)


@query(oracle("SELECT store_id, CASE WHEN store_id % 5 > 0 THEN store_name || ' 1 & co' END AS address, CASE WHEN store_id % 12 > 0 THEN city END AS city, CASE WHEN store_id % 5 = 0 THEN 'online' ELSE coalesce(store_kind, 'branch') END AS kind FROM store", "store"))
def k17_data_fixes(c: Catalogue):
    """Stores with entities in their addresses, zeros for cities, and addresses that are only a link, put right."""
    k = F.col("store_id")
    address = F.when(k % 5 == 0, "https://x.example.com").otherwise(F.concat("store_name", F.lit("&#x0D; 1 &amp;  co")))
    rows = c.store.select("store_id", address.alias("address"), F.when(k % 12 == 0, " 0").otherwise(F.col("city")).alias("city"), "store_kind")
    return quality.fixed_stores(rows).withColumnRenamed("store_kind", "kind")


@query(oracle("SELECT phrase, product_id FROM (SELECT p.product_id, p.category, pr.price FROM product p JOIN (SELECT product_id, min(price) AS price FROM store_price GROUP BY 1) pr USING (product_id)) x JOIN (SELECT category, median(price) AS m FROM (SELECT product_id, min(price) AS price FROM store_price GROUP BY 1) JOIN product USING (product_id) GROUP BY 1 HAVING count(*) >= 5) USING (category) JOIN (VALUES ('ECONOMY', 'cheap'), ('ECONOMY', 'budget'), ('PROMO', 'deal')) f(category, phrase) USING (category) WHERE NOT price > m * 1.5e0", "product", "store_price"))
def k18_alias_seed(c: Catalogue):
    """Phrases of a class become aliases of its products, without price outliers."""
    prices = c.store_price.groupBy("product_id").agg(F.min("price").alias("price")).join(c.product.select("product_id", "category"), "product_id")
    medians = prices.groupBy("category").agg(F.median("price").alias("m"), F.count(F.lit(1)).alias("n")).where("n >= 5")
    phrases = c.spark.createDataFrame([("ECONOMY", "cheap"), ("ECONOMY", "budget"), ("PROMO", "deal")], "category string, phrase string")
    rows = prices.join(F.broadcast(phrases), "category").join(F.broadcast(medians), "category")
    return rows.where(~(F.col("price") > F.col("m") * 1.5)).select("phrase", "product_id")


@query(oracle("SELECT listing_id, product_id, 0e0 AS similarity, 'name' AS reason, TRUE AS severe FROM (SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY listing_id) AS nth FROM listing WHERE listing_id % 10 = 0) JOIN (SELECT product_id, count(*) AS n FROM listing GROUP BY 1) USING (product_id) WHERE nth < n", "listing"))
def q1_gtin_conflicts(c: Catalogue):
    """Listings whose names are unlike their product's: every tenth carries another product's name."""
    names = c.product.select("product_id", F.col("name").alias("product_name"), F.col("category").alias("product_class"))
    rows = c.listing.select("listing_id", "product_id", "chain_id").join(names, "product_id")
    wrong = F.when(F.col("listing_id") % 10 == 0, F.lit("zq xw")).otherwise(F.col("product_name"))
    return quality.gtin_conflicts(rows.withColumn("listing_name", wrong).withColumn("listing_class", F.col("product_class")))


@query(oracle("SELECT product_id, category, price FROM (SELECT product_id, category, min(price) AS price FROM store_price JOIN product USING (product_id) GROUP BY 1, 2) x JOIN (SELECT category, median(price) AS m FROM (SELECT product_id, category, min(price) AS price FROM store_price JOIN product USING (product_id) GROUP BY 1, 2) GROUP BY 1 HAVING count(*) >= 5) USING (category) WHERE price > m * 1.5e0", "product", "store_price"))
def q3_class_outliers(c: Catalogue):
    prices = c.store_price.groupBy("product_id").agg(F.min("price").alias("price")).join(c.product.select("product_id", "category"), "product_id")
    return quality.class_outliers(prices, "category", 1.5).select("product_id", "category", "price")


@query(oracle("SELECT event_id, count(*) OVER (PARTITION BY api_key_id ORDER BY epoch_us(created_at) RANGE BETWEEN 3599999999 PRECEDING AND CURRENT ROW) AS calls FROM usage", "usage"))
def st3_rate_window(c: Catalogue):
    """Calls of the same key in the hour up to each call."""
    return quality.rate_window(c.usage.withColumn("created_at", F.col("created_at").cast("timestamp")), "api_key_id", "created_at", "event_id", 3600).select("event_id", "calls")


@query(oracle("SELECT api_key_id, event_id FROM usage WHERE created_at < TIMESTAMP '2024-01-10 00:00:00' - INTERVAL 6 HOUR AND route = 'purchase'", "usage"))
def st8_stale_runs(c: Catalogue):
    return c.usage.where((F.col("created_at") < F.to_timestamp_ntz(F.lit("2024-01-10 00:00:00")) - F.expr("INTERVAL 6 HOURS")) & (F.col("route") == "purchase")).select("api_key_id", "event_id")


@query(oracle("SELECT product_id, coalesce(n, 0) AS store_count, coalesce(n, 0) <> product_id % 30 AS changed FROM product LEFT JOIN (SELECT product_id, count(DISTINCT store_id) AS n FROM store_price GROUP BY 1) USING (product_id)", "product", "store_price"))
def z1_recount(c: Catalogue):
    n = c.store_price.groupBy("product_id").agg(F.count_distinct("store_id").alias("n"))
    rows = c.product.select("product_id").join(n, "product_id", "left").withColumn("store_count", F.coalesce("n", F.lit(0)))
    return rows.select("product_id", "store_count", (F.col("store_count") != F.col("product_id") % 30).alias("changed"))


@query(oracle("SELECT store_id, coalesce(CASE WHEN store_id % 3 <> 0 THEN lat END, c_lat) AS lat FROM store JOIN (SELECT city, avg(lat) AS c_lat FROM store WHERE store_id % 3 <> 0 GROUP BY 1) USING (city)", "store"))
def z3_centroid_backfill(c: Catalogue):
    known = c.store.withColumn("lat", F.when(F.col("store_id") % 3 != 0, F.col("lat")))
    centres = known.groupBy("city").agg(F.avg("lat").alias("c_lat")).where("c_lat IS NOT NULL")
    return known.join(F.broadcast(centres), "city").select("store_id", F.coalesce("lat", "c_lat").alias("lat"))


@query(oracle("SELECT store_id, lat, lng FROM store WHERE store_id % 3 <> 0", "store"))
def z5_unique_places(c: Catalogue):
    """Search hits of each store, some far apart: accepted if all are one place."""
    k = F.col("store_id")
    hits = c.store.select("store_id", F.explode(F.array(F.struct("lat", "lng"), F.struct((F.col("lat") + F.when(k % 3 == 0, 0.5).otherwise(0.0001)).alias("lat"), "lng"))).alias("h")).select("store_id", "h.*")
    return quality.unique_hits(hits)


@query(oracle("SELECT store_id, coalesce(in_coverage, FALSE) OR EXISTS (SELECT 1 FROM service v WHERE v.store_id = s.store_id) AS in_coverage FROM store s", "store", "service"))
def z6_mark_coverage(c: Catalogue):
    served = c.service.select("store_id", F.lit(True).alias("served"))
    return c.store.join(served, "store_id", "left").select("store_id", (F.coalesce("in_coverage", F.lit(False)) | F.col("served").isNotNull()).alias("in_coverage"))


@query(oracle("SELECT product_id, CASE WHEN regexp_matches(name, '^(red|blue) ') THEN 'colour' WHEN regexp_matches(name, '(bolt|ring)$') THEN 'metal' WHEN regexp_matches(name, 'old') THEN 'aged' ELSE category END AS class FROM product", "product"))
def z8_class_repair(c: Catalogue):
    rules = [("^(red|blue) ", "colour"), ("(bolt|ring)$", "metal"), ("old", "aged")]
    return c.product.select("product_id", quality.repaired_class(F.col("name"), F.col("category"), rules).alias("class"))


@query(oracle(f"SELECT store_id FROM (SELECT store_id, max(source_ts) AS t FROM store_price GROUP BY 1) WHERE t >= TIMESTAMP '{NOW}' - INTERVAL 30 DAY", "store_price"))
def z10_known_stores(c: Catalogue):
    seen = c.store_price.groupBy("store_id").agg(F.max("source_ts").alias("t"))
    return seen.where(F.col("t") >= now() - F.expr("INTERVAL 30 DAYS")).select("store_id")


@query(oracle(
    """SELECT DISTINCT service_id, settlement FROM (SELECT store_id AS service_id, unnest(CASE store_id % 4 WHEN 0 THEN ['north town', 'north city'] WHEN 1 THEN [city, 'city_' || CAST((store_id + 1) % 12 AS VARCHAR)] WHEN 2 THEN [city] END) AS settlement FROM store WHERE store_id % 4 < 3)""", "store"
))
def z12_delivery_areas(c: Catalogue):
    """Areas of every store as a service labels them: a named zone, towns parted by a comma, one town twice by a slash, or a region that counts for nothing."""
    k = F.col("store_id") % 4
    other = F.concat(F.lit("city_"), ((F.col("store_id") + 1) % 12).cast("string"))
    label = F.when(k == 0, " North ").when(k == 1, F.concat("city", F.lit(", "), other)).when(k == 2, F.concat("city", F.lit("/"), "city")).otherwise("abroad")
    return marketplace.settlements(c.store.select(F.col("store_id").alias("service_id"), label.alias("label")), {"North": ["north town", "north city"]}, ("abroad",))


@query(oracle("SELECT product_id, CASE WHEN product_id % 4 < 3 THEN size_qty + 0.5e0 END AS value, CASE WHEN product_id % 3 = 0 THEN brand ELSE name END AS brand FROM product", "product"))
def z13_z14_parsed_strings(c: Catalogue):
    """Prices and labels of every product as marketplaces write them: a number among words, or none; the brand before a mark, or no mark."""
    k, z = F.col("product_id"), F.concat(F.col("size_qty").cast("int").cast("string"), F.lit(".5"))
    raw = F.when(k % 4 == 0, F.concat(F.lit("₪"), z)).when(k % 4 == 1, F.concat(z, F.lit(" ILS"))).when(k % 4 == 2, F.concat(F.lit("from "), z, F.lit(" to 900"))).otherwise("on request")
    label = F.when(k % 3 == 0, F.concat("brand", F.lit(" | "), "name")).when(k % 3 == 1, F.concat("name", F.lit(" - Market"))).otherwise(F.col("name"))
    return c.product.select("product_id", marketplace.first_number(raw).alias("value"), marketplace.brand_of(label).alias("brand"))


@query("SELECT strftime(ts AT TIME ZONE 'UTC' AT TIME ZONE 'Asia/Jerusalem', '%Y%m%d') AS day, count(*) AS events FROM events GROUP BY 1 ORDER BY 1 DESC LIMIT 14")
def z16_day_keys(c: Catalogue):
    """The newest fourteen days, by the calendar of the shops, that have events."""
    local = F.from_utc_timestamp(F.col("ts").cast("timestamp"), "Asia/Jerusalem")
    return c.raw("events").groupBy(F.date_format(local, "yyyyMMdd").alias("day")).agg(F.count(F.lit(1)).alias("events")).orderBy(F.desc("day")).limit(14)


@query(oracle("SELECT store_id, CASE WHEN store_id % 7 = 0 THEN 'scraped' WHEN store_kind = 'online' THEN 'online_feed' ELSE 'feed' END AS price_source, CASE WHEN store_id % 4 = 3 OR lat < 29 OR lat > 34 THEN 'unknown' WHEN store_id % 4 = 2 THEN 'city' ELSE 'exact' END AS accuracy FROM store", "store"))
def z19_z33_sources(c: Catalogue):
    """Where each store's prices come from and how sure its place is."""
    k = F.col("store_id")
    geo = F.when(k % 4 == 0, "feed").when(k % 4 == 1, "address").when(k % 4 == 2, "city_centroid")
    return c.store.select("store_id", quality.price_source(F.col("store_kind"), F.when(k % 7 == 0, True)).alias("price_source"), quality.place_accuracy(geo, F.col("lat"), F.col("lng")).alias("accuracy"))


@query(oracle("SELECT b.basket_id, b.product_id, CASE WHEN p.n IS NULL THEN 'unpriced' WHEN p.n < 5 THEN 'scarce' ELSE 'priced' END AS status FROM basket_line b LEFT JOIN (SELECT product_id, count(DISTINCT store_id) AS n FROM store_price GROUP BY 1) p USING (product_id)", "basket_line", "store_price"))
def z35_line_status(c: Catalogue):
    n = c.store_price.groupBy("product_id").agg(F.count_distinct("store_id").alias("n"))
    rows = c.basket_line.join(n, "product_id", "left")
    return rows.select("basket_id", "product_id", F.when(F.col("n").isNull(), "unpriced").when(F.col("n") < 5, "scarce").otherwise("priced").alias("status"))


@query(oracle(
    """SELECT api_key_id, per_minute, max(calls) AS most_calls, count(*) FILTER (WHERE calls > per_minute) AS minutes_over FROM (SELECT api_key_id, CASE WHEN api_key_id % 10 = 0 THEN 600 WHEN api_key_id % 3 = 0 THEN 1 ELSE 60 END AS per_minute, date_trunc('minute', created_at) AS minute, count(*) AS calls FROM usage GROUP BY 1, 2, 3) GROUP BY 1, 2""",
    "usage",
))
def z40_rate_limits(c: Catalogue):
    """The limit of each key (its own, its role's or the usual one), and how the minutes recorded of its calls stand to it."""
    k = F.col("api_key_id")
    keys = c.usage.select(k).distinct().select(k, F.when(k % 3 == 0, "trial").otherwise("user").alias("role"), F.when(k % 10 == 0, 600).alias("own_limit"))
    return quality.rate_limits(keys, quality.usage_by_minute(c.usage), {"trial": 1}, 60)


@query(oracle(
    "SELECT store_id, lower(kind) AS kind, lpad(CAST(7290000000000 + chain_id AS VARCHAR), 13, '0') AS chain_code, lpad(CAST(store_id AS VARCHAR), CAST(greatest(3, length(CAST(store_id AS VARCHAR))) AS INTEGER), '0') AS store_code, CASE WHEN store_id % 2 = 0 THEN '202401150300' ELSE '20240115' END AS stamp FROM store CROSS JOIN (SELECT unnest(['PriceFull', 'Price', 'PromoFull', 'Promo', 'Stores']) AS kind)",
    "store",
))
def s7_file_facts(c: Catalogue):
    """What the names of every store's files say, with and without a time, in folders and packed."""
    text = lambda x: x.cast("string")
    kinds = F.array(*map(F.lit, ("PriceFull", "Price", "PromoFull", "Promo", "Stores")))
    stamp = F.when(F.col("store_id") % 2 == 0, "-20240115-0300.gz").otherwise("-20240115.xml")
    names = c.store.select("store_id", F.explode(kinds).alias("k"), "chain_id", stamp.alias("s")).select("store_id", F.concat(F.lit("/in/"), "k", text(F.lit(7290000000000) + F.col("chain_id")), F.lit("-"), F.lpad(text(F.col("store_id")), F.greatest(F.lit(4), F.char_length(text(F.col("store_id")))), F.lit("0")), "s").alias("path"))
    return names.select("store_id", *feeds.file_facts(F.col("path")))


@query(oracle("SELECT page_id, split_part(split_part(url, '://', 2), '/', 1) AS chain_code FROM pages"))
def s7_s9_page_facts(c: Catalogue):
    """Facts from names and addresses by patterns."""
    return c.raw("pages").select("page_id", F.regexp_extract("url", r"^\w+://([^/]+)", 1).alias("chain_code"))


@query(oracle("SELECT CAST(product_id AS VARCHAR) AS item_code, name, brand, price, size_qty, size_unit, product_id % 5 = 0 AS is_weighted, CASE WHEN size_qty > 0 THEN CASE WHEN size_unit = 'unit' THEN price / size_qty ELSE price / size_qty * 100 END END AS unit_price FROM store_price JOIN product USING (product_id)", "product", "store_price"))
def s2_price_files(c: Catalogue):
    """Current prices written as price files and read back."""
    text = lambda x: x.cast("string")
    rows = c.store_price.select("product_id", F.col("price").cast("decimal(18,2)").alias("price")).join(c.product, "product_id")
    path = feeds.landed(rows.select(text(F.col("product_id")).alias("ItemCode"), F.lit("0").alias("ItemType"), F.concat(F.lit("  "), "name").alias("ItemName"), F.col("brand").alias("ManufacturerName"), text(F.col("size_qty")).alias("Quantity"), F.upper("size_unit").alias("UnitQty"), text(F.col("price")).alias("ItemPrice"), F.when(F.col("product_id") % 5 == 0, "1").otherwise("0").alias("bIsWeighted")), "Item")
    return feeds.read_prices(c.spark, path).select("item_code", "name", "brand", "price", "size_qty", "size_unit", "is_weighted", "unit_price")


@query(oracle("SELECT lpad(CAST(store_id AS VARCHAR), CAST(greatest(3, length(CAST(store_id AS VARCHAR))) AS INTEGER), '0') AS store_code, store_name || CASE WHEN store_kind IN ('pickup', 'warehouse') THEN ' ' || store_kind ELSE '' END AS store_name, CASE WHEN store_id % 12 > 0 THEN city END AS city, lat, CASE WHEN store_kind IN ('online', 'pickup', 'warehouse') THEN store_kind ELSE 'branch' END AS store_kind FROM store", "store"))
def s3_store_files(c: Catalogue):
    """Stores written as a file of stores and read back; a zero stands for no city."""
    kind = F.col("store_kind")
    name = F.concat("store_name", F.when(kind.isin("pickup", "warehouse"), F.concat(F.lit(" "), kind)).otherwise(""))
    rows = c.store.select(F.col("store_id").cast("string").alias("StoreId"), name.alias("StoreName"), F.when(F.col("store_id") % 12 > 0, F.col("city")).otherwise("0").alias("City"), F.col("lat").cast("string").alias("Latitude"), F.when(kind == "online", "2").otherwise("1").alias("StoreType"))
    return feeds.read_stores(c.spark, feeds.landed(rows, "Store")).select("store_code", "store_name", "city", "lat", "store_kind")


@query(oracle("SELECT promo_code, string_agg(CAST(product_id AS VARCHAR), ',' ORDER BY CAST(product_id AS VARCHAR)) AS items FROM promotion JOIN promotion_item USING (promotion_id) WHERE product_id <> 0 GROUP BY 1", "promotion", "promotion_item"))
def s4_promotion_files(c: Catalogue):
    """Promotions with their nested items written as promotion files and read back; a code of zeros is no item."""
    items = c.promotion_item.groupBy("promotion_id").agg(F.collect_list(F.struct(F.col("product_id").cast("string").alias("ItemCode"))).alias("Item"))
    rows = c.promotion.join(items, "promotion_id").select(F.col("promo_code").alias("PromotionId"), F.lit("sale").alias("PromotionDescription"), F.struct("Item").alias("PromotionItems"))
    got = feeds.read_promotions(c.spark, feeds.landed(rows, "Promotion")).where(F.size("item_codes") > 0)
    return got.select("promo_code", F.array_join("item_codes", ",").alias("items"))
