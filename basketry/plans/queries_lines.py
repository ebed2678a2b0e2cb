"""Queries from a line of a list to a product: pack facts, places, safe candidates, tiers of substitutes, upkeep of the catalogue."""

from __future__ import annotations

from pyspark.sql import functions as F

from basketry.functions import packs
from basketry.functions.geo import haversine_sql
from basketry.operators import delivery, lines, merge, places, quality, search
from basketry.operators.windows import first_per

from .queries_functions import WORDS
from .queries_pricing import DELIVERY, _serviced
from .queries_search import _LEXICAL, Q_SQL, _products, _queries
from .registry import query
from .views import Catalogue, oracle

# Small curated tables over the driver's words.
WEIGHTS = {"widget": 0.2, "ring": 0.3, "small ring": 0.05, "bolt": 0.1}
HINTS = {"ring": "rings", "red ring": "red_rings", "bolt": "bolts"}
TOWNS = [("haifa", "haifa", "town"), ("lod", "lod", "town"), ("tel aviv-jaffa", "tel aviv", "town"), ("tel aviv", "tel aviv", "town"), ("old port", "tel aviv", "quarter")]
_HINT = "CASE WHEN contains(name, 'red ring') THEN 'red_rings' WHEN contains(name, 'ring') THEN 'rings' WHEN contains(name, 'bolt') THEN 'bolts' END"


@query(oracle("SELECT product_id, CASE WHEN contains(name, 'small ring') THEN 0.05e0 WHEN contains(name, 'widget') THEN 0.2e0 WHEN contains(name, 'ring') THEN 0.3e0 WHEN contains(name, 'bolt') THEN 0.1e0 WHEN name LIKE 'blue %' THEN 0.15e0 END AS kg FROM product", "product"))
def m7_piece_weight(c: Catalogue):
    return c.product.select("product_id", packs.piece_weight(F.col("name"), WEIGHTS, ("blue",)).alias("kg"))


@query(oracle(f"SELECT product_id, {_HINT} AS hint FROM product", "product"))
def t26_class_hint(c: Catalogue):
    """The class that a name's longest known phrase points to."""
    return c.product.select("product_id", packs.longest_phrase(F.col("name"), HINTS).alias("hint"))


def _fed(c: Catalogue):
    """Feed rows of the products: every fourth states six units in its name, every fifth is weighted, every sixth has no quantity."""
    k = F.col("product_id")
    return c.product.select("product_id", F.concat("name", F.when(k % 4 == 0, " 6 units").otherwise("")).alias("name"), (k % 5 == 0).alias("weighted"), F.when(k % 6 != 0, F.when(k % 7 == 0, 1.0).otherwise(F.col("size_qty"))).alias("qty"), "size_unit")


_FED = "SELECT product_id, product_id % 4 = 0 AS six, product_id % 5 = 0 AS weighted, CASE WHEN product_id % 6 <> 0 THEN CASE WHEN product_id % 7 = 0 THEN 1e0 ELSE size_qty END END AS qty, size_unit AS u FROM product"
_FACTS = """SELECT product_id, CASE WHEN weighted THEN CASE u WHEN 'g' THEN 'per_kg' WHEN 'ml' THEN 'per_l' ELSE 'unknown' END WHEN u <> 'unit' THEN 'unknown' WHEN pieces > 1 THEN 'per_pack' ELSE 'per_piece' END AS sale_basis, pieces AS piece_count,
    CASE WHEN weighted AND qty IS NULL THEN 'weighted_default' WHEN feed > 1 THEN 'feed' WHEN six THEN 'name_inferred' WHEN weighted OR u = 'unit' THEN 'feed' ELSE 'unknown' END AS source,
    CASE WHEN weighted AND qty IS NULL THEN 0.5e0 WHEN feed > 1 THEN 0.9e0 WHEN six THEN 0.7e0 WHEN feed IS NOT NULL THEN 0.85e0 WHEN weighted THEN 0.95e0 WHEN u = 'unit' THEN 0.85e0 END AS confidence
    FROM (SELECT *, CASE WHEN feed > 1 THEN feed WHEN six THEN 6e0 ELSE feed END AS pieces FROM (SELECT *, CASE WHEN u = 'unit' THEN qty END AS feed FROM fed))"""


@query(oracle(f"SELECT * FROM ({_FACTS})", "product", fed=_FED))
def m11_sale_facts(c: Catalogue):
    facts = packs.sale_facts(F.col("name"), F.col("weighted"), F.col("qty"), F.col("size_unit"), F.lit(False))
    return _fed(c).select("product_id", facts.alias("f")).select("product_id", "f.*")


@query(oracle(f"SELECT listing_id, sale_basis, piece_count FROM (SELECT DISTINCT listing_id, product_id FROM listing) JOIN ({_FACTS}) USING (product_id) WHERE confidence IS NOT NULL", "product", "listing", fed=_FED))
def z7_pack_backfill(c: Catalogue):
    """Pack facts of every listing, inferred once per product's feed row; rows without any evidence stay as they are."""
    facts = packs.sale_facts(F.col("name"), F.col("weighted"), F.col("qty"), F.col("size_unit"), F.lit(False))
    rows = c.listing.select("listing_id", "product_id").distinct().join(_fed(c).select("product_id", facts.alias("f")), "product_id")
    return rows.where("f.confidence IS NOT NULL").select("listing_id", "f.sale_basis", "f.piece_count")


_FORM = "CASE WHEN product_id % 5 = 0 OR product_id % 3 = 0 THEN 'multipack' WHEN product_id % 3 = 1 THEN 'sachet' ELSE 'standard' END"


@query(oracle(f"SELECT product_id, form, form = 'standard' AS stands_for_jar, category = 'PROMO' OR category = 'SMALL' AS by_weight FROM (SELECT product_id, category, {_FORM} AS form FROM product)", "product"))
def m12_package_form(c: Catalogue):
    k = F.col("product_id")
    name = F.concat("name", F.when(k % 3 == 0, " 2x50").when(k % 3 == 1, " sachet").otherwise(""))
    form = packs.package_form(name, F.when(k % 5 == 0, 4).otherwise(1), ("sachet",))
    kinds = F.when(F.col("category") == "PROMO", "produce"), F.when(F.col("category") == "SMALL", "wine")
    return c.product.select("product_id", form.alias("form"), packs.forms_agree(form, F.lit("standard")).alias("stands_for_jar"), packs.counts_as_weight(*kinds).alias("by_weight"))


@query(oracle("SELECT product_id, CASE WHEN product_id % 11 = 0 THEN 'not_positive' WHEN amount > 0 AND product_id % 4 = 3 THEN 'unknown_mode' WHEN amount > 0 AND product_id % 4 = 1 AND product_id % 3 = 0 THEN 'weight_differs' WHEN product_id % 4 = 0 AND product_id % 3 = 0 THEN 'part_of_a_pack' END AS fault FROM (SELECT product_id, product_id % 7 AS amount FROM product)", "product"))
def m12_purchase_faults(c: Catalogue):
    """Purchases of amount kilograms, every third off by half, every eleventh of nothing."""
    k = F.col("product_id")
    amount = (k % 7).cast("double")
    qty = F.when(k % 11 == 0, 0.0).otherwise(F.when(amount > 0, amount).otherwise(1.0) + F.when(k % 3 == 0, 0.5).otherwise(0.0))
    mode = F.element_at(F.array(*map(F.lit, ("packs", "weighted", "units", "guessed"))), (k % 4 + 1).cast("int"))
    return c.product.select("product_id", packs.purchase_fault(amount, F.lit("kg"), F.lit(None).cast("double"), qty, mode).alias("fault"))


def _towns(c: Catalogue):
    return c.spark.createDataFrame(TOWNS, "alias string, town string, kind string")


@query(oracle("SELECT c_custkey AS text_id, CASE c_custkey % 6 WHEN 0 THEN 'lod' WHEN 1 THEN 'haifa' WHEN 2 THEN 'haifa' WHEN 3 THEN 'tel aviv' WHEN 4 THEN 'tel aviv' END AS town FROM customer WHERE c_custkey % 6 < 5"))
def t16_town_of_text(c: Catalogue):
    """Towns in addresses: a street's name gives way to a town, and counts where nothing else does."""
    k = F.col("c_custkey")
    n = k.cast("string")
    text = F.when(k % 6 == 0, F.concat(F.lit("Road Haifa "), n, F.lit(", Lod"))).when(k % 6 == 1, F.concat(F.lit("north Haifa, "), n)).when(k % 6 == 2, F.concat(F.lit("road haifa "), n)).when(k % 6 == 3, F.concat(F.lit("Old Port "), n, F.lit(", road lod")))
    text = text.when(k % 6 == 4, F.concat(n, F.lit(" Hill, Tel Aviv - Jaffa"))).otherwise(F.concat(F.lit("nowhere "), n))
    return places.town_of_text(c.raw("customer").select(k.alias("text_id"), text.alias("text")), _towns(c), streets=("road",))


def _named_stores(c: Catalogue):
    k = F.col("c_custkey")
    n = k.cast("string")
    name = F.when(k % 5 == 0, F.concat(F.lit("Super Lod - Main "), n)).when(k % 5 == 1, F.concat(F.lit("Market "), n, F.lit(" @ tel aviv"))).when(k % 5 == 2, F.concat(F.lit("TA branch "), n)).when(k % 5 == 3, F.concat(F.lit("Store "), n)).otherwise(F.concat(F.lit("Depot "), (k % 23).cast("string")))
    return c.raw("customer").select(k.alias("store_id"), name.alias("name"))


def _store_towns(c: Catalogue):
    return places.town_of_store_name(_named_stores(c), _towns(c), ("super", "main", "market", "branch"), c.spark.createDataFrame([("ta", "tel aviv")], "short string, town string"))


@query(oracle("SELECT c_custkey AS store_id, CASE c_custkey % 5 WHEN 0 THEN 'lod' ELSE 'tel aviv' END AS town FROM customer WHERE c_custkey % 5 < 3"))
def t17_town_of_store_name(c: Catalogue):
    return _store_towns(c)


@query(oracle("SELECT 'Depot ' || CAST(c_custkey % 23 AS VARCHAR) AS name, count(*) AS stores FROM customer WHERE c_custkey % 5 = 4 GROUP BY 1 UNION ALL SELECT 'Store ' || CAST(c_custkey AS VARCHAR), 1 FROM customer WHERE c_custkey % 5 = 3 ORDER BY stores DESC, name LIMIT 15"))
def z2_top_unresolved(c: Catalogue):
    """What is left after towns were filled in from names: the fifteen most frequent names without one."""
    filled = _named_stores(c).join(_store_towns(c).withColumnRenamed("town", "city").hint("merge"), "store_id", "left")
    return places.unresolved(filled)


_KM = haversine_sql("lat + CASE WHEN store_id % 2 = 0 THEN 0.5e0 ELSE 0.05e0 END", "lng", "lat", "lng")


@query(oracle(f"SELECT store_id, CASE WHEN take THEN lat + CASE WHEN store_id % 2 = 0 THEN 0.5e0 ELSE 0.05e0 END ELSE lat END AS lat, CASE WHEN take THEN 'address' WHEN store_id % 3 = 1 THEN 'city_centroid' WHEN store_id % 3 = 2 THEN 'exact' END AS geo_source FROM (SELECT *, store_id % 3 < 2 AND {_KM} <= 15e0 AS take FROM store)", "store"))
def z4_address_upgrade(c: Catalogue):
    """Coarse places take their address's hit, half of which lie in another town."""
    k = F.col("store_id")
    stores = c.store.select("store_id", "lat", "lng", F.col("store_name").alias("city"), F.when(k % 3 == 1, "city_centroid").when(k % 3 == 2, "exact").alias("geo_source"))
    hits = c.store.select("store_id", (F.col("lat") + F.when(k % 2 == 0, 0.5).otherwise(0.05)).alias("hit_lat"), F.col("lng").alias("hit_lng"))
    centres = c.store.select(F.col("store_name").alias("city"), F.col("lat").alias("c_lat"), F.col("lng").alias("c_lng"))
    return places.upgraded(stores, hits, centres).select("store_id", "lat", "geo_source")


def _pool(c: Catalogue):
    """The twenty best of each query with what the safety of a choice is judged by."""
    chains = c.price_point.groupBy("product_id").agg(F.count_distinct("chain_id").alias("chain_count"))
    rows = search.lexical(_queries(c), _products(c)).join(chains, "product_id", "left")
    return rows.select(
        "query_id", "product_id", "category", "score", "store_count", "chain_count", "brand", lines.unasked(F.col("query"), F.col("name"), ("ring", "gear")).alias("guarded"), F.lit(None).cast("string").alias("brand_wanted"),
        F.when(F.startswith("name", F.lit("red b")), "bold").alias("variant"), F.lit(None).cast("string").alias("variant_wanted"), (F.col("size_qty") >= 20).alias("pack_fits"),
    )


_CHAINS = "SELECT product_id, count(DISTINCT chain_id) AS chain_count FROM store_price GROUP BY 1"
_POOL = f"""SELECT query_id, query, product_id, l.score, l.store_count, chain_count, p.category, starts_with(p.name, 'red b') AS bold, p.size_qty >= 20 AS pack_fits,
    len(list_filter({WORDS.format('p.name')}, lambda x: list_contains(['ring', 'gear'], x) AND NOT list_contains({WORDS.format('query')}, x))) > 0 AS guarded FROM lexical l JOIN product p USING (product_id) LEFT JOIN chains USING (product_id)"""
_FAST = "store_count > 0 DESC, NOT bold DESC, pack_fits DESC, score DESC, store_count DESC, chain_count DESC NULLS LAST, product_id"
_SAFE = _LEXICAL | {"chains": _CHAINS, "pool": _POOL}


@query(oracle("SELECT query_id, product_id, guarded FROM pool", "product", "store_price", **_SAFE))
def t22_guarded_words(c: Catalogue):
    """Candidates with a word that their query doesn't say."""
    return _pool(c).select("query_id", "product_id", "guarded")


@query(oracle(f"SELECT query_id, product_id, row_number() OVER (PARTITION BY query_id ORDER BY {_FAST}) AS rank FROM pool WHERE NOT guarded", "product", "store_price", **_SAFE))
def r16_fast_ranks(c: Catalogue):
    return lines.fast_ranked(_pool(c)).select("query_id", "product_id", "rank")


_TOP = "SELECT query_id, category AS dominant FROM (SELECT query_id, category, count(*) AS n, sum(count(*)) OVER (PARTITION BY query_id) AS total, row_number() OVER (PARTITION BY query_id ORDER BY count(*) DESC, category) AS rn FROM pool WHERE NOT guarded GROUP BY 1, 2) WHERE rn = 1 AND n >= total * 0.3e0"
_INSIDE = f"SELECT p.* FROM pool p LEFT JOIN ({_TOP}) USING (query_id) WHERE NOT guarded AND (dominant IS NULL OR category = dominant)"


@query(oracle("SELECT query_id, product_id FROM inside", "product", "store_price", **_SAFE, inside=_INSIDE))
def z32_dominant_class(c: Catalogue):
    return lines.in_dominant_class(lines.safe(_pool(c)), share=0.3).select("query_id", "product_id")


_POLICY = """SELECT q.query_id, q.query, CASE WHEN n IS NULL THEN 'no_safe_match' WHEN classes > 1 THEN 'ambiguous_class' WHEN chosen.n = 0 THEN 'no_local_price' ELSE 'selected' END AS outcome, CASE WHEN n > 0 AND classes = 1 THEN chosen.p END AS product_id, coalesce(moved AND classes = 1, FALSE) AS upgraded, n
    FROM asked q LEFT JOIN (SELECT *, CASE WHEN moved THEN best ELSE first END AS chosen, CASE WHEN moved THEN best.n ELSE first.n END AS n FROM (SELECT *, best.n >= 3 AND best.n >= first.n * 3 AS moved FROM (
    SELECT query_id, count(DISTINCT category) AS classes, arg_min({'p': product_id, 'n': store_count}, rank) AS first, arg_max({'p': product_id, 'n': store_count}, store_count * 1000 - rank) AS best FROM ranked GROUP BY 1))) USING (query_id)"""
_POLICIES = _SAFE | {"inside": _INSIDE, "ranked": f"SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY {_FAST}) AS rank FROM inside", "asked": Q_SQL, "policy": _POLICY}


def _policy(c: Catalogue):
    return lines.fast_policy(_queries(c), _pool(c), share=0.3)


@query(oracle("SELECT query_id, product_id, outcome, upgraded FROM policy", "product", "store_price", **_POLICIES))
def r21_fast_policy(c: Catalogue):
    """One answer or a stated omission for each query."""
    return _policy(c)


@query(oracle(
    """SELECT i.item_id, coalesce(a.product_id, b.product_id, p.product_id) AS product_id, CASE WHEN a.product_id IS NOT NULL THEN 'id' WHEN b.product_id IS NOT NULL THEN 'gtin' WHEN p.product_id IS NOT NULL THEN 'query' ELSE 'unresolved' END AS via
        FROM items i LEFT JOIN product a ON a.product_id = i.product_id LEFT JOIN product b ON b.gtin = i.gtin LEFT JOIN policy p ON p.query = i.query""",
    "product", "store_price", **_POLICIES, items="SELECT o_orderkey AS item_id, CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey % 5000 END AS product_id, CASE WHEN o_orderkey % 3 = 1 THEN CAST(7290000000000 + o_orderkey % 5000 AS VARCHAR) END AS gtin, CASE WHEN o_orderkey % 3 = 2 THEN p.name END AS query FROM orders JOIN product p ON p.product_id = o_orderkey % 200",
))
def r22_batch_resolve(c: Catalogue):
    """A table of list items, by id, by code and by text, resolved in one job; each distinct text is searched once."""
    k = F.col("o_orderkey")
    texts = _queries(c)
    items = c.raw("orders").join(c.product, F.col("product_id") == k % 200).select(k.alias("item_id"), F.when(k % 3 == 0, k % 5000).alias("product_id"), F.when(k % 3 == 1, (F.lit(7290000000000) + k % 5000).cast("string")).alias("gtin"), F.when(k % 3 == 2, F.col("name")).alias("query"))
    answers = _policy(c).join(texts, "query_id").select("query", F.col("product_id").alias("answer"))
    return lines.resolved(items, c.product, answers)


def _tiers(c: Catalogue):
    """What may stand for a product: itself, the first of its name and class, the first of its class."""
    # The table is one small file, so one task: its rows are dealt out before they are grouped.
    p = c.product.select("product_id", "name", "category", "size_unit").repartition("product_id")
    named = p.groupBy("category", "size_unit", "name").agg(F.min("product_id").alias("candidate_id"))
    classes = p.groupBy("category", "size_unit").agg(F.min("product_id").alias("candidate_id"))
    own = p.select("product_id", F.col("product_id").alias("candidate_id"), F.lit(0).alias("tier"))
    near = p.join(named, ["category", "size_unit", "name"]).select("product_id", "candidate_id", F.lit(1).alias("tier"))
    far = p.join(classes, ["category", "size_unit"]).select("product_id", "candidate_id", F.lit(2).alias("tier"))
    return own.unionByName(near).unionByName(far).groupBy("product_id", "candidate_id").agg(F.min("tier").alias("tier"))


_TIERS = "SELECT product_id, candidate_id, min(tier) AS tier FROM (SELECT product_id, product_id AS candidate_id, 0 AS tier FROM product UNION ALL SELECT product_id, min(product_id) OVER (PARTITION BY category, size_unit, name), 1 FROM product UNION ALL SELECT product_id, min(product_id) OVER (PARTITION BY category, size_unit), 2 FROM product) GROUP BY 1, 2"
_UNITS = "SELECT product_id, store_id, candidate_id, tier, unit FROM (SELECT t.*, store_id, unit, row_number() OVER (PARTITION BY t.product_id, store_id ORDER BY tier, unit, candidate_id) AS rn FROM tiers t JOIN (SELECT product_id AS candidate_id, store_id, min(price) AS unit FROM store_price WHERE price > 0 GROUP BY 1, 2) USING (candidate_id)) WHERE rn = 1"


@query(oracle("SELECT basket_id, store_id, sum(floor(floor(unit * qty * 100 + 0.5e0) / 100 * 100 + 0.5e0)) AS agorot, count(*) AS lines, count(*) FILTER (WHERE tier = 0) AS strict FROM basket_line JOIN units USING (product_id) GROUP BY 1, 2", "product", "store_price", "basket_line", tiers=_TIERS, units=_UNITS))
def b3_tiered_totals(c: Catalogue):
    """Every basket at every store, with a looser tier only for lines whose stricter tiers the store lacks."""
    return lines.tiered_totals(c.dealt_line, _tiers(c), c.dealt_price).withColumn("agorot", F.col("agorot").cast("double"))


@query(oracle(
    """SELECT u.product_id, store_id, candidate_id, CASE WHEN tier = 2 THEN 'class_fallback' WHEN a.brand = b.brand THEN 'brand_family_equivalent' ELSE 'chain_equivalent' END AS reason, tier = 2 AS confirm,
        array_to_string(list_filter([CASE WHEN a.brand <> b.brand THEN 'brand' END, CASE WHEN a.size_qty <> b.size_qty THEN 'size_qty' END, CASE WHEN a.size_unit <> b.size_unit THEN 'size_unit' END], lambda x: x IS NOT NULL), ',') AS changed
        FROM units u JOIN product a ON a.product_id = u.product_id JOIN product b ON b.product_id = candidate_id WHERE candidate_id <> u.product_id""",
    "product", "store_price", tiers=_TIERS, units=_UNITS,
))
def b12_substitutions(c: Catalogue):
    """Why a store's line has another product than the one asked for, and what differs."""
    return lines.annotated(lines.tiered_units(_tiers(c), c.store_price), c.product).select("product_id", "store_id", "candidate_id", "reason", "confirm", "changed")


@query()
def w11_covering_peers(c: Catalogue):
    """Peers of each class so that every store that sells any keeps one."""
    peers = c.store_price.join(c.product.select("product_id", "category", "size_unit"), "product_id").select(F.concat_ws("/", "category", "size_unit").alias("line"), "product_id", "store_id", "price")
    return lines.covering_peers(peers, 20)


_FAULTS = "list_filter([CASE WHEN product_id % 2 = 0 AND NOT contains(name, 'red') THEN 'lacks red' END, CASE WHEN product_id % 3 = 0 AND NOT (contains(name, 'ring') OR contains(name, 'bolt')) THEN 'none of the choices' END, CASE WHEN contains(name, 'gear') THEN 'has gear' END, CASE WHEN product_id % 5 = 0 AND category <> 'PROMO' THEN 'class' END], lambda x: x IS NOT NULL)"


def _judged(c: Catalogue):
    k = F.col("product_id")
    words = lambda *w: F.array(*map(F.lit, w))
    labels = c.product.select("product_id", "name", "category", F.when(k % 2 == 0, words("red")).alias("require"), F.when(k % 3 == 0, words("ring", "bolt")).alias("any_of"), words("gear").alias("forbid"), F.when(k % 5 == 0, words("PROMO")).alias("classes"))
    return lines.evaluated(labels)


@query(oracle(f"SELECT product_id, array_to_string({_FAULTS}, ';') AS failures FROM product", "product"))
def z39_line_failures(c: Catalogue):
    return _judged(c).select("product_id", F.array_join("failures", ";").alias("failures"))


@query(oracle(f"SELECT basket_id, count(*) AS asked, count(*) FILTER (WHERE ok) AS accepted, floor(count(*) FILTER (WHERE ok) / count(*) * 10000 + 0.5e0) / 10000 AS accuracy FROM basket_line JOIN (SELECT product_id, len({_FAULTS}) = 0 AS ok FROM product) USING (product_id) GROUP BY 1", "product", "basket_line"))
def z39_basket_accuracy(c: Catalogue):
    return lines.basket_scores(c.basket_line.join(_judged(c).select("product_id", "failures"), "product_id"))


@query(oracle(
    "SELECT place_id, service_id, service_type = 2 AND inside AS serves, CASE WHEN service_type <> 2 THEN 'no_express_option' WHEN NOT inside THEN 'outside_service_area' END AS reason FROM (SELECT place_id, store_id AS service_id, service_type, city = place_id AS inside FROM service CROSS JOIN (SELECT DISTINCT city AS place_id FROM store))",
    "store", "service",
))
def l5_served_by(c: Catalogue):
    """What each town is told of each service's express slot."""
    nowhere = [F.lit(None).cast("double").alias(x) for x in ("lat", "lng", "radius_km")]
    rules = c.service.select(F.col("store_id").alias("service_id"), F.lit("city").alias("scope"), "city", *nowhere, F.lit(1).alias("confidence"))
    towns = c.store.select("city").distinct().select(F.col("city").alias("place_id"), F.col("city").alias("place_city"), F.lit(None).cast("double").alias("place_lat"), F.lit(None).cast("double").alias("place_lng"))
    return delivery.served_by(c.service, c.tariff, delivery.coverage(rules, towns), "express")


@query(oracle("SELECT basket_id, store_id, CASE WHEN NOT meets_minimum THEN 'none' WHEN terms = 'unknown' THEN 'low' WHEN imputed_lines > 0 THEN 'medium' ELSE 'high' END AS confidence FROM plans", "tariff", "service", "store_price", "basket_line", **DELIVERY))
def z36_quotable(c: Catalogue):
    plan = delivery.plans(*_serviced(c), c.tariff)
    return delivery.quotable(plan).select("basket_id", "store_id", "confidence")


@query(oracle(f"SELECT product_id, product_id % 3 = 0 AS vector_only, len(a) > 0 AND a = b AS same_brand FROM (SELECT product_id, list_sort(list_distinct({WORDS.format('brand')})) AS a, list_sort(list_distinct({WORDS.format('other')})) AS b FROM product JOIN (SELECT product_id - 1 AS product_id, brand AS other FROM product) USING (product_id))", "product"))
def z29_candidate_tests(c: Catalogue):
    """Whether a product and the next one are of one brand, words in any order; whether only a vector found it."""
    k = F.col("product_id")
    after = c.product.select((k - 1).alias("product_id"), F.concat("brand", F.lit(" brand")).alias("other"))
    found = lines.vector_only(F.when(k % 3 == 1, 0.5), k % 3 == 2, F.lit(0.2))
    return c.product.join(after, "product_id").select("product_id", found.alias("vector_only"), lines.same_brand(F.col("brand"), F.col("other")).alias("same_brand"))


@query(oracle(f"SELECT product_id, term, max(weight) AS weight FROM (SELECT product_id, unnest({WORDS.format('name')}) AS term, 1e0 AS weight FROM product UNION ALL SELECT product_id, gtin, 1e0 FROM product UNION ALL SELECT product_id, unnest({WORDS.format('brand')}), 0.4e0 FROM product) GROUP BY 1, 2", "product"))
def k15_weighted_terms(c: Catalogue):
    return merge.weighted_terms(c.product)


@query(oracle("SELECT listing_id, product_id, chain_id, item_code, CASE WHEN bad THEN 'chain:' || chain_id || ':' || item_code ELSE 'product:' || product_id END AS identity, bad AS quarantined FROM (SELECT l.*, listing_id % 10 = 0 AND nth < n AS bad FROM (SELECT *, row_number() OVER (PARTITION BY product_id, listing_id % 10 = 0 ORDER BY listing_id) AS nth, count(*) OVER (PARTITION BY product_id) AS n FROM listing) l)", "listing").replace("SELECT l.*,", "SELECT l.listing_id, l.product_id, l.chain_id, l.item_code,"))
def k19_quarantine(c: Catalogue):
    """Listings that carry another product's name go to an identity of their own chain."""
    rows = c.listing.join(c.product.select("product_id", F.col("name").alias("product_name"), F.col("category").alias("product_class")), "product_id")
    named = rows.withColumn("listing_name", F.when(F.col("listing_id") % 10 == 0, "zq xw").otherwise(F.col("product_name"))).withColumn("listing_class", F.col("product_class"))
    return merge.quarantined(c.listing, quality.gtin_conflicts(named).where("severe"))


@query(oracle("SELECT product_id, CASE WHEN category = 'PROMO' AND NOT contains(name, 'red') AND NOT contains(name, 'ring') THEN NULL ELSE category END AS category FROM product", "product"))
def z9_demoted_labels(c: Catalogue):
    return merge.demoted(c.product.select("product_id", "name", "category"), "category", "PROMO", ("red", "ring")).select("product_id", "category")


@query(oracle("SELECT store_id, chain_id, CASE WHEN store_kind IN ('online', 'pickup') THEN store_kind WHEN store_id % 3 = 0 THEN 'warehouse' ELSE store_kind END AS store_kind, CASE WHEN store_kind IN ('online', 'pickup') AND store_id % 4 = 0 THEN 'restored' WHEN store_kind IN ('online', 'pickup') AND store_id % 3 = 0 THEN 'rescued' ELSE 'feed' END AS origin FROM store WHERE store_id % 4 <> 0 OR store_kind IN ('online', 'pickup')", "store"))
def z11_kept_storefronts(c: Catalogue):
    """A feed without every fourth store, and with every third as a warehouse."""
    k = F.col("store_id")
    feed = c.store.where(k % 4 != 0).select("store_id", "chain_id", F.when(k % 3 == 0, "warehouse").otherwise(F.col("store_kind")).alias("store_kind"))
    return merge.kept_storefronts(c.store.select("store_id", "chain_id", "store_kind"), feed)


@query(oracle("SELECT chain_id, chain_name FROM chain WHERE chain_id NOT IN (SELECT chain_id FROM store WHERE store_kind IN ('online', 'pickup'))", "chain", "store"))
def z11_nothing_to_price(c: Catalogue):
    return merge.nothing_to_price(c.chain, c.store)


@query(oracle("SELECT event_id, event_id % 4 IN (0, 1) AS transient FROM usage", "usage"))
def z17_transient_errors(c: Catalogue):
    k = F.col("event_id")
    message = F.when(k % 4 == 0, "read ECONNRESET").when(k % 4 == 1, "Fetch failed: x").when(k % 4 == 2, "bad XML")
    return c.usage.select("event_id", quality.transient(message).alias("transient"))


@query(oracle("SELECT listing_id, store_id, price FROM (SELECT *, row_number() OVER (PARTITION BY listing_id ORDER BY price, store_id) AS rn FROM store_price) WHERE rn = 1", "store_price"))
def z7_pack_backfill_source(c: Catalogue):
    """One row per listing to infer pack facts from."""
    return first_per(c.store_price, ["listing_id"], [F.col("price"), F.col("store_id")]).select("listing_id", "store_id", "price")
