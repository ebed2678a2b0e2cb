"""Queries that apply the scalar functions, over driver tables or over small stated cases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketry.functions import dates, geo, promo, units, vectors
from basketry.functions import text as tx
from basketry.functions.money import agorot, unit_price

from .registry import query
from .views import NOW, Catalogue, now, oracle

WORDS = "list_filter(regexp_split_to_array(trim(regexp_replace(lower({0}), '[^a-z0-9]+', ' ', 'g')), ' '), lambda x: x <> '')"
GRAMS = "list_distinct(flatten(list_transform(" + WORDS + ", lambda w: list_transform(range(1, CAST(length(w) + 2 AS BIGINT)), lambda i: substr('  ' || w || ' ', i, 3)))))"


def jaccard_sql(a: str, b: str) -> str:
    return f"len(list_intersect({a}, {b})) / len(list_distinct(list_concat({a}, {b})))"


@query(oracle(f"SELECT DISTINCT name, array_to_string({WORDS.format('name')}, ' ') AS normal FROM product", "product"))
def t1_t2_normal_form(c: Catalogue):
    return c.product.select("name", F.concat_ws(" ", tx.tokens(F.col("name"))).alias("normal")).distinct()


# Letters that stand for the product words' own, so that the Hebrew rules meet as many words as the table has, and the endings put on them.
_LATIN, _LETTERS = "abcdefghijklmnopqrstuvwxyz", "אבגדהוזחטיכלמנסעפצקרשתםןיו"
_ENDS = ["", "ות", "ים", "ה", "ת"]


def _hebrew(word: Column) -> Column:
    return F.translate(word, _LATIN, _LETTERS)


def _ended(c: Catalogue) -> DataFrame:
    """(token): the words of all names in Hebrew letters, with the ending that the product's id picks."""
    ends = F.element_at(F.array(*map(F.lit, _ENDS)), (F.col("product_id") % 5 + 1).cast("int"))
    return c.product.select(F.explode(tx.tokens(F.col("name"))).alias("w"), ends.alias("e")).select(F.concat(_hebrew(F.col("w")), F.col("e")).alias("token")).distinct()


_TOKEN_ROWS = f"SELECT DISTINCT translate(w, '{_LATIN}', '{_LETTERS}') || {_ENDS}[product_id % 5 + 1] AS token FROM (SELECT product_id, unnest({WORDS.format('name')}) AS w FROM product)"
_STEMS = """SELECT *, CASE WHEN length(s) >= 5 AND length(regexp_replace(s, '[יו]', '', 'g')) >= 3 THEN regexp_replace(s, '[יו]', '', 'g') ELSE s END AS key FROM (SELECT *, CASE WHEN u LIKE '%ות' AND length(u) >= 4 THEN left(u, length(u) - 2) WHEN u LIKE '%ימ' AND length(u) >= 4 THEN left(u, length(u) - 2)
    WHEN u LIKE '%ה' AND length(u) >= 4 THEN left(u, length(u) - 1) WHEN u LIKE '%ת' AND length(u) >= 4 THEN left(u, length(u) - 1) ELSE u END AS s FROM (SELECT *, translate(token, 'ךםןףץ', 'כמנפצ') AS u FROM {0}))"""


@query(oracle(
    """SELECT token, s AS stem, key, CASE WHEN u LIKE '%ימ' AND length(u) >= 4 THEN left(s, length(s) - 1) || translate(right(s, 1), 'כמנפצ', 'ךםןףץ') WHEN u LIKE '%ות' AND length(u) >= 4 THEN s || 'ה,' || s || 'ת' ELSE '' END AS singulars FROM stems""",
    "product", tokens=_TOKEN_ROWS, stems=_STEMS.format("tokens"),
))
def t3_t5_morphology(c: Catalogue):
    """Stems, folded spellings and singular forms of the table's words in Hebrew letters with Hebrew endings."""
    return _ended(c).select("token", tx.stem(F.col("token")).alias("stem"), tx.match_key(F.col("token")).alias("key"), F.concat_ws(",", tx.singulars(F.col("token"))).alias("singulars"))


@query(oracle(
    "SELECT product_id, bool_and(list_contains(keys, key)) AS satisfied FROM (SELECT product_id, q.key, n.keys FROM asked JOIN stems q USING (token) JOIN (SELECT product_id, list(key) AS keys FROM said JOIN stems USING (token) GROUP BY 1) n USING (product_id)) GROUP BY 1",
    "product",
    said=f"SELECT product_id, unnest(list_transform({WORDS.format('name')}, lambda w: translate(w, '{_LATIN}', '{_LETTERS}'))) AS token FROM product",
    asked=f"SELECT product_id, token || {_ENDS}[product_id % 5 + 1] AS token FROM said WHERE product_id % 7 > 0 UNION ALL SELECT product_id, 'חלב' FROM product WHERE product_id % 7 = 0",
    every="SELECT token FROM said UNION SELECT token FROM asked", stems=_STEMS.format("every"),
))
def t6_tokens_satisfied(c: Catalogue):
    """Whether each name answers a query: its own words with other endings, or, for every seventh product, another word."""
    ends = F.element_at(F.array(*map(F.lit, _ENDS)), (F.col("product_id") % 5 + 1).cast("int"))
    words = F.transform(tx.tokens(F.col("name")), _hebrew)
    asked = F.when(F.col("product_id") % 7 == 0, "חלב").otherwise(F.array_join(F.transform(words, lambda w: F.concat(w, ends)), " "))
    return c.product.select("product_id", tx.all_tokens_in(asked, F.array_join(words, " ")).alias("satisfied"))


@query(oracle(f"SELECT DISTINCT a.name, b.name AS other, floor(({jaccard_sql(GRAMS.format('a.name'), GRAMS.format('b.name'))}) * 1000000 + 0.5e0) AS ppm FROM product a JOIN product b ON a.brand = b.brand AND a.name < b.name", "product"))
def t7_trigram_similarity(c: Catalogue):
    """Similarity of the distinct names of one brand."""
    a = c.product.select("brand", "name").distinct()
    pairs = a.join(a.withColumnRenamed("name", "other"), "brand").where("name < other").select("name", "other").distinct()
    return pairs.select("name", "other", F.floor(tx.similarity(F.col("name"), F.col("other")) * 1000000 + 0.5).cast("double").alias("ppm"))


@query(oracle("SELECT DISTINCT name, CASE WHEN lower(name) = 'red' THEN 1e0 WHEN lower(name) LIKE 'red %' THEN 0.95e0 WHEN lower(name) LIKE '% red' OR lower(name) LIKE '% red %' THEN 0.88e0 WHEN lower(name) LIKE '%red%' THEN 0.78e0 ELSE 0e0 END AS score FROM product", "product"))
def t9_match_ladder(c: Catalogue):
    from basketry.operators.search import ladder

    return c.product.select("name", ladder(F.lit("red"), F.col("name")).alias("score")).distinct()


_CODES = "SELECT '00' || CAST(7290000000000 + p_partkey AS VARCHAR) AS raw, p_partkey % 3 AS item_type FROM part UNION ALL SELECT '0000' || CAST(p_partkey AS VARCHAR), 1 FROM part UNION ALL SELECT '2' || CAST(100000000000 + p_partkey AS VARCHAR), 1 FROM part"
_STRIPPED = "regexp_replace(regexp_replace(raw, '[^0-9]', '', 'g'), '^0+', '')"
_IS_GTIN = f"(item_type = 1 AND (CASE WHEN length(raw) IN (8, 12, 13, 14) THEN length(raw) ELSE length({_STRIPPED}) END) IN (8, 12, 13, 14) AND {_STRIPPED} NOT LIKE '2%')"


@query(f"SELECT raw, item_type, {_IS_GTIN} AS is_gtin, CASE WHEN {_IS_GTIN} THEN CASE WHEN length({_STRIPPED}) >= 8 THEN {_STRIPPED} ELSE raw END ELSE raw END AS code FROM ({_CODES})")
def t10_t12_item_codes(c: Catalogue):
    p = c.raw("part").select("p_partkey")
    text = F.col("p_partkey").cast("string")
    a = p.select(F.concat(F.lit("00"), (F.lit(7290000000000) + F.col("p_partkey")).cast("string")).alias("raw"), (F.col("p_partkey") % 3).alias("item_type"))
    b = p.select(F.concat(F.lit("0000"), text).alias("raw"), F.lit(1).cast("long").alias("item_type"))
    d = p.select(F.concat(F.lit("2"), (F.lit(100000000000) + F.col("p_partkey")).cast("string")).alias("raw"), F.lit(1).cast("long").alias("item_type"))
    rows = a.unionByName(b).unionByName(d)
    return rows.select("raw", "item_type", tx.is_gtin(F.col("item_type"), F.col("raw")).alias("is_gtin"), tx.item_code(F.col("item_type"), F.col("raw")).alias("code"))


@query("SELECT s_suppkey AS store_id, lpad(CAST(s_suppkey AS VARCHAR), CAST(greatest(3, length(CAST(s_suppkey AS VARCHAR))) AS INTEGER), '0') AS code FROM supplier")
def t13_store_codes(c: Catalogue):
    return c.raw("supplier").select(F.col("s_suppkey").alias("store_id"), tx.store_code(F.concat(F.lit(" 0"), F.col("s_suppkey").cast("string"))).alias("code"))


@query("SELECT trim(regexp_replace(p_name || ' & ' || p_brand || ' \"x\"', '\\s+', ' ', 'g')) AS clean FROM part")
def t14_scrubbed(c: Catalogue):
    raw = F.concat(F.col("p_name"), F.lit("&nbsp; &amp;  "), F.col("p_brand"), F.lit("&#x0D; &quot;x&quot; "))
    return c.raw("part").select(tx.scrubbed(raw).alias("clean"))


CITIES = {"city_1": "north", "city_2": "north", "city_3": "centre", "city_4": "centre"}


@query(oracle("SELECT store_id, city, CASE city WHEN 'city_1' THEN 'north' WHEN 'city_2' THEN 'north' WHEN 'city_3' THEN 'centre' WHEN 'city_4' THEN 'centre' END AS region FROM store", "store"))
def t15_alias_lookup(c: Catalogue):
    """A curated alias table as a map: no join is needed."""
    table = F.create_map(*(F.lit(x) for kv in CITIES.items() for x in kv))
    return c.store.select("store_id", "city", F.try_element_at(table, F.col("city")).alias("region"))


@query("SELECT s_suppkey AS store_id, CASE WHEN s_suppkey % 4 = 0 THEN CASE WHEN s_suppkey % 3 = 0 THEN 'pickup' ELSE 'online' END WHEN s_suppkey % 3 = 0 THEN 'pickup' WHEN s_suppkey % 5 = 0 THEN 'online' ELSE 'branch' END AS kind FROM supplier")
def t18_store_kind(c: Catalogue):
    k = F.col("s_suppkey")
    name = F.when(k % 3 == 0, F.concat(F.col("s_name"), F.lit(" pickup point"))).otherwise(F.col("s_name"))
    address = F.when(k % 5 == 0, "https://shop.example.com/x").otherwise("1 Road")
    kind = tx.store_kind(F.when(k % 4 == 0, 2).otherwise(1), name, address)
    return c.raw("supplier").select(k.alias("store_id"), kind.alias("kind"))


_NAME_WORDS = "list_distinct(list_filter(regexp_split_to_array({0}, '[\\s,.\\-/|:+*×]+'), lambda w: length(w) >= 2))"
_LETTER_PAIRS = "list_distinct(list_transform(range(1, length({0})), lambda i: substr({0}, i, 2)))"


def _dice_sql(parts: str) -> str:
    return f"len(list_intersect({parts.format('x')}, {parts.format('y')})) * 2 / (len({parts.format('x')}) + len({parts.format('y')}))"


@query(oracle(
    f"""SELECT name, other, CASE WHEN x = y THEN 1e0 ELSE greatest(words, pairs, CASE WHEN least(length(x), length(y)) >= 4 AND (contains(x, y) OR contains(y, x)) THEN least(length(x), length(y)) / greatest(length(x), length(y)) ELSE 0e0 END) END AS similarity
        FROM (SELECT name, other, replace(x, ' ', '') AS x, replace(y, ' ', '') AS y, {_dice_sql(_NAME_WORDS)} AS words, {_dice_sql(_LETTER_PAIRS).replace('(x', "(replace(x, ' ', '')").replace('(y', "(replace(y, ' ', '')")} AS pairs
        FROM (SELECT DISTINCT a.name, b.name AS other, lower(a.name) AS x, lower(b.name) AS y FROM product a JOIN product b ON a.brand = b.brand AND a.name <= b.name))""",
    "product",
))
def t19_name_similarity(c: Catalogue):
    a = c.product.select("brand", "name").distinct()
    pairs = a.join(a.withColumnRenamed("name", "other"), "brand").where("name <= other")
    return pairs.select("name", "other", tx.name_similarity(F.col("name"), F.col("other")).alias("similarity")).distinct()


@query(oracle("SELECT product_id, a, b, a <> b AS conflict FROM (SELECT product_id, CAST(CAST(size_qty AS BIGINT) % 5 AS DOUBLE) AS a, CAST(product_id % 5 AS DOUBLE) AS b FROM product)", "product"))
def t20_percent_conflict(c: Catalogue):
    a, b = (F.col("size_qty").cast("long") % 5).cast("string"), (F.col("product_id") % 5).cast("string")
    left, right = F.concat(F.lit("milk "), a, F.lit("% x")), F.concat(F.lit("milk "), b, F.lit(" %"))
    return c.product.select("product_id", F.get(tx.percents(left), F.lit(0)).alias("a"), F.get(tx.percents(right), F.lit(0)).alias("b"), tx.percents_conflict(left, right).alias("conflict"))


@query(oracle("SELECT product_id, split_part(lower(name), ' ', 1) IN ('red') OR split_part(lower(name), ' ', 2) IN ('red') AS anchored FROM product", "product"))
def t21_head_anchored(c: Catalogue):
    return c.product.select("product_id", tx.head_anchored(F.lit("red thing"), F.col("name")).alias("anchored"))


@query(oracle(f"SELECT product_id, left(sha256(array_to_string({WORDS.format('name')}, ' ')), 32) AS hash FROM product", "product"))
def t24_content_hash(c: Catalogue):
    return c.product.select("product_id", tx.content_hash(F.col("name")).alias("hash"))


@query(oracle("SELECT product_id, split_part(name, ' ', 1) AS first_word, 'https://shop.example.com/p/' || gtin AS link FROM product", "product"))
def t23_t25_first_word_and_link(c: Catalogue):
    return c.product.select("product_id", F.split_part("name", F.lit(" "), F.lit(1)).alias("first_word"), F.concat(F.lit("https://shop.example.com/p/"), F.url_encode("gtin")).alias("link"))


_UNIT = "CASE product_id % 6 WHEN 0 THEN 'kg' WHEN 1 THEN 'g' WHEN 2 THEN 'ml' WHEN 3 THEN 'liter' WHEN 4 THEN 'units' ELSE 'crate' END"


def _unit():
    k = F.col("product_id") % 6
    return F.when(k == 0, "kg").when(k == 1, " G. ").when(k == 2, "ml").when(k == 3, "Liter").when(k == 4, "units").otherwise("crate")


@query(oracle(f"""SELECT product_id, CASE u WHEN 'kg' THEN size_qty * 1000 WHEN 'liter' THEN size_qty * 1000 ELSE size_qty END AS qty,
    CASE u WHEN 'kg' THEN 'g' WHEN 'g' THEN 'g' WHEN 'ml' THEN 'ml' WHEN 'liter' THEN 'ml' ELSE 'unit' END AS unit, u = 'crate' AS unparseable FROM (SELECT *, {_UNIT} AS u FROM product)""", "product"))
def m1_m2_measure(c: Catalogue):
    rows = c.product.select("product_id", units.measure(F.col("size_qty"), _unit()).alias("m"))
    return rows.select("product_id", "m.qty", "m.unit", "m.unparseable")


@query(oracle("SELECT listing_id, store_id, CASE WHEN price > 0 AND size_qty > 0 THEN floor((CASE size_unit WHEN 'unit' THEN price / size_qty ELSE price / size_qty * 100 END) * 10000 + 0.5e0) / 10000 END AS unit_price FROM store_price JOIN product USING (product_id)", "product", "store_price"))
def m3_unit_price(c: Catalogue):
    rows = c.store_price.join(c.product.select("product_id", "size_qty", "size_unit"), "product_id")
    price = unit_price(F.col("price"), F.col("size_qty"), F.col("size_unit"))
    return rows.select("listing_id", "store_id", (F.floor(price * 10000 + 0.5) / 10000).alias("unit_price"))


@query(oracle(
    """SELECT product_id, CASE k WHEN 0 THEN z WHEN 1 THEN 6 * z WHEN 2 THEN (z + 0.5e0) * 1000 WHEN 3 THEN z * 1000 WHEN 4 THEN 12 END AS qty, CASE k WHEN 0 THEN 'ml' WHEN 1 THEN 'g' WHEN 2 THEN 'ml' WHEN 3 THEN 'g' WHEN 4 THEN 'unit' END AS unit, CASE WHEN k = 4 THEN 12 END AS pieces
        FROM (SELECT product_id, product_id % 6 AS k, CAST(size_qty AS INTEGER) AS z FROM product)""", "product"))
def m4_m5_pack_from_name(c: Catalogue):
    """Pack sizes and counts that names state, put to every name by its id: a quantity, a pack of quantities, a fraction, a Hebrew unit, pieces, or nothing."""
    k, z = F.col("product_id") % 6, F.col("size_qty").cast("int").cast("string")
    said = (
        F.when(k == 0, F.concat("name", F.lit(" "), z, F.lit(" ml"))).when(k == 1, F.concat(F.lit("6 x "), z, F.lit("גרם "), "name")).when(k == 2, F.concat("name", F.lit(" "), z, F.lit(".5 ליטר")))
        .when(k == 3, F.concat(z, F.lit("Kg "), "name")).when(k == 4, F.concat("name", F.lit(" 12 יחידות"))).otherwise(F.col("name"))
    )
    rows = c.product.select("product_id", said.alias("said")).withColumn("p", units.pack_from_name(F.col("said")))
    return rows.select("product_id", F.col("p.qty").alias("qty"), F.col("p.unit").alias("unit"), units.pack_count(F.col("said")).alias("pieces"))


@query(oracle("SELECT basket_id, b.product_id, CASE WHEN size_unit = 'unit' AND size_qty > 1 THEN greatest(1, ceil(qty / size_qty)) WHEN size_unit = 'unit' THEN qty WHEN size_unit = 'g' AND size_qty > 1 THEN greatest(1, ceil(qty * 100 / size_qty)) WHEN size_unit = 'g' THEN qty * 100 / 1000 WHEN size_qty > 1 THEN greatest(1, ceil(qty * 100 / size_qty)) ELSE qty * 100 / 1000 END AS packs FROM basket_line b JOIN product USING (product_id)", "product", "basket_line"))
def m6_packs_to_buy(c: Catalogue):
    """A line asks for pieces of what is counted, and for hundreds of grams or millilitres of the rest."""
    rows = c.basket_line.join(c.product.select("product_id", "size_qty", "size_unit"), "product_id")
    amount = F.when(F.col("size_unit") == "unit", F.col("qty")).otherwise(F.col("qty") * 100)
    return rows.select("basket_id", "product_id", units.packs_to_buy(amount, F.col("size_unit"), F.lit(None).cast("double"), F.col("size_qty"), F.col("size_unit"))["qty"].alias("packs"))


@query(oracle("SELECT DISTINCT a.size_qty AS a, b.size_qty AS b, a.size_unit AS ua, b.size_unit AS ub, CASE WHEN a.size_unit <> b.size_unit THEN 'unit_mismatch' WHEN a.size_qty > 1 AND b.size_qty > 1 AND abs(a.size_qty - b.size_qty) / least(a.size_qty, b.size_qty) > 0.5e0 THEN 'qty_tolerance' ELSE 'same_unit' END AS reason FROM s a CROSS JOIN s b", "product", s="SELECT DISTINCT size_qty, size_unit FROM product"))
def m8_pack_compatibility(c: Catalogue):
    """All pairs of the few distinct sizes, whose number is bounded by the column's values."""
    s = c.product.select("size_qty", "size_unit").distinct()
    pairs = s.select(F.col("size_qty").alias("a"), F.col("size_unit").alias("ua")).join(F.broadcast(s.select(F.col("size_qty").alias("b"), F.col("size_unit").alias("ub"))), F.lit(True))
    return pairs.select("a", "b", "ua", "ub", units.compatible(F.col("a"), F.col("ua"), F.col("b"), F.col("ub")).alias("reason"))


@query(oracle("SELECT product_id, size_unit IN ('g', 'ml') AND (ceil(60 / size_qty) * size_qty - 60) / 60 <= 0.25e0 AS composes FROM product", "product"))
def m9_composes_amount(c: Catalogue):
    return c.product.select("product_id", units.composes(F.col("size_qty"), F.col("size_unit"), F.lit(60.0), F.col("size_unit")).alias("composes"))


@query(oracle("SELECT product_id, CASE WHEN size_unit IN ('g', 'ml') THEN CASE WHEN product_id % 2 = 0 THEN 'ml' ELSE size_unit END ELSE size_unit END AS unit FROM product", "product"))
def m10_family_of_name(c: Catalogue):
    """Units healed by what the name states: even products say their quantity in ml."""
    name = F.when(F.col("product_id") % 2 == 0, F.concat(F.lit("x "), F.col("size_qty").cast("int").cast("string"), F.lit(" ml"))).otherwise(F.lit("x"))
    return c.product.select("product_id", units.family_of_name(F.col("size_qty"), F.col("size_unit"), name).alias("unit"))


@query("SELECT l_orderkey * 10 + l_linenumber AS line, l_partkey, l_suppkey, floor(l_extendedprice * (1 - l_discount) * 100 + 0.5e0) / 100 AS money FROM lineitem")
def m13_rounding(c: Catalogue):
    money = agorot(F.col("l_extendedprice") * (1 - F.col("l_discount")))
    return c.raw("lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("line"), "l_partkey", "l_suppkey", money.alias("money"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 5 < 4 THEN floor(o_totalprice * 100 + 0.5e0) / 100 END AS value FROM orders")
def m14_locale_numbers(c: Catalogue):
    """Totals written with grouped thousands, with a decimal comma, plainly and spaced, and with a word before."""
    k, x = F.col("o_orderkey") % 5, agorot(F.col("o_totalprice")).cast("decimal(18,2)")
    plain = x.cast("string")
    raw = F.when(k == 0, F.format_number(x, 2)).when(k == 1, F.replace(plain, F.lit("."), F.lit(","))).when(k == 2, F.concat(F.lit("  "), plain, F.lit(" "))).when(k == 3, plain).otherwise(F.concat(F.lit("about "), plain))
    return c.raw("orders").select("o_orderkey", tx.number(raw).alias("value"))


@query(
    """SELECT o_orderkey, CASE k WHEN 0 THEN day + INTERVAL (h) HOUR + INTERVAL 30 MINUTE WHEN 1 THEN day WHEN 2 THEN day + INTERVAL (h) HOUR + INTERVAL 5 SECOND END AT TIME ZONE 'Asia/Jerusalem' AT TIME ZONE 'UTC' AS instant
        FROM (SELECT o_orderkey, o_orderkey % 4 AS k, CAST(10 + o_orderkey % 10 AS INTEGER) AS h, date_trunc('day', o_orderdate + INTERVAL 22 YEAR) AS day FROM orders)"""
)
def d1_wall_clock(c: Catalogue):
    """Order days, moved to recent years, as wall clock times in the formats that feeds use, read as instants."""
    k, day = F.col("o_orderkey") % 4, F.col("o_orderdate") + F.expr("INTERVAL 22 YEARS")
    h = (F.col("o_orderkey") % 10 + 10).cast("string")
    date = F.when(k == 0, F.date_format(day, "yyyy-MM-dd")).when(k == 1, F.date_format(day, "dd/MM/yyyy")).when(k == 2, F.concat(F.date_format(day, "yyyy/MM/dd"), F.lit(" "), h, F.lit(":00:05"))).otherwise("soon")
    hour = F.when(k == 0, F.concat(h, F.lit(":30"))).when(k == 2, "")
    return c.raw("orders").select("o_orderkey", dates.il_time(date, hour).cast("timestamp_ntz").alias("instant"))


@query(f"SELECT o_orderkey, CAST(floor(epoch(TIMESTAMP '{NOW}' - o_orderdate) / 86400) AS BIGINT) AS days, floor(epoch(TIMESTAMP '{NOW}' - o_orderdate) / 86400) > 30 AS stale FROM orders")
def d3_age_days(c: Catalogue):
    age = dates.age_days(F.col("o_orderdate").cast("timestamp"), now())
    return c.raw("orders").select("o_orderkey", age.cast("long").alias("days"), (age > dates.STALE_DAYS).alias("stale"))


@query(oracle(f"SELECT store_id, CAST(floor({geo.haversine_sql('32e0', '34.8e0', 'lat', 'lng')} * 1000 + 0.5e0) AS BIGINT) AS metres, lat BETWEEN 29 AND 34 AND lng BETWEEN 34 AND 36 AS valid FROM store", "store"))
def g1_g3_distance(c: Catalogue):
    km = geo.haversine_km(F.lit(32.0), F.lit(34.8), F.col("lat"), F.col("lng"))
    return c.store.select("store_id", F.floor(km * 1000 + 0.5).cast("long").alias("metres"), geo.valid_place(F.col("lat"), F.col("lng")).alias("valid"))


@query(oracle(f"SELECT store_id, floor((CASE WHEN store_id % 2 = 0 THEN sqrt(km * km + 2.6e0 * 2.6e0) ELSE km END) * 100 + 0.5e0) / 100 AS km FROM (SELECT store_id, {geo.haversine_sql('32e0', '34.8e0', 'lat', 'lng')} AS km FROM store)", "store"))
def g4_estimated_distance(c: Catalogue):
    km = geo.haversine_km(F.lit(32.0), F.lit(34.8), F.col("lat"), F.col("lng"))
    return c.store.select("store_id", geo.estimated_km(km, F.when(F.col("store_id") % 2 == 0, "city").otherwise("exact")).alias("km"))


@query(oracle("SELECT city, avg(lat) AS lat, avg(lng) AS lng FROM store GROUP BY 1", "store"))
def g5_centroids(c: Catalogue):
    return c.store.groupBy("city").agg(F.avg("lat").alias("lat"), F.avg("lng").alias("lng"))


@query(oracle("SELECT store_id, lat >= 30 AND lat < 32 AND lng >= 34.5e0 AND lng < 35.5e0 AS inside FROM store", "store"))
def f14_point_in_ring(c: Catalogue):
    """Stores against a stated square; its south and west edges are inside, the others outside, as rays go."""
    corners = [(34.5, 30.0), (35.5, 30.0), (35.5, 32.0), (34.5, 32.0)]
    ring = F.array(*(F.struct(F.lit(x).alias("lng"), F.lit(y).alias("lat")) for x, y in corners))
    return c.store.select("store_id", geo.in_ring(F.col("lng"), F.col("lat"), ring).alias("inside"))


@query()
def v1_hashed_embedding(c: Catalogue):
    """Embeddings of the distinct names, hashed."""
    return c.product.select("name").distinct().select("name", vectors.hashed_embedding(tx.embed_input(F.col("name"))).alias("vector"))


@query("SELECT query_id, id, floor(distance * 1000000 + 0.5e0) AS ppm FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS rank FROM (SELECT a.vec_id AS query_id, b.vec_id AS id, 1 - list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) / sqrt(list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(a.embedding AS DOUBLE[])) * list_dot_product(CAST(b.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))) AS distance FROM embeddings a CROSS JOIN embeddings b WHERE a.vec_id % 20 = 0) WHERE distance <= 0.9e0) WHERE rank <= 5")
def v2_vector_search(c: Catalogue):
    """The five nearest of all vectors for the queries, the vectors whose id is divisible by 20."""
    rows = c.raw("embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    queries = rows.where("id % 20 = 0").select(F.col("id").alias("query_id"), "vector")
    got = vectors.nearest(queries, rows, 5, 0.9)
    return got.select("query_id", "id", F.floor(F.col("distance") * 1000000 + 0.5).cast("double").alias("ppm"))


@query()
def v2_indexed_search(c: Catalogue):
    """The same queries by inverted lists; a test measures the recall against the exact scan."""
    rows = c.raw("embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    queries = rows.where("id % 20 = 0").select(F.col("id").alias("query_id"), "vector")
    got = vectors.nearest_indexed(queries, rows, 5, 0.9)
    return got.select("query_id", "id", F.floor(F.col("distance") * 1000000 + 0.5).cast("double").alias("ppm"))


@query("SELECT event_id, event_type, user_id, value FROM events")
def x1_json_round_trip(c: Catalogue):
    """Objects to JSON text and back through a schema."""
    rows = c.raw("events").select("event_id", F.to_json(F.struct("event_type", "user_id", "value")).alias("j"))
    return rows.select("event_id", F.from_json("j", "event_type string, user_id long, value double").alias("o")).select("event_id", "o.*")


@query(
    """SELECT promotion_id, CASE k WHEN 0 THEN 'n_for_price' WHEN 1 THEN 'n_for_price' WHEN 2 THEN 'club_price' WHEN 3 THEN 'second_unit_pct' WHEN 4 THEN 'second_unit_pct' WHEN 5 THEN 'spend_threshold' WHEN 6 THEN 'simple_discount' WHEN 7 THEN 'simple_discount' WHEN 8 THEN 'other' ELSE 'simple_discount' END AS kind,
        CASE WHEN k IN (0, 1) THEN n END AS n, CASE WHEN k IN (0, 1) THEN p WHEN k = 2 THEN p END AS price, CASE k WHEN 3 THEN 100 WHEN 4 THEN r END AS percent, CASE WHEN k IN (5, 6) THEN r WHEN k = 9 THEN r END AS rate, CASE k WHEN 7 THEN p END AS discounted_price, CASE WHEN k IN (0, 1) THEN n WHEN k = 7 THEN 3 END AS min_qty, k = 9 AS coupon
        FROM (SELECT o_orderkey AS promotion_id, o_orderkey % 10 AS k, CAST(o_orderkey % 4 + 2 AS DOUBLE) AS n, CAST(o_orderkey % 50 + 10 AS DOUBLE) AS p, CAST(o_orderkey % 40 + 5 AS DOUBLE) AS r FROM orders)"""
)
def p1_p2_mechanics(c: Catalogue):
    """Feed fields of every promotion, worded by its id, and the mechanic that the rules read from them."""
    k, o = F.col("o_orderkey") % 10, F.col("o_orderkey")
    n, p, r = (o % 4 + 2).cast("string"), (o % 50 + 10).cast("double"), (o % 40 + 5).cast("double")
    whole, share, no = (o % 50 + 10).cast("string"), (o % 40 + 5).cast("string"), F.lit(None).cast("double")
    text = (
        F.when(k == 0, F.concat(n, F.lit(" ב-"), whole)).when(k == 1, F.concat(n, F.lit(" for "), whole)).when(k == 2, "מחיר מועדון").when(k == 3, "1+1").when(k == 4, F.concat(F.lit("השני ב-"), share, F.lit("%"))).when(k == 5, F.concat(F.lit("בקנייה מעל "), whole))
        .when(k == 8, F.lit(None).cast("string")).when(k == 9, "קופון קוטג").otherwise("deal")
    )
    m = promo.mechanic(text, F.when(k == 7, 3.0), F.when(k.isin(5, 6, 9), r), F.when(k.isin(2, 7), p), F.when(k == 5, p), F.when(k == 2, "7").when(k == 8, "0"))
    rows = c.raw("orders").select(o.alias("promotion_id"), m.alias("m"), promo.requires_coupon(text).alias("coupon"))
    return rows.select("promotion_id", *(F.col(f"m.{x}").alias(x) for x in ("kind", "n", "price", "percent", "rate", "discounted_price", "min_qty")), "coupon")


