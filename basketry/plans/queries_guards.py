"""Queries of guards and of the careful ranking: names of every twentieth product as queries, against the names that share a word."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketry.functions import text as tx
from basketry.operators import guards, search
from basketry.operators import vocabulary as vo

from .queries_functions import GRAMS, WORDS, jaccard_sql
from .queries_vocabulary import MISSING, RELAXED, STRENGTHS, _sql, table_of
from .registry import query
from .views import Catalogue, oracle

#: The word lists of the guards in the words of the driver's products.
WORDS_HERE = guards.Words(derived=("ring", "rod", "cold"), flavours=("hot",), preserved=("old",), bath=("gizmo",), not_fresh=(("aged", ("old",)), ("iced", ("cold", "blue"))), produce=("red b", "anvil"), made_of_produce=("plate",), non_food=("PROMO",), not_fresh_classes=("SMALL", "PROMO"))


def _list(words) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


_N, _T = WORDS.format("name"), WORDS.format("text")


@query(oracle(
    f"""SELECT text, CASE WHEN list_has_any(w, ['old']) THEN 'aged' WHEN list_has_any(w, ['cold', 'blue']) THEN 'iced' END AS form, list_has_any(w, ['old', 'cold', 'blue', 'plate']) AS blocks, contains(array_to_string(w, ' '), 'red b') OR contains(array_to_string(w, ' '), 'anvil') AS produce, list_has_any(w, ['gizmo']) AS bath,
        CASE WHEN k = 0 THEN 12 END AS pieces, CASE k WHEN 1 THEN 1.5e0 WHEN 2 THEN 500e0 END AS quantity, CASE k WHEN 1 THEN 'L' WHEN 2 THEN 'ml' END AS unit FROM (SELECT text, k, {_T} AS w FROM (SELECT DISTINCT name || CASE product_id % 4 WHEN 0 THEN ' תבנית 12' WHEN 1 THEN ' 1.5 ליטר' WHEN 2 THEN ' 500 ml' ELSE '' END AS text, product_id % 4 AS k FROM product))""",
    "product",
))
def z21_query_cues(c: Catalogue):
    """Cues of every name, with a pack put to it by the product's id."""
    k = F.col("product_id") % 4
    text = F.concat("name", F.when(k == 0, " תבנית 12").when(k == 1, " 1.5 ליטר").when(k == 2, " 500 ml").otherwise(""))
    rows = c.product.select(text.alias("text")).distinct()
    x, pack = F.col("text"), guards.stated_pack(F.col("text"))
    return rows.select("text", guards.not_fresh_form(x, WORDS_HERE).alias("form"), guards.blocks_fresh(x, WORDS_HERE).alias("blocks"), guards.looks_like_produce(x, WORDS_HERE).alias("produce"), guards.for_the_bath(x, WORDS_HERE).alias("bath"), pack["pieces"].alias("pieces"), pack["quantity"].alias("quantity"), pack["unit"].alias("unit"))


def _asked(c: Catalogue) -> DataFrame:
    return c.product.where(F.col("product_id") % 20 == 0).select(F.col("name").alias("query")).distinct()


def _pairs(c: Catalogue) -> DataFrame:
    """(query, and a product of each distinct name, class and unit that shares a word with it)."""
    words = _asked(c).select("query", F.explode(tx.tokens(F.col("query"))).alias("word"))
    goods = c.product.groupBy("name", "category", "size_unit").agg(F.min("product_id").alias("product_id"), F.min("size_qty").alias("size_qty"))
    hits = words.join(goods.select("name", "category", "size_unit", "product_id", "size_qty", F.explode(tx.tokens(F.col("name"))).alias("word")), "word")
    return hits.drop("word").distinct()


_PAIRS = f"""SELECT q.query, g.* FROM (SELECT DISTINCT name AS query FROM product WHERE product_id % 20 = 0) q JOIN (SELECT name, category, size_unit, min(product_id) AS product_id, min(size_qty) AS size_qty FROM product GROUP BY 1, 2, 3) g ON list_has_any({WORDS.format('q.query')}, {WORDS.format('g.name')})"""
_DERIVED = "len(list_filter(range(1, len(n) + 1), lambda i: (list_contains(['ring', 'rod', 'cold'], n[i]) OR n[i] = 'hot') AND NOT list_contains(q, n[i]) AND CASE WHEN NOT list_contains(n, q[1]) THEN n[i] <> 'hot' WHEN n[i] = 'hot' THEN i < list_position(n, q[1]) ELSE i < list_position(n, q[1]) OR i = list_position(n, q[1]) + 1 END)) > 0"
_REASONS = f"""SELECT *, CASE WHEN list_contains(n, 'old') AND NOT list_contains(q, 'old') THEN 'preserved' WHEN list_contains(n, 'gizmo') AND NOT list_contains(q, 'gizmo') THEN 'bath'
    WHEN CASE WHEN product_id % 5 = 0 THEN product_id % 10 = 0 AND NOT list_has_any(q, ['ring', 'rod', 'cold']) ELSE {_DERIVED} END THEN 'derived' WHEN pq <> pn THEN 'percent' WHEN category = 'PROMO' AND NOT ok AND NOT list_contains(q, 'gizmo') THEN 'non_food'
    WHEN length(query) % 2 = 0 AND category IN ('SMALL', 'PROMO') THEN 'not_fresh' WHEN size_unit = 'unit' AND size_qty > 1 AND size_qty <> 12 AND starts_with(query, 'large') THEN 'pieces' END AS reason FROM (
    SELECT p.*, {WORDS.format('p.query')} AS q, {WORDS.format('p.name')} AS n, CASE WHEN length(query) % 3 = 0 THEN 3 END AS pq, CASE WHEN p.product_id % 3 = 0 THEN 1 + p.product_id % 4 END AS pn, ok FROM pairs p JOIN (SELECT query, arg_min(category, product_id) = 'PROMO' OR bool_and(category = 'PROMO') AS ok FROM pairs GROUP BY 1) USING (query))"""


def _reasons(c: Catalogue) -> DataFrame:
    rows, k = _pairs(c), F.col("product_id")
    percent = lambda text, n: F.concat(text, F.when(n.isNotNull(), F.concat(F.lit(" "), n.cast("string"), F.lit("%"))).otherwise(""))
    ok = guards.asks_non_food(rows.select("query", F.col("category").alias("class_l1"), k.alias("rank")), WORDS_HERE, ("query",))
    asked, name = percent(F.col("query"), F.when(F.char_length("query") % 3 == 0, 3)), percent(F.col("name"), F.when(k % 3 == 0, k % 4 + 1))
    no = F.lit(None).cast("string")
    preparation = F.when(k % 10 == 0, "prepared_meal").when(k % 5 == 0, "plain")
    pieces = guards.pieces_of(F.lit(None).cast("double"), F.col("size_qty"), F.col("size_unit"), F.col("name"))
    reason = guards.why_not(asked, name, preparation, F.col("category"), no, no, pieces, F.when(F.startswith("query", F.lit("large")), 12), F.char_length("query") % 2 == 0, F.col("non_food_ok"), WORDS_HERE)
    return rows.join(ok, "query").withColumn("reason", reason)


@query(oracle("SELECT query, product_id, reason FROM reasons", "product", pairs=_PAIRS, reasons=_REASONS))
def r16_z31_staple_guards(c: Catalogue):
    """Why each name can't stand for a query, or null: preserved, for the bath, made from it, another percentage, no food, not fresh, another count."""
    return _reasons(c).select("query", "product_id", "reason")


@query(oracle(
    "SELECT a.product_id, b.product_id AS other_id, coalesce(va <> vb, FALSE) AS variant, coalesce(CASE WHEN pa IN ('plain', 'flavoured') THEN 'staple' ELSE pa END <> CASE WHEN pb IN ('plain', 'flavoured') THEN 'staple' ELSE pb END, FALSE) AS preparation, coalesce(ca <> cb, FALSE) AS pieces FROM a JOIN b ON a.nxt = b.product_id",
    "product",
    a="SELECT product_id, product_id + 1 AS nxt, CASE product_id % 3 WHEN 0 THEN 'organic' WHEN 1 THEN 'regular' END AS va, CASE product_id % 4 WHEN 0 THEN 'plain' WHEN 1 THEN 'flavoured' WHEN 2 THEN 'prepared_meal' END AS pa, CASE WHEN size_unit = 'unit' AND size_qty > 1 THEN size_qty WHEN product_id % 6 = 1 THEN 12 END AS ca FROM product",
    b="SELECT product_id, va AS vb, pa AS pb, ca AS cb FROM a",
))
def z30_conflicts(c: Catalogue):
    """Whether a product and the next one differ in variant, preparation or count of pieces."""
    k = F.col("product_id")
    name = F.concat("name", F.when(k % 6 == 1, " 12 יחידות").otherwise(""))
    a = c.product.select(k, F.when(k % 3 == 0, "organic").when(k % 3 == 1, "regular").alias("v"), F.when(k % 4 == 0, "plain").when(k % 4 == 1, "flavoured").when(k % 4 == 2, "prepared_meal").alias("p"), guards.pieces_of(F.lit(None).cast("double"), F.col("size_qty"), F.col("size_unit"), name).alias("n"))
    b = a.select((k - 1).alias("product_id"), k.alias("other_id"), F.col("v").alias("vb"), F.col("p").alias("pb"), F.col("n").alias("nb"))
    return a.join(b, "product_id").select("product_id", "other_id", guards.variant_conflict(F.col("v"), F.col("vb")).alias("variant"), guards.preparation_conflict(F.col("p"), F.col("pb")).alias("preparation"), guards.pieces_conflict(F.col("n"), F.col("nb")).alias("pieces"))


@query(oracle(
    "SELECT product_id, CASE WHEN l1 NOT IN (SELECT DISTINCT category FROM product) THEN FALSE WHEN l2 IS NULL THEN l3 IS NULL OR l3 = 'none' WHEN NOT EXISTS (SELECT 1 FROM tree t WHERE t.l1 = r.l1 AND t.l2 = r.l2) THEN FALSE ELSE l3 IS NULL OR l3 = 'none' OR EXISTS (SELECT 1 FROM tree t WHERE t.l2 = r.l2 AND t.l3 = r.l3) END AS valid FROM r",
    "product", tree="SELECT DISTINCT category AS l1, category || '/' || size_unit AS l2, category || '/' || size_unit || '/' || brand AS l3 FROM product WHERE product_id % 2 = 0",
    r="SELECT product_id, CASE WHEN product_id % 11 = 0 THEN 'nowhere' ELSE category END AS l1, CASE WHEN product_id % 5 > 0 THEN category || '/' || size_unit END AS l2, CASE product_id % 3 WHEN 0 THEN 'none' WHEN 1 THEN category || '/' || size_unit || '/' || brand END AS l3 FROM product",
))
def z24_class_paths(c: Catalogue):
    """Whether each product's path is one of the taxonomy that the even products make."""
    k, path = F.col("product_id"), F.concat_ws("/", "category", "size_unit")
    tree = c.product.where(k % 2 == 0).select(F.col("category").alias("l1"), path.alias("l2"), F.concat_ws("/", path, "brand").alias("l3")).distinct()
    firsts = c.product.select(F.col("category").alias("l1"), F.lit(None).cast("string").alias("l2"), F.lit(None).cast("string").alias("l3")).distinct()
    rows = c.product.select(k, F.when(k % 11 == 0, "nowhere").otherwise(F.col("category")).alias("l1"), F.when(k % 5 > 0, path).alias("l2"), F.when(k % 3 == 0, "none").when(k % 3 == 1, F.concat_ws("/", path, "brand")).alias("l3"))
    return guards.valid_path(rows, tree.unionByName(firsts)).select("product_id", "valid")


@query(_sql(
    f"""SELECT query, product_id, row_number() OVER (PARTITION BY query ORDER BY tier, penalty > 0, exact_name DESC, exact_phrase DESC, agreeing DESC, covered DESC, pack_excess, lexical_score DESC, distance NULLS LAST, local DESC, length(name), product_id) AS rank FROM (
        SELECT p.query, p.product_id, p.name, CASE WHEN count(conflict) > 0 THEN 0 WHEN count(eased) > 0 THEN 2 ELSE 1 END AS tier, 0 AS penalty, p.name = p.query AS exact_name, contains(' ' || p.name || ' ', ' ' || p.query || ' ') AS exact_phrase, count(*) FILTER (WHERE agrees) AS agreeing,
        len(list_intersect({WORDS.format('p.query')}, {WORDS.format('p.name')})) AS covered, abs(p.size_qty - 20) AS pack_excess, any_value({jaccard_sql(GRAMS.format('p.query'), GRAMS.format('p.name'))}) AS lexical_score, CASE WHEN p.product_id % 2 = 0 THEN (p.product_id % 7) / 10 END AS distance, p.product_id % 3 = 0 AS local
        FROM pairs p LEFT JOIN told v ON v.query = p.query AND v.text = p.name GROUP BY p.query, p.product_id, p.name, p.size_qty) WHERE tier > 0 QUALIFY rank <= 10""",
    pairs=_PAIRS,
    told="""SELECT q.text AS query, n.text, q.attribute, a.value = q.value AS agrees, CASE WHEN q.attribute = 'state' AND a.value IS NULL AND q.strength = 'hard' THEN 'm' WHEN a.value <> q.value AND NOT (q.value = 'red' AND a.value = 'blue') AND NOT (q.value = 'cold' AND a.value = 'hot') AND q.strength = 'hard' THEN 'c' END AS conflict,
        CASE WHEN a.value IS NULL OR a.value = q.value THEN NULL WHEN (q.value = 'red' AND a.value = 'blue') OR (q.value = 'cold' AND a.value = 'hot') OR q.source = 'implied' OR q.strength <> 'hard' THEN 'e' END AS eased FROM (SELECT DISTINCT query, name FROM pairs) p JOIN asked q ON q.text = p.query JOIN texts n ON n.text = p.name LEFT JOIN attrs a ON a.text = p.name AND a.attribute = q.attribute""",
))
def r12_r13_careful_ranker(c: Catalogue):
    """The ten best of each query by all the keys of the careful ranking: gate, evidence, agreement, pack, scores, stock."""
    terms, pairs, k = table_of(c), _pairs(c), F.col("product_id")
    asked = vo.spans(_asked(c), terms, "query").select("query", vo.constraints(F.col("spans"), STRENGTHS).alias("asked"), vo.profile(F.col("spans"))["penalties"].alias("own"))
    names = vo.spans(c.product.select("name").distinct(), terms, "name").select("name", vo.profile(F.col("spans")).alias("profile"))
    rows = pairs.join(asked, "query").join(names, "name").withColumn("g", vo.gate(F.col("asked"), F.col("own"), F.col("profile"), RELAXED, MISSING)).withColumn("e", search.evidence(F.col("query"), F.col("name")))
    agreeing = F.size(F.filter("asked", lambda x: F.coalesce(F.try_element_at(F.col("profile.attributes"), x["attribute"]) == x["value"], F.lit(False))))
    rows = rows.select("query", "product_id", "name", "g.tier", "g.penalty", "e", agreeing.alias("agreeing"), F.col("e.shared_tokens").alias("covered"), F.abs(F.col("size_qty") - 20).alias("pack_excess"), tx.similarity(F.col("query"), F.col("name")).alias("lexical_score"), F.when(k % 2 == 0, (k % 7) / 10).alias("distance"), (k % 3 == 0).alias("local"))
    return search.best_ranked(rows, ["query"], 10).select("query", "product_id", "rank")
