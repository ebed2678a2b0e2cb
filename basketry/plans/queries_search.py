"""Queries of search and resolution: all queries of a table at once."""

from __future__ import annotations

from pyspark.sql import functions as F

from basketry.functions import text as tx
from basketry.functions import units, vectors
from basketry.operators import resolve, search

from .queries_functions import GRAMS, WORDS, jaccard_sql
from .registry import query
from .views import Catalogue, oracle

#: What is asked for, from the table's own rows by their ids: names, first words, codes, and names without their second letter.
Q_SQL = """SELECT min(product_id) AS query_id, name AS query FROM product WHERE product_id % 20 = 0 GROUP BY 2 UNION ALL SELECT 1000000 + min(product_id), split_part(name, ' ', 1) FROM product WHERE product_id % 100 = 0 GROUP BY 2
    UNION ALL SELECT 2000000 + product_id, gtin FROM product WHERE product_id % 200 = 0 UNION ALL SELECT 3000000 + min(product_id), left(name, 1) || substr(name, 3) FROM product WHERE product_id % 140 = 0 GROUP BY 2"""
_TOKENS = WORDS


_HITS = f"SELECT query_id, query, product_id FROM product CROSS JOIN ({Q_SQL}) q WHERE gtin = query OR len(list_filter({_TOKENS.format('query')}, lambda x: NOT list_contains({_TOKENS.format('name')} || {_TOKENS.format('brand')}, x))) = 0"
_LADDER = "CASE WHEN lower(name) = query THEN 1e0 WHEN lower(name) LIKE query || ' %' THEN 0.95e0 WHEN lower(name) LIKE '% ' || query OR lower(name) LIKE '% ' || query || ' %' THEN 0.88e0 WHEN lower(name) LIKE '%' || query || '%' THEN 0.78e0 ELSE 0e0 END"
_ALIKE = jaccard_sql(GRAMS.format("query"), GRAMS.format("name"))
_STOCKED = "SELECT product.*, coalesce(n, 0) AS store_count FROM product LEFT JOIN (SELECT product_id, count(DISTINCT store_id) AS n FROM store_price GROUP BY 1) USING (product_id)"
_RANKED = f"""SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, store_count DESC, name, product_id) AS rank FROM (SELECT query_id, query, product_id, name, store_count,
    CASE WHEN gtin = query THEN 1e0 ELSE greatest({_LADDER}, least(0.86e0, {_ALIKE})) END AS score, CASE WHEN gtin = query THEN 'gtin' ELSE 'product' END AS matched_via FROM hits JOIN stocked USING (product_id))"""
#: The twenty best by the lexical ladder, as common table expressions.
_LEXICAL = {"hits": _HITS, "stocked": _STOCKED, "lexical": f"SELECT * FROM ({_RANKED}) WHERE rank <= 20"}
_SAID = f"SELECT query_id, product_id, store_count, q, n, q = n AS exact_name, contains(' ' || array_to_string(n, ' ') || ' ', ' ' || array_to_string(q, ' ') || ' ') AS exact_phrase, list_contains(n[1:2], q[1]) AS head_anchored, len(list_intersect(q, n)) AS shared_tokens, len(q) AS query_tokens, len(n) AS name_tokens FROM (SELECT query_id, product_id, store_count, {_TOKENS.format('query')} AS q, {_TOKENS.format('name')} AS n FROM hits JOIN stocked USING (product_id))"


def _queries(c: Catalogue):
    p, k = c.product, F.col("product_id")

    def asked(every: int, text, base: int):
        return p.where(k % every == 0).groupBy(text.alias("query")).agg((F.min(k) + base).alias("query_id")).select("query_id", "query")

    return asked(20, F.col("name"), 0).unionByName(asked(100, F.split_part("name", F.lit(" "), F.lit(1)), 1_000_000)).unionByName(asked(200, F.col("gtin"), 2_000_000)).unionByName(asked(140, F.concat(F.left("name", F.lit(1)), F.expr("substr(name, 3)")), 3_000_000))


def _products(c: Catalogue):
    # A product has a current price where it was ever seen, so which is the newest needn't be found.
    counts = c.price_point.groupBy("product_id").agg(F.count_distinct("store_id").alias("store_count"))
    return c.product.join(counts, "product_id", "left").withColumn("store_count", F.coalesce("store_count", F.lit(0)))


@query(oracle(f"SELECT query_id, product_id FROM product CROSS JOIN ({Q_SQL}) q WHERE gtin = query OR len(list_filter({_TOKENS.format('query')}, lambda x: NOT list_contains({_TOKENS.format('name')} || {_TOKENS.format('brand')}, x))) = 0", "product"))
def r1_candidates(c: Catalogue):
    return search.candidates(_queries(c), c.product)


@query(oracle("SELECT query_id, product_id, score, matched_via, rank FROM lexical", "product", "store_price", **_LEXICAL))
def r2_lexical_ranks(c: Catalogue):
    return search.lexical(_queries(c), _products(c)).select("query_id", "product_id", "score", "matched_via", "rank")


@query(oracle(f"SELECT query_id, product_id, CASE WHEN gtin = query OR lower(name) = query THEN 1e0 WHEN lower(name) LIKE query || ' %' THEN 0.95e0 WHEN lower(name) LIKE '% ' || query OR lower(name) LIKE '% ' || query || ' %' THEN 0.88e0 ELSE 0.78e0 END AS score FROM product CROSS JOIN ({Q_SQL}) q WHERE gtin = query OR lower(name) LIKE '%' || query || '%'", "product"))
def r3_exact_probe(c: Catalogue):
    """Names that hold a query as it is, by the pieces of the names that a query begins with, and codes that are one."""
    return search.exact_probe(_queries(c), c.product)


@query(oracle(f"SELECT query_id, product_id, exact_name, exact_phrase, head_anchored, shared_tokens, query_tokens, name_tokens, exact_phrase AND name_tokens <= query_tokens + 2 AS dominant FROM ({_SAID})", "product", "store_price", **_LEXICAL))
def r4_r5_evidence(c: Catalogue):
    rows = search.candidates(_queries(c), c.product).join(_queries(c), "query_id").join(c.product.select("product_id", "name"), "product_id")
    return rows.select("query_id", "product_id", search.evidence(F.col("query"), F.col("name")).alias("e")).select("query_id", "product_id", "e.*")


_EXACT = f"SELECT query_id, product_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, store_count DESC, name, product_id) AS rank FROM (SELECT query_id, product_id, name, CASE WHEN gtin = query OR lower(name) = query THEN 1e0 WHEN lower(name) LIKE query || ' %' THEN 0.95e0 WHEN lower(name) LIKE '% ' || query OR lower(name) LIKE '% ' || query || ' %' THEN 0.88e0 ELSE 0.78e0 END AS score FROM product CROSS JOIN ({Q_SQL}) q WHERE gtin = query OR lower(name) LIKE '%' || query || '%') JOIN stocked USING (product_id, name)"


@query(oracle(
    f"""SELECT query_id, product_id, score, rank, 'exact' AS stage FROM exact WHERE rank <= 10 AND query_id IN (SELECT query_id FROM sure)
        UNION ALL SELECT query_id, product_id, score, rank, 'lexical' AS stage FROM lexical WHERE rank <= 10 AND query_id IN (SELECT query_id FROM strong) AND query_id NOT IN (SELECT query_id FROM sure)
        UNION ALL SELECT query_id, product_id, least(0.86e0, alike) AS score, row_number() OVER (PARTITION BY query_id ORDER BY least(0.86e0, alike) DESC, product_id) AS rank, 'fuzzy'
        FROM (SELECT query_id, product_id, {_ALIKE} AS alike FROM product CROSS JOIN ({Q_SQL}) q WHERE query_id NOT IN (SELECT query_id FROM strong) AND query_id NOT IN (SELECT query_id FROM sure)) WHERE alike >= 0.4e0 QUALIFY rank <= 10""",
    "product", "store_price", **_LEXICAL, strong="SELECT query_id FROM lexical WHERE rank = 1 AND score >= 0.88e0", exact=_EXACT, sure="SELECT query_id FROM exact WHERE rank = 1 AND score >= 1",
))
def r6_staged_search(c: Catalogue):
    return search.staged(_queries(c), _products(c))


@query()
def r6_hybrid_search(c: Catalogue):
    """The same with vectors: queries that are neither exact nor strong by words are answered by their fuzzy and vector ranks fused."""
    names = c.product.select("name").distinct().select(F.col("name").alias("id"), vectors.hashed_embedding(tx.embed_input(F.col("name"))).alias("vector"))
    asked = _queries(c).select("query_id", vectors.hashed_embedding(tx.embed_input(F.col("query"))).alias("vector"))
    return search.staged(_queries(c), _products(c), near=vectors.nearest(asked, names, 10, vectors.NEAR))


@query(oracle("SELECT query_id, product_id, score, store_count FROM lexical WHERE store_count > 0", "product", "store_price", **_LEXICAL))
def r7_stock_order(c: Catalogue):
    ranks = search.lexical(_queries(c), _products(c))
    return ranks.where("store_count > 0").select("query_id", "product_id", "score", "store_count")


@query(oracle(f"SELECT query_id, product_id, row_number() OVER (PARTITION BY query_id ORDER BY exact_name DESC, exact_phrase DESC, head_anchored DESC, shared_tokens DESC, name_tokens, store_count DESC, product_id) AS rank FROM ({_SAID}) QUALIFY rank <= 10", "product", "store_price", **_LEXICAL))
def r12_r13_ranker(c: Catalogue):
    """Candidates by tier, evidence and stock: a struct as one sort key."""
    from basketry.operators.windows import first_per

    rows = search.candidates(_queries(c), _products(c)).join(_queries(c), "query_id").join(_products(c), "product_id")
    e = search.evidence(F.col("query"), F.col("name"))
    order = [F.desc(e["exact_name"]), F.desc(e["exact_phrase"]), F.desc(e["head_anchored"]), F.desc(e["shared_tokens"]), F.asc(e["name_tokens"]), F.desc("store_count"), F.col("product_id")]
    return first_per(rows, ["query_id"], order, 10, "rank").select("query_id", "product_id", "rank")


@query(oracle("SELECT query_id, product_id, CASE WHEN first >= 0.9e0 AND (second IS NULL OR first - second >= 0.15e0 OR first >= 1) THEN 'auto' ELSE 'confirm' END AS decision FROM (SELECT query_id, max(score) FILTER (WHERE rank = 1) AS first, max(score) FILTER (WHERE rank = 2) AS second, max(product_id) FILTER (WHERE rank = 1) AS product_id FROM lexical GROUP BY 1)", "product", "store_price", **_LEXICAL))
def r14_decisions(c: Catalogue):
    return search.decisions(search.lexical(_queries(c), _products(c)))


@query(oracle(f"SELECT query_id, CASE WHEN n = 0 THEN 'opaque' WHEN classes > 1 THEN 'cross_class' WHEN brands = 1 THEN 'brand_pinned' ELSE 'commodity' END AS risk FROM (SELECT q.query_id, count(product_id) AS n, count(DISTINCT category) AS classes, count(DISTINCT brand) AS brands FROM ({Q_SQL}) q LEFT JOIN (SELECT query_id AS qid, p.* FROM product p CROSS JOIN ({Q_SQL}) x WHERE gtin = query OR lower(name) LIKE '%' || query || '%') c ON c.qid = q.query_id GROUP BY 1)", "product"))
def r15_line_risk(c: Catalogue):
    hits = search.exact_probe(_queries(c), c.product).join(c.product.select("product_id", "category", "brand"), "product_id")
    options = _queries(c).select("query_id").join(hits.select("query_id", "product_id", "category", "brand"), "query_id", "left")
    return resolve.line_risk(options, ["query_id"]).select("query_id", "risk")


@query(oracle(
    f"""SELECT product_id, row_number() OVER (PARTITION BY product_id ORDER BY similarity DESC, other_id) AS place, other_id, similarity FROM (SELECT a.product_id, b.product_id AS other_id, len(list_intersect(a.w, b.w)) * 2 / (len(a.w) + len(b.w)) AS similarity
        FROM named a JOIN named b ON a.category = b.category AND a.size_unit = b.size_unit AND a.product_id <> b.product_id) WHERE similarity >= 0.5e0 QUALIFY place <= 5""",
    "product", named=f"SELECT product_id, category, size_unit, list_distinct({_TOKENS.format('name')}) AS w FROM product",
))
def r17_equivalents(c: Catalogue):
    return resolve.equivalents(c.product)


@query(oracle(
    f"""SELECT a.category, a.size_unit, a.label AS label, b.label AS other, len(list_intersect(a.w, b.w)) * 2 / (len(a.w) + len(b.w)) AS similarity FROM labels_ a JOIN labels_ b ON a.category = b.category AND a.size_unit = b.size_unit AND a.label < b.label
        WHERE len(list_intersect(a.w, b.w)) * 2 / (len(a.w) + len(b.w)) >= 0.75e0""",
    "product", labels_=f"SELECT DISTINCT category, size_unit, name || ' ' || brand || ' ' || CAST(CAST(size_qty AS INTEGER) % 10 AS VARCHAR) AS label, list_distinct({_TOKENS.format("name || ' ' || brand || ' ' || CAST(CAST(size_qty AS INTEGER) % 10 AS VARCHAR)")}) AS w FROM product",
))
def r17_similar_labels(c: Catalogue):
    """Labels of one class and unit (name, brand, last digit of the size) that share three quarters of their words: the set-similarity join alone."""
    label = F.concat_ws(" ", "name", "brand", (F.col("size_qty").cast("int") % 10).cast("string")).alias("id")
    rows = c.product.select("category", "size_unit", label).distinct()
    found = resolve.similar_sets(rows.withColumn("words", tx.tokens(F.col("id"))), ["category", "size_unit"], 0.75)
    return found.select("category", "size_unit", F.col("id").alias("label"), "other", "similarity")


@query(oracle("SELECT category, chain_id, count(*) AS stores FROM (SELECT DISTINCT category, chain_id, store_id FROM store_price JOIN product USING (product_id)) GROUP BY 1, 2", "product", "store_price"))
def r18_class_coverage(c: Catalogue):
    rows = c.store_price.join(c.product.select("product_id", "category"), "product_id")
    return rows.groupBy("category", "chain_id").agg(F.count_distinct("store_id").alias("stores"))


@query(oracle("SELECT DISTINCT a.category AS a, b.category AS b, a.size_unit AS ua, b.size_unit AS ub, CASE WHEN a.category <> b.category THEN 'different' WHEN a.size_unit <> b.size_unit THEN 'same_l1' ELSE 'same_l2' END AS relation FROM k a CROSS JOIN k b", "product", k="SELECT DISTINCT category, size_unit FROM product"))
def r19_class_relation(c: Catalogue):
    """All pairs of the few distinct class paths."""
    k = c.product.select("category", "size_unit").distinct()
    none = F.lit(None).cast("string")
    pairs = k.select(F.col("category").alias("a"), F.col("size_unit").alias("ua")).join(F.broadcast(k.select(F.col("category").alias("b"), F.col("size_unit").alias("ub"))), F.lit(True))
    return pairs.select("a", "b", "ua", "ub", resolve.class_relation((F.col("a"), F.col("ua"), none), (F.col("b"), F.col("ub"), none)).alias("relation"))


@query(oracle("SELECT product_id, CASE product_id % 4 WHEN 0 THEN 'exact' WHEN 1 THEN 'commodity' WHEN 2 THEN 'brand_family' ELSE 'exact' END AS mode FROM product", "product"))
def r20_intent_mode(c: Catalogue):
    """Every product asked for by its code, by its name, by brand and name, or by brand, name and pack."""
    k = F.col("product_id") % 4
    text = F.when(k == 0, F.concat(F.lit(" "), "gtin")).when(k == 1, F.col("name")).when(k == 2, F.concat_ws(" ", "brand", "name")).otherwise(F.concat_ws(" ", "brand", "name", F.concat(F.col("size_qty").cast("int").cast("string"), F.lit(" ml"))))
    rows = c.product.select("product_id", "brand", text.alias("text"))
    pack = units.pack_from_name(F.col("text")).isNotNull()
    return rows.select("product_id", resolve.intent_mode(F.col("text"), F.contains("text", F.col("brand")), pack).alias("mode"))


@query(oracle(
    """SELECT query_id, CASE WHEN best.n >= 3 AND best.n >= first.n * 3 THEN best.p ELSE first.p END AS product_id, best.n >= 3 AND best.n >= first.n * 3 AS upgraded
        FROM (SELECT query_id, arg_min({'p': product_id, 'n': store_count}, rank) AS first, arg_max({'p': product_id, 'n': store_count}, store_count * 1000 - rank) AS best FROM lexical GROUP BY 1)""",
    "product", "store_price", **_LEXICAL,
))
def b13_upgraded_primary(c: Catalogue):
    ranks = search.lexical(_queries(c), _products(c))
    return resolve.upgraded_primary(ranks, ["query_id"])


@query()
def v3_rank_fusion(c: Catalogue):
    """Lexical and vector ranks fused: names are embedded once each, queries are a stated few."""
    names = c.product.select("name").distinct().select("name", vectors.hashed_embedding(tx.embed_input(F.col("name"))).alias("vector"))
    asked = _queries(c).select("query_id", vectors.hashed_embedding(tx.embed_input(F.col("query"))).alias("vector"))
    near = vectors.nearest(asked, names.select(F.col("name").alias("id"), "vector"), 3, 0.9)
    by_vector = near.join(c.product.groupBy("name").agg(F.min("product_id").alias("product_id")), near["id"] == F.col("name")).select("query_id", "product_id", "rank")
    return search.hybrid(search.lexical(_queries(c), _products(c)).select("query_id", "product_id", "rank"), by_vector)


@query(oracle("SELECT product_id, name || ' ' || brand || ' ' || category AS text FROM product", "product"))
def z25_embedding_text(c: Catalogue):
    return c.product.select("product_id", F.concat_ws(" ", "name", "brand", "category").alias("text"))
