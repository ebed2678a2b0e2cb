"""Queries over a vocabulary table that is made of the products' own words: spans, profiles, constraints, expansions, gates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketry.operators import vocabulary as vo

from .queries_functions import WORDS
from .registry import query
from .views import Catalogue, oracle

#: How strong an attribute asked for is, which pairs of values may stand for each other, what a missing value is.
STRENGTHS = {"state": "hard", "pack": "ranking"}
RELAXED = [("state", "red", "blue"), ("state", "cold", "hot")]
MISSING = {"state": "reject"}


def table_of(c: Catalogue) -> DataFrame:
    """Terms from the products: first words are states (of an even number of letters they imply boxes), second words concepts or, with five letters, boxes; some whole
    names are concepts, names with some brands aliases of the name, high brands penalties, and every code is a term of its own."""
    w1, w2 = F.split_part("name", F.lit(" "), F.lit(1)), F.split_part("name", F.lit(" "), F.lit(2))
    number = F.regexp_extract("brand", "[0-9]+", 0).cast("int")
    boxed, even = F.char_length(w2) == 5, F.char_length(w1) % 2 == 0
    no = F.lit(None).cast("string")

    def terms(rows: DataFrame, term, mode, kind, attribute, value, priority, a=no, v=no) -> DataFrame:
        columns = [x if not isinstance(x, (str, int)) else F.lit(x) for x in (term, mode, kind, attribute, value, priority, a, v)]
        return rows.select(*(x.alias(n) for x, n in zip(columns, vo.TERM))).distinct()

    p = c.product
    parts = [
        terms(p, w1, "token", "attribute", "state", w1, 1, F.when(even, "pack"), F.when(even, "boxed")),
        terms(p, w2, "token", F.when(boxed, "attribute").otherwise("concept"), F.when(boxed, "pack"), F.when(boxed, "boxed").otherwise(w2), 1),
        terms(p.where(F.char_length(w1) == 5), F.col("name"), "phrase", "concept", no, F.col("name"), 2),
        terms(p.where(number % 5 == 0), F.concat_ws(" ", "name", "brand"), "alias", "alias", no, F.col("name"), 3),
        terms(p.where(number >= 20), F.col("brand"), "phrase", "penalty", "brand", F.col("brand"), 1),
        terms(p, F.col("gtin"), "exact", "concept", no, F.col("gtin"), 4),
    ]
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out


_W1, _W2, _NUMBER = "split_part(name, ' ', 1)", "split_part(name, ' ', 2)", "CAST(regexp_extract(brand, '[0-9]+') AS INT)"
_VOCABULARY = f"""SELECT DISTINCT {_W1} AS term, 'token' AS mode, 'attribute' AS kind, 'state' AS attribute, {_W1} AS value, 1 AS priority, CASE WHEN length({_W1}) % 2 = 0 THEN 'pack' END AS implies_attribute, CASE WHEN length({_W1}) % 2 = 0 THEN 'boxed' END AS implies_value FROM product
    UNION ALL SELECT DISTINCT {_W2}, 'token', CASE WHEN length({_W2}) = 5 THEN 'attribute' ELSE 'concept' END, CASE WHEN length({_W2}) = 5 THEN 'pack' END, CASE WHEN length({_W2}) = 5 THEN 'boxed' ELSE {_W2} END, 1, NULL, NULL FROM product
    UNION ALL SELECT DISTINCT name, 'phrase', 'concept', NULL, name, 2, NULL, NULL FROM product WHERE length({_W1}) = 5
    UNION ALL SELECT DISTINCT name || ' ' || brand, 'alias', 'alias', NULL, name, 3, NULL, NULL FROM product WHERE {_NUMBER} % 5 = 0
    UNION ALL SELECT DISTINCT brand, 'phrase', 'penalty', 'brand', brand, 1, NULL, NULL FROM product WHERE {_NUMBER} >= 20
    UNION ALL SELECT DISTINCT gtin, 'exact', 'concept', NULL, gtin, 4, NULL, NULL FROM product"""
_TEXTS = "SELECT DISTINCT name || ' ' || brand AS text FROM product UNION SELECT gtin FROM product UNION SELECT name FROM product"
_BY = "priority DESC, {0} length(surface) DESC, {1} surface, kind, coalesce(attribute, ''), coalesce(value, '')"
_SPANS = {
    "vocabulary": _VOCABULARY,
    "texts": _TEXTS,
    "v": f"SELECT *, {WORDS.format('term')} AS words, array_to_string({WORDS.format('term')}, ' ') AS surface FROM vocabulary",
    "t": f"SELECT text, {WORDS.format('text')} AS w FROM texts",
    "runs": "SELECT text, s, n, array_to_string(w[s + 1:s + n], ' ') AS surface FROM (SELECT text, w, CAST(unnest(range(len(w))) AS INTEGER) AS s FROM t), (SELECT unnest([1, 2, 3, 4]) AS n) WHERE s + n <= len(w)",
    "cand": """SELECT text, s AS "start", s + n AS "end", v.* FROM runs JOIN v USING (surface) WHERE mode <> 'exact' UNION ALL SELECT text, 0, CAST(len(w) AS INTEGER), v.* FROM t JOIN v ON array_to_string(w, ' ') = surface WHERE mode = 'exact'""",
    "ranks": f"""SELECT *, row_number() OVER (PARTITION BY text ORDER BY {_BY.format('"end" - "start" DESC,', '"start",')}) AS r FROM cand""",
    "pick": """SELECT text, CAST(0 AS BIGINT) AS r, CAST([] AS STRUCT(a INTEGER, b INTEGER)[]) AS taken, FALSE AS ok FROM t UNION ALL SELECT text, r, CASE WHEN good THEN list_append(taken, {'a': "start", 'b': "end"}) ELSE taken END, good FROM (
        SELECT c.text, c.r, c."start", c."end", p.taken, len(list_filter(p.taken, lambda x: NOT ((x.a = c."start" AND x.b = c."end") OR c."end" <= x.a OR x.b <= c."start"))) = 0 AS good FROM pick p JOIN ranks c ON c.text = p.text AND c.r = p.r + 1)""",
    "chosen": f"""SELECT ranks.*, row_number() OVER (PARTITION BY text ORDER BY "start", "end" DESC, {_BY.format('', '')}) AS place FROM ranks JOIN pick USING (text, r) WHERE ok""",
    "direct": "SELECT text, attribute, value FROM chosen WHERE kind = 'attribute' QUALIFY row_number() OVER (PARTITION BY text, attribute ORDER BY place) = 1",
    "attrs": """SELECT * FROM direct UNION ALL SELECT text, implies_attribute, implies_value FROM chosen c WHERE implies_attribute IS NOT NULL AND NOT EXISTS (SELECT 1 FROM direct d WHERE d.text = c.text AND d.attribute = c.implies_attribute)
        QUALIFY row_number() OVER (PARTITION BY text, implies_attribute ORDER BY place) = 1""",
    "asked": f"""SELECT *, CASE WHEN source = 'explicit' AND attribute = 'state' THEN 'hard' ELSE 'ranking' END AS strength FROM (SELECT a.*, CASE WHEN EXISTS (SELECT 1 FROM chosen c WHERE c.text = a.text AND c.kind = 'attribute' AND c.implies_attribute = a.attribute AND c.implies_value = a.value)
        AND NOT EXISTS (SELECT 1 FROM chosen c WHERE c.text = a.text AND c.kind = 'attribute' AND c.attribute = a.attribute AND c.value = a.value AND c.implies_attribute IS NULL) THEN 'implied' ELSE 'explicit' END AS source FROM attrs a)""",
}


def _sql(select: str, **more: str) -> str:
    return oracle(select, "product", **_SPANS, **more).replace("WITH ", "WITH RECURSIVE ", 1)


def _texts(c: Catalogue) -> DataFrame:
    p = c.product
    return p.select(F.concat_ws(" ", "name", "brand").alias("text")).union(p.select("gtin")).union(p.select("name")).distinct()


def _spans(c: Catalogue) -> DataFrame:
    return vo.spans(_texts(c), table_of(c))


@query(_sql("""SELECT text, term, kind, "start", "end" FROM chosen"""))
def r8_term_spans(c: Catalogue):
    """The vocabulary's terms in every name, name with brand, and code."""
    return _spans(c).select("text", F.explode("spans").alias("s")).select("text", "s.term", "s.kind", "s.start", "s.end")


@query(_sql(
    """SELECT t.text, coalesce(a.attributes, '') AS attributes, coalesce(k.concepts, '') AS concepts, coalesce(k.penalties, '') AS penalties FROM t LEFT JOIN (SELECT text, string_agg(attribute || '=' || value, ',' ORDER BY attribute) AS attributes FROM attrs GROUP BY 1) a USING (text)
        LEFT JOIN (SELECT text, string_agg(DISTINCT value, ',' ORDER BY value) FILTER (WHERE kind = 'concept') AS concepts, string_agg(DISTINCT attribute || ':' || value, ',' ORDER BY attribute || ':' || value) FILTER (WHERE kind = 'penalty') AS penalties FROM chosen GROUP BY 1) k USING (text)"""
))
def r8_r9_profiles(c: Catalogue):
    """Attributes, concepts and penalties of the same texts."""
    p = _spans(c).select("text", vo.profile(F.col("spans")).alias("p"))
    attributes = F.array_join(F.transform(F.array_sort(F.map_entries("p.attributes")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")
    return p.select("text", attributes.alias("attributes"), F.array_join("p.concepts", ",").alias("concepts"), F.array_join("p.penalties", ",").alias("penalties"))


@query(_sql("SELECT text, attribute, value, strength, source FROM asked"))
def r10_z23_constraints(c: Catalogue):
    """What each text asks for if it is a query; what its terms only imply is never hard."""
    rows = _spans(c).select("text", F.explode(vo.constraints(F.col("spans"), STRENGTHS)).alias("x"))
    return rows.select("text", "x.attribute", "x.value", "x.strength", "x.source")


@query(_sql(
    """SELECT text, coalesce(array_to_string(list_distinct_in_order[1:4], '|'), text) AS said FROM t LEFT JOIN (SELECT m.text, list_concat([m.text, value], list_filter(terms, lambda x: x <> m.text)) AS list_distinct_in_order FROM
        (SELECT text, value FROM t JOIN v ON array_to_string(w, ' ') = surface WHERE kind = 'alias') m JOIN (SELECT value, list_sort(list_distinct(list(term))) AS terms FROM v WHERE kind = 'alias' GROUP BY 1) USING (value)) USING (text)"""
))
def r10_expansions(c: Catalogue):
    """Other ways to say each text, by the aliases of the vocabulary."""
    return vo.expansions(_texts(c), table_of(c)).select("text", F.array_join("said", "|").alias("said"))


@query(_sql(
    """SELECT query, text, count(conflict) = 0 AS allowed, CASE WHEN count(conflict) > 0 THEN 0 WHEN count(eased) > 0 THEN 2 WHEN any_value(penalties) > 0 THEN 2 ELSE 1 END AS tier, coalesce(string_agg(conflict, ',' ORDER BY attribute), '') AS conflicts,
        coalesce(string_agg(eased, ',' ORDER BY attribute), '') AS eased, any_value(penalties) AS penalty FROM verdicts GROUP BY 1, 2""",
    pairs=f"SELECT DISTINCT q.name AS query, p.name || ' ' || p.brand AS text FROM product q JOIN product p ON {_W2.replace('name', 'q.name')} = {_W2.replace('name', 'p.name')} WHERE q.product_id % 20 = 0",
    fined="SELECT text, count(DISTINCT value) AS n FROM chosen WHERE kind = 'penalty' GROUP BY 1",
    verdicts="""SELECT p.query, p.text, q.attribute, coalesce(f.n, 0) AS penalties,
        CASE WHEN q.attribute = 'state' AND a.value IS NULL AND q.strength = 'hard' THEN 'state:requested_' || q.value || '_got_missing' WHEN a.value <> q.value AND NOT (q.value = 'red' AND a.value = 'blue') AND NOT (q.value = 'cold' AND a.value = 'hot') AND q.strength = 'hard' THEN q.attribute || ':requested_' || q.value || '_got_' || a.value END AS conflict,
        CASE WHEN a.value IS NULL OR a.value = q.value THEN NULL WHEN (q.value = 'red' AND a.value = 'blue') OR (q.value = 'cold' AND a.value = 'hot') THEN q.attribute || ':' || q.value || '_' || a.value WHEN q.source = 'implied' THEN q.attribute || ':implied_mismatch' WHEN q.strength <> 'hard' THEN q.attribute || ':soft_mismatch' END AS eased
        FROM pairs p LEFT JOIN asked q ON q.text = p.query LEFT JOIN attrs a ON a.text = p.text AND a.attribute = q.attribute LEFT JOIN fined f ON f.text = p.text""",
))
def r11_gate(c: Catalogue):
    """Names of every twentieth product as queries, against every name and brand of the same second word."""
    noun = F.split_part("name", F.lit(" "), F.lit(2)).alias("noun")
    asked = c.product.where(F.col("product_id") % 20 == 0).select(F.col("name").alias("query"), noun).distinct()
    names = c.product.select(F.concat_ws(" ", "name", "brand").alias("text"), noun).distinct()
    terms = table_of(c)
    asked = vo.spans(asked, terms, "query").select("query", "noun", vo.constraints(F.col("spans"), STRENGTHS).alias("asked"), vo.profile(F.col("spans"))["penalties"].alias("own"))
    names = vo.spans(names, terms).select("text", "noun", vo.profile(F.col("spans")).alias("profile"))
    g = asked.join(names, "noun").withColumn("g", vo.gate(F.col("asked"), F.col("own"), F.col("profile"), RELAXED, MISSING))
    eased = F.filter("g.relaxed", lambda x: ~F.startswith(x, F.lit("penalty:")))
    return g.select("query", "text", "g.allowed", "g.tier", F.array_join("g.conflicts", ",").alias("conflicts"), F.array_join(eased, ",").alias("eased"), F.col("g.penalty").cast("long").alias("penalty"))
