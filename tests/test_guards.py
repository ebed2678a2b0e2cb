"""Guards on stated names, the careful ranking, class paths, and the stages of search."""

import pytest
from pyspark.sql import functions as F

from basketry.operators import guards, search
from basketry.plans.registry import QUERIES  # isort: skip  (the registry loads the queries)
from basketry.plans.queries_search import _products, _queries
from basketry.plans.views import Catalogue


def told(spark, rows, schema, column):
    return [r["x"] for r in spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"i int, {schema}").select("i", column.alias("x")).orderBy("i").collect()]


def test_what_is_made_from_a_staple_is_not_the_staple(spark):
    rows = [("אורז", "אורז בסמטי"), ("אורז", "דפי אורז"), ("אורז", "אורז דפי"), ("חמאה", "מרגרינה בטעם חמאה"), ("חמאה", "חמאה בטעם שום"), ("רסק עגבניות", "רסק עגבניות"), ("עגבניות", "רסק עגבניה"), ("חלב", "שוקולד מריר"), ("חלב", "גבינה בטעם"), ("", "דפי אורז"), ("אורז", ""), (None, "דפי")]
    assert told(spark, rows, "q string, n string", guards.unasked_derived(F.col("q"), F.col("n"))) == [False, True, True, True, False, False, True, True, False, False, False, False]
    assert told(spark, [("מלפפונים", "מלפפונים כבושים"), ("מלפפונים כבושים", "מלפפונים כבושים"), ("שמן", "שמן רחצה")], "q string, n string", guards.unasked_preserved(F.col("q"), F.col("n"))) == [True, False, False]
    assert told(spark, [("שמן", "שמן רחצה"), ("שמן רחצה", "שמן רחצה")], "q string, n string", guards.unasked_bath(F.col("q"), F.col("n"))) == [True, False]
    assert told(spark, [("יוגורט", "יוגורט עם פירות"), ("יוגורט עם פירות", "יוגורט עם דבש"), ("יוגורט", "יוגורט")], "q string, n string", guards.unasked_addition(F.col("q"), F.col("n"))) == [True, False, False]


def test_query_cues(spark):
    texts = [("עגבניות",), ("עגבניות מרוסקות",), ("רסק עגבניות",), ("קמח מלא",), ("שמפו",), (None,)]
    assert told(spark, texts, "t string", guards.not_fresh_form(F.col("t"))) == [None, "canned", None, "flour", None, None]
    assert told(spark, texts, "t string", guards.blocks_fresh(F.col("t"))) == [False, True, True, True, False, False]
    assert told(spark, texts, "t string", guards.looks_like_produce(F.col("t"))) == [True, True, True, False, False, False]
    assert told(spark, texts, "t string", guards.for_the_bath(F.col("t"))) == [False, False, False, False, True, False]
    packs = told(spark, [("ביצים תבנית 12",), ("חלב 1.5 ליטר",), ("מים 500 מ\"ל",), ("30 ביצים",), ("6 יח' שימורים",), ("חלב",), (None,)], "t string", guards.stated_pack(F.col("t")))
    assert [tuple(p) for p in packs] == [(12, None, None), (None, 1.5, "L"), (None, 500.0, "ml"), (30, None, None), (6, None, None), (None, None, None), (None, None, None)]


def test_unknown_never_conflicts(spark):
    rows = [("plain", "flavoured"), ("plain", "prepared_meal"), (None, "plain"), ("x", "x")]
    assert told(spark, rows, "a string, b string", guards.preparation_conflict(F.col("a"), F.col("b"))) == [False, True, False, False]
    assert told(spark, rows, "a string, b string", guards.variant_conflict(F.col("a"), F.col("b"))) == [True, True, False, False]
    rows = [(6.0, 1.0, "unit", "x"), (None, 4.0, "unit", "x"), (None, 1.0, "unit", "12 יחידות"), (None, 500.0, "g", "x")]
    assert told(spark, rows, "c double, q double, u string, n string", guards.pieces_of(F.col("c"), F.col("q"), F.col("u"), F.col("n"))) == [6, 4, 12, None]


def test_ranking_takes_each_key_in_turn(spark):
    keys = ["tier", "penalty", "exact_name", "exact_phrase", "agreeing", "covered", "pack_excess", "lexical_score", "distance", "local", "name"]
    best = dict(tier=1, penalty=0, exact_name=True, exact_phrase=True, agreeing=2, covered=2, pack_excess=0.0, lexical_score=1.0, distance=0.1, local=True, name="a")
    worse = dict(tier=2, penalty=3, exact_name=False, exact_phrase=False, agreeing=1, covered=0, pack_excess=1.0, lexical_score=None, distance=None, local=False, name="aa")
    rows = [("q", 99, *best.values())]
    for i, k in enumerate(keys):  # the earlier the key that is worse, the later the row, even if all later keys are as good
        rows.append(("q", i, *{**best, k: worse[k]}.values()))
    rows.append(("q", 50, *{**best, "tier": 0}.values()))
    df = spark.createDataFrame(rows, "query string, product_id int, tier int, penalty int, exact_name boolean, exact_phrase boolean, agreeing int, covered int, pack_excess double, lexical_score double, distance double, local boolean, name string")
    got = search.best_ranked(df.withColumn("e", F.struct("exact_name", "exact_phrase")), ["query"]).orderBy("rank").collect()
    assert [r["product_id"] for r in got] == [99, *range(len(keys) - 1, -1, -1)]


def test_class_paths(spark):
    tree = spark.createDataFrame([("a", "a1", "x"), ("a", "a2", None), ("b", None, None)], "l1 string, l2 string, l3 string")
    rows = [("a", None, None), ("a", "a1", "x"), ("a", "a1", "none"), ("a", "a2", "x"), ("b", "a1", None), ("b", None, "x"), ("c", None, None), (None, None, None)]
    got = guards.valid_path(spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, l1 string, l2 string, l3 string"), tree).orderBy("i").collect()
    assert [r["valid"] for r in got] == [True, True, True, False, False, False, False, False]


def test_probe_finds_every_name_that_holds_a_query(spark):
    names = ["red bolt", "Blue Ring", "x", "", "ring", "rin", "a ring b", "%_", "bolt"]
    products = spark.createDataFrame([(i, n, str(700 + i)) for i, n in enumerate(names)] + [(99, None, "5")], "product_id long, name string, gtin string")
    asked = ["ring", "r", "in", "Bolt", "%", "", "zz", "703", "red bolt"]
    got = {(r["query_id"], r["product_id"]) for r in search.exact_probe(spark.createDataFrame(list(enumerate(asked)), "query_id int, query string"), products).collect()}
    assert got == {(i, j) for i, q in enumerate(asked) for j, n in enumerate(names) if q and (q.lower() in n.lower() or q == str(700 + j))}


@pytest.mark.parametrize("name", ["r6_staged_search", "r6_hybrid_search"])
def test_each_query_is_answered_by_one_stage(spark, sf, name):
    rows = QUERIES[name](spark, sf).collect()
    by = {}
    for r in rows:
        by.setdefault(r["query_id"], set()).add(r["stage"])
    assert all(len(s) == 1 for s in by.values()) and {"exact", "lexical"} <= set.union(*by.values())
    c = Catalogue(spark, sf)
    strong = {r["query_id"] for r in search.exact_probe(_queries(c), _products(c)).where("score >= 1").collect()}
    assert {q for q, s in by.items() if s == {"exact"}} == strong
    assert max(r["rank"] for r in rows) <= 10
