"""Plans whose figures must grow no faster than the input: what is sent to all tasks, what meets in one task."""

import re

import pytest
from pyspark.sql import functions as F

from basketry.operators import basket, places, search
from basketry.plans.registry import QUERIES
from basketry.plans.views import Catalogue
from basketry.sources import feeds


def sent(df):
    """The plan of everything that is broadcast, as it is before statistics of a run are known."""
    lines = df._jdf.queryExecution().executedPlan().toString().split("\n")
    depth = [len(re.match(r"[\s:+\-]*", x).group()) for x in lines]
    out = []
    for i, x in enumerate(lines):
        if "BroadcastExchange" in x:
            end = next((j for j in range(i + 1, len(lines)) if depth[j] <= depth[i]), len(lines))
            out.append("\n".join(lines[i:end]))
    return out


@pytest.mark.parametrize("name", ["t16_town_of_text", "t17_town_of_store_name", "z2_top_unresolved"])
def test_exploded_texts_are_not_sent_to_all_tasks(spark, sf, name):
    assert not [p for p in sent(QUERIES[name](spark, sf)) if "Generate" in p or "customer" in p]


def test_a_long_list_of_names_gives_the_same_towns(spark, monkeypatch):
    texts = spark.createDataFrame([(1, "road haifa 3, lod"), (2, "road haifa 3"), (3, "old port"), (4, "road old port lod 1"), (5, None)], "text_id int, text string")
    towns = spark.createDataFrame([("haifa", "haifa", "town"), ("lod", "lod", "town"), ("old port", "tel aviv", "quarter"), ("old port lod", "other", "town")], "alias string, town string, kind string")
    few = sorted(map(tuple, places.town_of_text(texts, towns, ("road",)).collect()))
    monkeypatch.setattr(places, "MOST_NAMES", 2)
    assert sorted(map(tuple, places.town_of_text(texts, towns, ("road",)).collect())) == few == [(1, "lod"), (2, "haifa"), (3, "tel aviv"), (4, "other")]


@pytest.mark.parametrize("name", ["r1_candidates", "r3_exact_probe", "r4_r5_evidence", "r6_staged_search", "r14_decisions", "r2_lexical_ranks"])
def test_candidates_are_not_counted_in_a_map_of_pairs(spark, sf, name):
    plan = QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"HashAggregate\(keys=\[query_id#\d+L?, product_id#\d+L?\]", plan)


def test_candidates_hold_all_tokens_or_the_code(spark):
    products = [(1, "red ring", "acme", "11"), (2, "ring red red", "b", "22"), (3, "red bolt", "acme", None), (4, "44 ring", "c", "44"), (5, None, "red", "55")]
    queries = [(1, "Red ring"), (2, "acme red"), (3, "44"), (4, " 22 "), (5, "none red"), (6, "red red"), (7, "!"), (8, None), (9, "55")]
    rows = search.candidates(spark.createDataFrame(queries, "query_id long, query string"), spark.createDataFrame(products, "product_id long, name string, brand string, gtin string"))
    assert sorted(map(tuple, rows.collect())) == [(1, 1), (1, 2), (2, 1), (2, 3), (3, 4), (4, 2), (6, 1), (6, 2), (6, 3), (6, 5), (9, 5)]


@pytest.mark.parametrize("name", ["b1_candidate_fold", "b3_tiered_totals"])
def test_a_line_is_shuffled_once_and_not_per_store(spark, sf, name):
    """After the rows are made per store, nothing deals them out by basket and store again."""
    plan = QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"hashpartitioning\(basket_id#\d+L?, (product_id#\d+L?, )?store_id#\d+L?", plan)


def test_a_landed_feed_has_files_of_bounded_size(spark, monkeypatch):
    """A file is read by one task and its header as one row, so files must not grow with the feed."""
    monkeypatch.setattr(feeds, "FILE_ROWS", 10)
    rows = spark.range(95).coalesce(1).selectExpr("string(id) AS ItemCode", "'0' AS ItemType", "'4,5' AS Quantity", "'2kg' AS UnitQty", "'3.5' AS ItemPrice")
    got = feeds.read_prices(spark, feeds.landed(rows, "Item"))
    assert got.select("file").distinct().count() == 10
    assert {tuple(r) for r in got.select("size_qty", "size_unit", "price").collect()} == {(2000.0, "g", 3.5)} and got.count() == 95


def test_requests_with_the_same_answer_share_a_list(spark):
    stores = spark.createDataFrame([(1, "lod", 31.9, 34.9), (2, "lod", 31.9, 34.9), (3, "haifa", 32.8, 35.0)], "store_id long, city string, lat double, lng double")
    asked = [(i, None, 31.9, 34.9) for i in range(4)] + [(4, "Lod east", None, None), (5, "lod", None, None), (6, None, None, None), (7, None, None, None), (8, "far", None, None), (9, None, 30.0, 34.1)]
    requests = spark.createDataFrame([(*x, 15.0) for x in asked], "request_id int, city string, lat double, lng double, radius_km double")
    told, lists = places.located_by_list(requests, stores)
    assert sorted(tuple(x["stores"]) for x in lists.collect()) == [(1, 2), (1, 2), (1, 2, 3), (3,)]
    assert {x["request_id"]: x["stores"] for x in places.located(requests, stores).collect()} == {**{i: [1, 2] for i in range(6)}, 6: [1, 2, 3], 7: [1, 2, 3], 8: [], 9: []}
    assert told.count() == 10


def test_pairs_of_codes_are_not_shuffled(spark, sf):
    assert not re.search(r"hashpartitioning\(listing_id#\d+L?, promotion_id#\d+L?", QUERIES["j5_either_code"](spark, sf)._jdf.queryExecution().executedPlan().toString())


@pytest.mark.parametrize("name", ["b11_multi_store", "z34_multi_plans"])
def test_plans_over_several_stores_shuffle_lines_with_arrays(spark, sf, name):
    plan = QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"MapInArrow plan\(basket_id#\d+L?, product_id#\d+L?, stores#\d+", plan)


def test_lines_with_arrays_are_planned_as_rows(spark, sf):
    c = Catalogue(spark, sf)
    lines, ways = c.basket_line.where("basket_id % 5 = 0"), c.store.select("store_id", (F.col("store_id") % 30).cast("double").alias("km"), F.lit("exact").alias("accuracy"))
    rows = [sorted(map(tuple, basket.multi_store(x, ways, 0.5).collect())) for x in (basket.price_lines(lines, c.store_price), basket.offered(lines, c.store_price, ways))]
    assert rows[0] == rows[1] and len(rows[0]) > 100


def test_reasons_move_in_arrays_of_their_product(spark, sf):
    plan = QUERIES["b2_missing_reasons"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"hashpartitioning\(product_id#\d+L?, (store_id|chain_id)#\d+L?", plan.split("Generate explode(stores")[1])


def test_reasons_of_missing_lines(spark):
    table = lambda rows, schema: spark.createDataFrame(rows, schema)
    lines = table([(1, 10), (1, 11), (2, 10), (2, 99), (3, None)], "basket_id long, product_id long")
    got = basket.missing_reason(
        lines, table([(10,), (11,)], "product_id long"), table([(10, 5)], "product_id long, chain_id long"), table([(10, 1), (10, 1)], "product_id long, store_id long"), table([(1, 5), (2, 5), (3, 6), (4, None)], "store_id long, chain_id long")
    )
    whole = lambda b, p, why: {(b, p, s, why) for s in (1, 2, 3, 4)}
    own = {(b, 10, *x) for b in (1, 2) for x in ((2, "no_price_here"), (3, "not_carried_by_chain"), (4, "not_carried_by_chain"))}
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, own | whole(1, 11, "no_price_data") | whole(2, 99, "product_not_found") | whole(3, None, "product_not_found")))


@pytest.mark.parametrize("name", ["r7_stock_order", "r12_r13_ranker", "t22_guarded_words"])
def test_stores_are_counted_without_finding_the_newest_price(spark, sf, name):
    assert "max_by" not in QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()


def test_words_of_products_are_told_apart_after_dealing_out(spark, sf):
    plan = QUERIES["r1_candidates"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression" in plan
    for part in plan.split("RepartitionByExpression [product_id")[1:]:
        assert "words" not in part.split("Relation")[0].split("\n", 1)[1]


def test_equivalents_are_ranked_per_text_not_per_product(spark, sf):
    plan = QUERIES["r17_equivalents"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert not re.search(r"Window \[[^\n]*\], \[product_id#", plan)


def test_equivalents_leave_out_the_product_itself(spark):
    from basketry.operators import resolve

    products = [(i, "red ring", "a", "g") for i in (9, 3, 5)] + [(4, "red bolt", "a", "g"), (6, "red ring", "b", "g"), (7, None, "a", "g"), (8, "!", "a", "g")]
    got = resolve.equivalents(spark.createDataFrame(products, "product_id long, name string, category string, size_unit string"), limit=2)
    want = {(3, 1, 5, 1.0), (3, 2, 9, 1.0), (5, 1, 3, 1.0), (5, 2, 9, 1.0), (9, 1, 3, 1.0), (9, 2, 5, 1.0), (4, 1, 3, 0.5), (4, 2, 5, 0.5)}
    assert set(map(tuple, got.collect())) == want


def test_lists_of_lacking_stores_are_not_shuffled(spark, sf):
    """After a product's stores are judged nothing is joined or dealt out."""
    plan = QUERIES["b2_missing_reasons"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Exchange|Join", plan.split("array_except")[0].split("== Initial Plan ==")[0])


def test_a_product_of_many_baskets_has_all_its_reasons(spark, monkeypatch):
    monkeypatch.setattr(basket, "AT_ONCE", 3)
    of = lambda rows, *names: spark.createDataFrame(rows, ", ".join(f"{x} long" for x in names))
    lines = of([(b, 1) for b in range(10)] + [(None, 1)], "basket_id", "product_id")
    got = basket.missing_reason(lines, of([(1,)], "product_id"), of([(1, 5)], "product_id", "chain_id"), of([(1, 2)], "product_id", "store_id"), of([(1, 5), (2, 5), (3, 6)], "store_id", "chain_id"))
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(str((b, 1, s, why)) for b in [*range(10), None] for s, why in ((1, "no_price_here"), (3, "not_carried_by_chain")))
