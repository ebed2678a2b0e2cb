"""What stores ask moves with a line in a few bytes a store; choices and plans of a basket are made in its row."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from basketry.functions import offers
from basketry.operators import basket, delivery, lines
from basketry.plans.registry import QUERIES
from basketry.plans.views import Catalogue

rows = lambda df: sorted(map(tuple, df.collect()), key=str)


@pytest.mark.parametrize("scale", [1, 0.001])
@pytest.mark.parametrize("far", [False, True])
def test_packed_offers_come_back_as_they_were(scale, far):
    rng, parts, blobs = np.random.default_rng(1), [], []
    for power in (3, 6, 12):
        sizes = rng.integers(0, 30, 40)
        stores = np.concatenate([np.sort(rng.choice(10**power, n, replace=False)) for n in sizes]).astype(np.int64) - 7
        parts.append((sizes, stores, np.round(rng.uniform(0, 1e5, len(stores)), 2) * scale, rng.uniform(0, 9, len(stores)) if far else None))
        blobs.append(offers.pack(*parts[-1]))
    got = offers.unpack(pa.concat_arrays([*blobs, pa.nulls(1, pa.binary())]).slice(40))
    assert got[0].tolist() == [*parts[1][0], *parts[2][0], 0]
    for i in (1, 2, 3) if far else (1, 2):
        assert np.array_equal(got[i], np.concatenate([parts[1][i], parts[2][i]]))
    assert far or got[3] is None


def test_a_store_of_a_line_takes_about_five_bytes(spark, sf):
    c = Catalogue(spark, sf)
    ways = c.store.select("store_id", F.lit(1.0).alias("km"), F.lit("exact").alias("accuracy"))
    sizes = basket.offered(c.dealt_line, c.dealt_price, ways, basket.sent_ways(ways)).where("stores IS NOT NULL").select(F.sum(F.length("stores")), F.count(F.lit(1))).first()
    pairs = basket.price_lines(c.basket_line, c.store_price).count()
    assert sizes[0] - sizes[1] * offers.HEAD <= 5 * pairs


def test_tiers_are_chosen_and_added_up_as_by_rows(spark):
    asked, prices, _ = _random(spark)
    candidates = spark.createDataFrame([(p, p, 0) for p in range(30)] + [(p, p // 5 * 5, 1) for p in range(30) if p % 5] + [(p, 29, 2) for p in range(25)], "product_id long, candidate_id long, tier int")
    want = asked.join(lines.tiered_units(candidates, prices), "product_id").withColumn("a", F.floor(F.floor(F.col("unit") * F.col("qty") * 100 + 0.5) / 100 * 100 + 0.5))
    want = want.groupBy("basket_id", "store_id").agg(F.sum("a").alias("agorot"), F.count(F.lit(1)).alias("lines"), F.count_if(F.col("tier") == 0).alias("strict"))
    assert rows(lines.tiered_totals(asked, candidates, prices)) == rows(want) != []


def test_lines_with_tiers_move_in_bytes(spark, sf):
    plan = QUERIES["b3_tiered_totals"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Generate explode(arrays_zip" not in plan and "hashpartitioning(product_id#" in plan and "hashpartitioning(candidate_id#" not in plan.split("Generate")[0]


@pytest.mark.parametrize("name", ["b4_basket_totals", "b8_best_store", "b11_multi_store", "l7_ranked_plans"])
def test_lines_and_prices_are_dealt_out_by_product_once(spark, sf, name):
    plan = QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("REPARTITION_BY_COL") == 3 and "hashpartitioning(listing_id" not in plan


def _random(spark):
    rng = random.Random(5)
    lines = [(b, p, float(rng.randint(1, 4))) for b in range(60) for p in rng.sample(range(30), rng.randint(1, 6))] + [(90, 999, 1.0), (91, 1, None), (None, 1, 1.0)]
    prices = [(p, s * 1_000_003, round(rng.uniform(1, 200), 3 if p == 4 else 2)) for p in range(30) for s in rng.sample(range(20), rng.randint(0, 20))]
    ways = [(s * 1_000_003, None if s == 3 else s / 2, "unknown" if s == 4 else "exact") for s in range(18)]
    return spark.createDataFrame(lines, "basket_id long, product_id long, qty double"), spark.createDataFrame(prices, "product_id long, store_id long, price double"), spark.createDataFrame(ways, "store_id long, km double, accuracy string")


def test_distances_sent_to_all_tasks_give_what_carried_ones_do(spark, monkeypatch):
    lines, prices, ways = _random(spark)
    sent = basket.sent_ways(ways)
    a, b = basket.summed(basket.offered(lines, prices, ways)), basket.summed(basket.offered(lines, prices, ways, sent))
    assert rows(basket.unfolded(a, "store_id", "effective")) == rows(basket.unfolded(b, "store_id", "effective", sent=sent)) != []
    for best in (basket.best_store, basket.closest_store):
        assert rows(best(a)) == rows(best(b, sent=sent)) != []
    assert rows(basket.multi_store(basket.offered(lines, prices, ways), ways, 0.5)) == rows(basket.multi_store(basket.offered(lines, prices, ways, sent), ways, 0.5, sent=sent)) != []
    monkeypatch.setattr(basket, "MOST_STORES", 17)
    assert basket.sent_ways(ways) is None


def test_plans_in_a_basket_s_row_are_those_of_rows(spark, monkeypatch):
    lines, prices, _ = _random(spark)
    baskets = basket.summed(basket.offered(lines, prices))
    services = [(s * 1_000_003, s % 3 if s % 7 else None, 99.0 if s % 4 == 0 else None, float(s) if s % 3 == 0 else None) for s in range(2, 15)]
    services = spark.createDataFrame(services, "store_id long, service_type int, minimum_order double, service_pct double")
    tariffs = [(0, "standard", None, 150.0, 35.9, None), (0, "standard", 150.0, 500.0, 29.9, None), (0, "standard", 150.0, None, 9.9, "club"), (1, "standard", 400.0, None, 15.0, None), (1, "standard", 300.0, None, None, None), (2, "express", None, None, 45.0, None)]
    tariffs = spark.createDataFrame(tariffs, "service_type int, slot string, min_subtotal double, max_subtotal double, fee double, membership string")
    columns = ["basket_id", "store_id", "priced_lines", "delivered_total", "cost", "place"]
    want = delivery.ranked(delivery.plans(basket.unfolded(baskets, *basket.COSTS), services, tariffs))
    assert rows(delivery.placed(baskets, services, tariffs)) == rows(want.select(columns)) != []
    assert rows(delivery.placed(baskets, services, tariffs, best=True)) == rows(delivery.best_order(want).select(columns)) != []
    monkeypatch.setattr(basket, "MOST_STORES", 5)
    assert rows(delivery.placed(baskets, services, tariffs)) == rows(want.select(columns))


def test_a_choice_per_product_and_quantity_is_the_fold_of_candidates(spark, monkeypatch):
    """Against the fold over rows, with unknown sizes and quantities, and products without a class or a store; no row a candidate and store is grouped."""
    monkeypatch.setattr(basket, "AT_ONCE", 3)
    asked, prices, _ = _random(spark)
    own = spark.createDataFrame([(p, f"c{p % 4}" if p % 7 else None, None if p % 5 == 0 else float(p % 6 + 1)) for p in range(28)], "product_id long, class string, size double")
    peers = own.where("class IS NOT NULL AND product_id < 14").select("class", F.col("product_id").alias("peer_id"), F.col("size").alias("peer_size"))
    got = basket.candidate_offers(asked, own, peers, prices)
    options = own.select("product_id", F.col("product_id").alias("candidate_id"), "size", F.lit(0).alias("candidate_rank")).unionByName(
        own.join(peers, "class").where("peer_id <> product_id").select("product_id", F.col("peer_id").alias("candidate_id"), F.col("peer_size").alias("size"), F.col("peer_id").cast("int").alias("candidate_rank"))
    )
    each = asked.where("qty IS NOT NULL").join(options, "product_id").join(prices.select(F.col("product_id").alias("candidate_id"), "store_id", "price"), "candidate_id")
    each = each.select("basket_id", "product_id", "store_id", "candidate_rank", "candidate_id", (F.col("price") / F.col("size")).alias("unit_price"), (F.col("price") * F.col("qty")).alias("line_total"))
    want = basket.cheapest_candidate(each, ["basket_id", "product_id", "store_id"])
    assert rows(got) == rows(want.select(got.columns)) != []
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert not any("Aggregate" in x and "candidate_rank" in x for x in plan.split("\n")) and "ArrowEvalPython [best(" in plan
