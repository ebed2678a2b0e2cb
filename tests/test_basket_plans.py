"""What a line costs at each store travels in the line's arrays: no row per basket and store is shuffled."""

import random

import pytest
from pyspark.sql import functions as F

from basketry.operators import basket
from basketry.plans.registry import QUERIES

UNFOLDED = ["b4_basket_totals", "b5_plausible_lines", "b6_comparable_costs", "b7_effective_cost", "l1_delivery_fees", "l6_delivery_plans", "l7_ranked_plans", "l8_best_order", "z36_quotable"]


@pytest.mark.parametrize("name", UNFOLDED + ["b8_best_store", "b9_cheapest_complete", "b10_closest_useful", "z34_single_plans"])
def test_rows_of_stores_are_not_shuffled(spark, sf, name):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString().split("\n")
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    unfolds = [i for i, x in enumerate(plan) if "Generate explode(at" in x or "Generate explode(arrays_zip" in x]
    assert bool(unfolds) == (name in UNFOLDED)
    assert not any("Exchange hashpartitioning" in x for x in plan[: max(unfolds, default=0)])
    assert sum("median" in x and "Aggregate" in x for x in plan) == 0


def test_summed_baskets_equal_comparable_rows(spark):
    """Ties, missing lines, baskets without a store, an unknown quantity; a basket or product of null prices nothing."""
    rng = random.Random(3)
    lines = [(b, p, float(rng.randint(1, 4))) for b in range(40) for p in rng.sample(range(30), rng.randint(1, 6))] + [(90, 999, 1.0), (91, 1, None), (None, 1, 1.0), (92, None, 1.0)]
    prices = [(p, s, round(rng.uniform(-1, 20), 2)) for p in range(30) for s in rng.sample(range(12), rng.randint(0, 12)) for _ in range(2)]
    lines = spark.createDataFrame(lines, "basket_id long, product_id long, qty double")
    prices = spark.createDataFrame(prices, "product_id long, store_id long, price double")
    ways = spark.createDataFrame([(s, None if s == 3 else s / 2, "unknown" if s == 4 else "exact") for s in range(12)], "store_id long, km double, accuracy string")
    priced, baskets = basket.price_lines(lines, prices), basket.summed(basket.offered(lines, prices, ways))
    rows = lambda df: sorted(map(tuple, df.collect()), key=str)
    costs = basket.comparable(priced)
    assert rows(basket.unfolded(baskets, *basket.COSTS).select(costs.columns)) == rows(costs)
    costed = basket.effective_cost(costs, ways)
    assert rows(basket.best_store(baskets).select(*basket.COSTS)) == rows(basket.best_single(costed).select(*basket.COSTS))
    assert rows(basket.closest_store(baskets).select("basket_id", "store_id")) == rows(basket.closest_useful(costed).select("basket_id", "store_id"))
    asked = lines.groupBy("basket_id").agg(F.count(F.lit(1)).alias("asked_lines"))
    assert rows(basket.complete_store(baskets).where("store_id IS NOT NULL").select("basket_id", "store_id", "total")) == rows(basket.cheapest_complete(costs, asked))
    assert rows(basket.plausible_offers(basket.offered(lines, prices))) == rows(basket.plausible(priced).select("basket_id", "product_id", "store_id", "line_total"))
