"""Seconds of the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS], one JSON line. Each query runs once to warm up and then ROUNDS times; the median counts."""

from __future__ import annotations

import json
import os
import statistics
import tempfile
import time

from pyspark.sql import SparkSession

ROUNDS = 3
QUERIES = [
    "p6_compare_prices", "p5_best_promotion", "p8_substitutes", "p9_price_history", "b1_price_baskets", "b6_comparable_costs", "b8_best_store", "b11_multi_store", "l7_ranked_plans", "r2_lexical_ranks", "r6_staged_search",
    "r17_equivalents", "v2_vector_search", "v3_rank_fusion", "k4_price_upsert", "k5_price_changes", "k6_reconcile", "a1_store_counts", "a14_median_by_class", "w1_top_per_chain", "a5_duplicates", "j1_star_join",
]


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").config("spark.driver.memory", "12g").config("spark.sql.shuffle.partitions", cpus).config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.local.dir", folder).config("spark.sql.warehouse.dir", f"{folder}/warehouse").config("spark.checkpoint.dir", f"file://{folder}/shared").getOrCreate()
    )
    spark.sparkContext.setLogLevel("OFF")
    from basketry.plans.registry import QUERIES as REGISTERED

    seconds = {}
    for name in QUERIES:
        took = []
        for _ in range(1 + ROUNDS):
            began = time.perf_counter()
            REGISTERED[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            took.append(time.perf_counter() - began)
        seconds[name] = round(statistics.median(took[1:]), 3)
    print(json.dumps({"metric": "sum of median seconds over headline queries", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": os.path.basename(os.path.normpath(sf_dir)), "cpus": int(cpus), "rounds": ROUNDS}))
    spark.stop()


if __name__ == "__main__":
    main()
