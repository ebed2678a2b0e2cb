"""Queries that run a stream over landed rows of the tables to its end and return what it left."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basketry.sources.storage import fresh_path
from basketry.streaming import drain, expiry

from .registry import query
from .views import Catalogue, oracle

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _landed(rows: DataFrame, folder: str) -> DataFrame:
    rows.write.mode("append").parquet(folder)
    return rows.sparkSession.readStream.schema(rows.schema).parquet(folder)


def _with_rocks(spark: SparkSession, run) -> None:
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, ROCKS)
    try:
        run()
    finally:
        spark.conf.set(name, before)


@query(oracle(
    """SELECT product_id, substr(sha256(name || CASE WHEN product_id % 5 = 0 AND product_id % 7 > 0 THEN ' new' ELSE '' END || ' ' || brand || ' ' || category), 1, 32) AS text_hash, CASE WHEN product_id % 5 = 0 AND product_id % 7 > 0 THEN 1 ELSE 0 END AS batch,
        CASE WHEN product_id % 7 = 0 THEN 2 ELSE 0 END AS attempts FROM product""",
    "product",
))
def r25_st5_semantic_drain(c: Catalogue):
    """Three rounds of dirty products: all; every third as before and every fifth renamed, every seventh nameless; the nameless again. The index and its failures after the last."""
    k = F.col("product_id")
    nameless, renamed = k % 7 == 0, k % 5 == 0
    rows = c.product.select("product_id", "name", "brand", "category")
    changed = F.when(nameless, F.lit(None).cast("string")).when(renamed, F.concat("name", F.lit(" new"))).otherwise(F.col("name"))
    rounds = [rows, rows.where((k % 3 == 0) | renamed | nameless).withColumn("name", changed), rows.where(nameless).withColumn("name", F.lit(None).cast("string"))]
    landing, folder = fresh_path(c.spark, "dirty"), fresh_path(c.spark, "semantic")
    for i, dirty in enumerate(rounds):
        stream = _landed(dirty.withColumn("queued_at", F.lit(i)), landing)
        drain.drain(stream, folder).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    bad = drain.failing(c.spark, folder).select("product_id", F.col("attempts").cast("long").alias("attempts"))
    return drain.current(c.spark, folder).join(bad, "product_id", "left").select("product_id", "text_hash", "batch", F.coalesce("attempts", F.lit(0).cast("long")).alias("attempts"))


@query(oracle(
    """SELECT store_id, event, price, last_seen_at, 1 AS changes FROM (SELECT store_id, arg_max(price, epoch(source_ts) * 1e8 + arrival) AS price, max(source_ts) AS last_seen_at FROM price_point GROUP BY 1)
        JOIN (SELECT 'listed' AS event UNION ALL SELECT 'delisted') e ON event = 'listed' OR last_seen_at + INTERVAL 10 DAY <= (SELECT max(source_ts) - INTERVAL 1 DAY FROM price_point)""",
    "price_point",
))
def st1_st4_store_feeds(c: Catalogue):
    """Each store's feed as state: its price by its newest time whatever the order of arrival, and stores that fell silent for ten days delisted by a timer."""
    rows = c.price_point.select(F.col("chain_id").alias("listing_id"), "store_id", "price", F.col("source_ts").cast("timestamp").alias("source_ts"), F.col("source_ts").cast("timestamp").alias("seen_at"), "arrival")
    landing, folder = fresh_path(c.spark, "observed"), fresh_path(c.spark, "feeds")
    events = expiry.shelf_prices(_landed(rows, landing), 10)

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/events/batch={number}")

    def run() -> None:
        events.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()

    _with_rocks(c.spark, run)
    return c.spark.read.schema(f"{expiry.OUT}, batch long").parquet(f"{folder}/events").select("store_id", "event", "price", "last_seen_at", F.col("changes").cast("long").alias("changes"))
