"""The semantic index kept up to date by a stream of dirty products.

Each micro-batch takes the newest row of each product, leaves out those whose text hash is the index's already, embeds the others and writes them as one version: a folder of
the index that carries the batch's number and is overwritten as a whole. A batch that is run again, after a crash between its write and its commit, so gives the same
folder, and later batches read the versions before them only. Rows that can't be embedded go to the errors, with how often the product has failed since its last
success; after MOST_ATTEMPTS it is given up until its text is another.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from basketry.functions import text as tx
from basketry.functions import vectors

INDEX = "product_id long, text_hash string, vector array<double>"
ERRORS = "product_id long, text_hash string, attempts int, error string, given_up boolean"
MOST_ATTEMPTS = 3
#: Characters of the hash that are kept.
HASHED = 32


def product_text() -> Column:
    """What a product is embedded by; null where it has no name."""
    return F.when(F.trim("name") != "", F.concat_ws(" ", "name", "brand", "category"))


def text_hash(text: Column) -> Column:
    return F.left(F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256), F.lit(HASHED))


def versions(spark: SparkSession, folder: str, table: str, schema: str, before: int | None = None) -> DataFrame:
    """All versions of a table (index or errors) with their batch, up to a batch."""
    spark.createDataFrame([], schema).coalesce(1).write.mode("ignore").parquet(f"{folder}/{table}/batch=-1")  # so there always is something to read
    rows = spark.read.schema(f"{schema}, batch long").parquet(f"{folder}/{table}")
    return rows if before is None else rows.where(F.col("batch") < before)


def current(spark: SparkSession, folder: str, before: int | None = None) -> DataFrame:
    """(product_id, text_hash, vector, batch): the newest version of each product."""
    rows = versions(spark, folder, "index", INDEX, before)
    newest = F.max_by(F.struct("text_hash", "vector", "batch"), "batch").alias("v")
    return rows.groupBy("product_id").agg(newest).select("product_id", "v.*")


def failing(spark: SparkSession, folder: str, before: int | None = None) -> DataFrame:
    """(product_id, failed_hash, attempts, given_up, failed_batch): the newest error of each product."""
    rows = versions(spark, folder, "errors", ERRORS, before)
    newest = F.max_by(F.struct(F.col("text_hash").alias("failed_hash"), "attempts", "given_up", F.col("batch").alias("failed_batch")), "batch").alias("e")
    return rows.groupBy("product_id").agg(newest).select("product_id", "e.*")


def drained(spark: SparkSession, rows: DataFrame, folder: str, batch: int, embed: Callable[[Column], Column]) -> tuple[DataFrame, DataFrame]:
    """(new index rows, new error rows) of one batch of dirty rows (product_id, name, brand, category, queued_at)."""
    newest = F.max_by(F.struct("name", "brand", "category"), "queued_at").alias("p")
    rows = rows.groupBy("product_id").agg(newest).select("product_id", "p.*").withColumn("text", product_text())
    rows = rows.withColumn("text_hash", text_hash(F.col("text")))
    known = current(spark, folder, batch).select("product_id", F.col("text_hash").alias("known_hash"), F.col("batch").alias("known_batch"))
    rows = rows.join(known, "product_id", "left").where(~F.col("text_hash").eqNullSafe(F.col("known_hash")))
    rows = rows.join(failing(spark, folder, batch), "product_id", "left")
    same = F.coalesce((F.col("failed_hash") == F.col("text_hash")) & (F.coalesce("known_batch", F.lit(-1)) < F.col("failed_batch")), F.lit(False))
    rows = rows.withColumn("before", F.when(same, F.col("attempts")).otherwise(0)).where(~(same & F.coalesce("given_up", F.lit(False))))
    good = rows.where(F.col("text").isNotNull()).select("product_id", "text_hash", embed(tx.embed_input(F.col("text"))).alias("vector"))
    attempts = (F.col("before") + 1).cast("int")
    bad = rows.where(F.col("text").isNull()).select("product_id", "text_hash", attempts.alias("attempts"), F.lit("no text").alias("error"), (attempts >= MOST_ATTEMPTS).alias("given_up"))
    return good, bad


def drain(dirty: DataFrame, folder: str, embed: Callable[[Column], Column] = vectors.hashed_embedding) -> DataStreamWriter:
    """The writer of a stream of dirty rows (product_id, name, brand, category, queued_at) into an index folder; start it with a checkpointLocation."""

    def one(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        good, bad = drained(spark, batch, folder, number, embed)
        good.write.mode("overwrite").parquet(f"{folder}/index/batch={number}")
        bad.write.mode("overwrite").parquet(f"{folder}/errors/batch={number}")

    return dirty.writeStream.outputMode("update").foreachBatch(one)
