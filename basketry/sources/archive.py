"""The raw archive of fetched files: each content once, under its hash, and a manifest of what was fetched as what and when."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BLOBS = "hash string, bytes long, content binary"
MANIFEST = "source string, file_name string, day date, hash string, bytes long"


def safe_name(path: Column) -> Column:
    """The last part of a path, null where it isn't a name; parts of folders from outside are never followed."""
    name = F.regexp_extract(F.translate(path, "\\", "/"), r"([^/]*)$", 1)
    return F.when(~name.isin("", ".", ".."), name)


def _table(spark: SparkSession, root: str, name: str, schema: str, landing: str) -> DataFrame:
    """What the other landings hold."""
    spark.createDataFrame([], schema).coalesce(1).write.mode("ignore").parquet(f"{root}/{name}/landing=none")
    return spark.read.schema(f"{schema}, landing string").parquet(f"{root}/{name}").where(F.col("landing") != landing)


def land(files: DataFrame, root: str, landing: str) -> None:
    """Add files (source, path, day, content) to the archive under root as one landing.

    A content that some landing has already isn't written again, nor is the manifest's row of a file that is there with the same name, day and content. The same landing run
    again replaces what it wrote. Files without a safe name are refused: they raise an error before anything is written.
    """
    spark = files.sparkSession
    rows = files.select("source", "path", safe_name(F.col("path")).alias("file_name"), "day", F.sha2("content", 256).alias("hash"), F.octet_length("content").cast("long").alias("bytes"), "content")
    bad = rows.where("file_name IS NULL").select("path").first()
    if bad is not None:
        raise ValueError(f"not a file name: {bad['path']!r}")
    known = _table(spark, root, "blobs", BLOBS, landing).select("hash")
    kept = [F.first(c).alias(c) for c in ("bytes", "content")]
    rows.groupBy("hash").agg(*kept).join(known, "hash", "left_anti").select("hash", "bytes", "content").write.mode("overwrite").parquet(f"{root}/blobs/landing={landing}")
    keys = ["source", "file_name", "day", "hash"]
    before = _table(spark, root, "manifest", MANIFEST, landing).select(*keys)
    rows.select(*keys, "bytes").distinct().join(before, keys, "left_anti").write.mode("overwrite").parquet(f"{root}/manifest/landing={landing}")


def blobs(spark: SparkSession, root: str) -> DataFrame:
    return _table(spark, root, "blobs", BLOBS, "none")


def manifest(spark: SparkSession, root: str) -> DataFrame:
    return _table(spark, root, "manifest", MANIFEST, "none")


def contents(spark: SparkSession, root: str) -> DataFrame:
    """The manifest with the contents."""
    return manifest(spark, root).join(blobs(spark, root).select("hash", "content"), "hash")
