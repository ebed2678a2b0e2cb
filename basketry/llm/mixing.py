"""Mixing sources to target weights by systematic sampling.

A source's target is its share of the wanted total; a document's expected copies are target / source size, the
same for every document of a source. Documents stand in a fixed order, the expected copies are summed along it from
one random offset per source, and a document is taken once for each integer that the running sum passes at it.
The order goes by size, so that any stretch of the line has about the mean size and the taken words come near the target.

The line of a source is cut into buckets (size class, hash of doc_id and of what `tie` gives, so rows without ids are spread by their texts). Counts per bucket are summed before the
shuffle and give each bucket's place, so even a source with a third of all rows is numbered by many tasks.

Defined results: null text has size 0; null source is a source of its own and comes last; a source whose size is 0 has
target 0 and takes nothing; repeated rows each have their own place; empty input gives empty output; other
columns, also ones that clash with ours, pass through `mix` unchanged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

WEIGHTS = (1, 2, 3)
MOST_COPIES = 3
SALTS = 64
SEED = "mix-1"


def _hash32(text: Column) -> Column:
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """(source, source_size) to (source, source_size, target): shares by weight, none above most times its size.

    A source is at its limit exactly if limit / weight lies below the level that the others share, so one pass over
    the sources in the order of that ratio finds the level: that of the first source at or above it. One row per source, so one task is enough here.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    place = (F.row_number().over(by_name) - 1) % len(weights)
    rows = sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (place + 1).cast("int")).cast("long"))
    rows = rows.withColumn("limit", F.col("source_size") * most)
    ratio = F.col("limit").cast("double") / F.col("weight")
    up = Window.orderBy(ratio.asc(), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    every = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = (
        rows.withColumn("ratio", ratio)
        .withColumn("left_words", F.sum("source_size").over(every) - (F.sum("limit").over(up) - F.col("limit")))
        .withColumn("left_weight", F.sum("weight").over(every) - (F.sum("weight").over(up) - F.col("weight")))
        .withColumn("level", F.col("left_words").cast("double") / F.col("left_weight"))
        .withColumn("nth", F.row_number().over(Window.orderBy(ratio.asc(), F.col("source").asc_nulls_last())))
        .withColumn("shared", F.min(F.when(F.col("ratio") >= F.col("level"), F.struct("nth", "level"))).over(every)["level"])
    )
    target = F.when(F.col("shared").isNull() | (F.col("ratio") < F.col("shared")), F.col("limit").cast("double")).otherwise(F.col("weight") * F.col("shared"))
    return rows.select("source", "source_size", target.alias("target"))


def plan(docs: DataFrame, size: Column, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_COPIES, salts: int = SALTS, seed: str = SEED, tie: Column | None = None) -> tuple[DataFrame, dict[str, str]]:
    """docs with size, source_size, target and copies added, under the names that the second value gives."""
    names = dict(zip(("size", "source_size", "target", "copies"), common.scratch(docs, "size", "source_size", "target", "copies")))
    key, cls, salt, digest, order = common.scratch(docs, "mix_key", "mix_class", "mix_salt", "mix_hash", "mix_tie")
    n, ids = F.col(names["size"]), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    rows = (
        docs.withColumn(names["size"], size.cast("long"))
        .withColumn(key, F.struct(F.col("source").alias("source")))
        .withColumn(cls, F.floor(F.sqrt(n.cast("double"))).cast("long"))
        .withColumn(order, F.lit(0) if tie is None else tie)
        .withColumn(digest, _hash32(F.concat_ws(":", ids, F.col(order).cast("string"))))
        .withColumn(salt, F.col(digest) % salts)
    )
    counts = rows.groupBy(F.col(key).alias("key"), F.col(cls).alias("cls"), F.col(salt).alias("salt")).agg(F.count(F.lit(1)).alias("n"), F.sum(n).alias("size"))
    counts = common.cut(counts)  # of buckets, so the rows are counted once
    sizes = counts.groupBy("key").agg(F.sum("size").alias("source_size")).select(F.col("key.source").alias("source"), "source_size")
    targets = source_targets(sizes, weights, most).select(F.struct("source").alias("key"), "source_size", "target")
    along = Window.partitionBy("key").orderBy("cls", "salt").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    starts = counts.withColumn("before", F.sum("n").over(along) - F.col("n")).join(targets, "key")
    starts = starts.select(F.struct("key", "cls", "salt").alias("bucket"), "before", F.col("source_size").alias("s"), F.col("target").alias("t"))
    bucket, start = common.scratch(rows, "mix_bucket", "mix_start")
    rows = rows.withColumn(bucket, F.struct(F.col(key).alias("key"), F.col(cls).alias("cls"), F.col(salt).alias("salt")))
    inside = Window.partitionBy(bucket).orderBy(n, F.col(digest), F.col("doc_id"), F.col(order))
    rows = rows.withColumn(start, F.row_number().over(inside).cast("long"))
    rows = rows.join(starts, rows[bucket] == starts["bucket"])
    rate = F.when(F.col("s") > 0, F.col("t") / F.col("s")).otherwise(F.lit(0.0))
    offset = _hash32(F.concat(F.lit(seed + ":"), F.coalesce(F.col(key).getField("source"), F.lit("\x00")))) / F.lit(4294967296.0)
    place = F.col("before") + F.col(start)
    copies = F.floor(place * rate + offset) - F.floor((place - 1) * rate + offset)
    return rows.select(*(rows[c] for c in docs.columns), n, F.col("s").alias(names["source_size"]), F.col("t").alias(names["target"]), copies.cast("long").alias(names["copies"])), names


def word_count(text: Column | str) -> Column:
    return F.regexp_count(common.text_or_empty(text), F.lit(common.WORD)).cast("long")


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mixed corpus: each row of docs as many times as it is taken, with the columns of docs."""
    rows, names = plan(docs, word_count("text"), tie=F.xxhash64("text"), **options)
    copy = common.scratch(rows, "mix_copy")[0]
    taken = rows.withColumn(copy, F.explode(F.array_repeat(F.lit(1), F.col(names["copies"]).cast("int"))))
    return taken.select(*docs.columns)
