"""What products may stand for each other and for a query: classes, equivalents, upgrades, intents, risks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketry.functions import text as tx
from basketry.operators.windows import first_per

def class_relation(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    """How far two class paths agree: same, same_l2, same_l1, different; unknown if either has none. A missing class is never a conflict."""
    return (
        F.when(a[0].isNull() | b[0].isNull(), "unknown")
        .when(a[0] != b[0], "different")
        .when((a[1] != b[1]) | a[1].isNull() | b[1].isNull(), "same_l1")
        .when((a[2] != b[2]) | a[2].isNull() | b[2].isNull(), "same_l2")
        .otherwise("same")
    )


def dominant_class(members: DataFrame, keys: list[str], cls: str, share: float = 0.7) -> DataFrame:
    """Per key the most frequent class (ties by name), null where it has less than `share` of the members."""
    counts = members.where(F.col(cls).isNotNull()).groupBy(*keys, cls).agg(F.count(F.lit(1)).alias("n"))
    whole = counts.groupBy(*keys).agg(F.sum("n").alias("total"))
    top = first_per(counts, keys, [F.desc("n"), F.col(cls)])
    rows = top.join(whole, keys)
    return rows.select(*keys, F.when(F.col("n") >= F.col("total") * share, F.col(cls)).alias("dominant"), "n", "total")


def similar_sets(sets: DataFrame, keys: list[str], least: float) -> DataFrame:
    """(keys, id, other, similarity): pairs of distinct ids of sets (keys, id, words) under the same keys whose Dice similarity is `least` or more, each pair once, id < other.

    Prefix filtering: words are put in order from the rarest (under the keys) on. Two sets that similar share ceil(least / (2 - least) * size) words of the one at least, so
    they share one among the first size - that + 1 of each: only these words are joined, not the frequent ones, and only sets whose sizes allow the similarity. A pair counts at the first
    of its shared leading words, so it is tested once.
    """
    each = sets.select(*keys, "id", F.explode(F.array_distinct("words")).alias("word"))
    counts = each.groupBy(*keys, "word").agg(F.count(F.lit(1)).alias("n"))
    ordered = each.join(counts, [*keys, "word"]).groupBy(*keys, "id").agg(F.transform(F.sort_array(F.collect_list(F.struct("n", "word"))), lambda x: x["word"]).alias("w"))
    size, share = F.size("w"), least / (2 - least)
    lead = F.slice("w", F.lit(1), (size - F.ceil(size * share - 1e-9) + 1).cast("int"))
    rows = ordered.select(*keys, "id", "w", lead.alias("lead")).select("*", F.explode("lead").alias("word"))
    other = rows.select(*keys, "word", F.col("id").alias("other"), F.col("w").alias("other_w"), F.col("lead").alias("other_lead"))
    sizes = F.least(F.size("w"), F.size("other_w")) >= F.greatest(F.size("w"), F.size("other_w")) * share - 1e-9
    pairs = rows.join(other, [*keys, "word"]).where((F.col("id") < F.col("other")) & sizes & (F.col("word") == F.get(F.array_intersect("lead", "other_lead"), F.lit(0))))
    dice = F.size(F.array_intersect("w", "other_w")) * 2 / (F.size("w") + F.size("other_w"))
    return pairs.select(*keys, "id", "other", dice.alias("similarity")).where(F.col("similarity") >= least)


def equivalents(products: DataFrame, class_key: str = "category", least: float = 0.5, limit: int = 5, text: str = "name") -> DataFrame:
    """(product_id, place, other_id, similarity): products of the same class and unit whose texts share enough words, best first.

    Distinct texts stand for their products; similar ones are found by `similar_sets`, and only each text's first few products are paired.
    """
    keys = [class_key, "size_unit"]
    texts = products.select(*keys, F.col(text).alias("id")).distinct()
    close = similar_sets(texts.withColumn("words", tx.tokens(F.col("id"))), keys, least)
    turned = close.select(*keys, F.col("other").alias("id"), F.col("id").alias("other"), "similarity")
    own = texts.where(F.size(tx.tokens(F.col("id"))) > 0).select(*keys, "id", F.col("id").alias("other"), F.lit(1.0).alias("similarity"))
    both = close.unionByName(turned).unionByName(own)
    # One small file is one task: its rows are dealt out before they are put in order.
    dealt = products.select("product_id", *keys, F.col(text).alias("id")).repartition("product_id")
    top = first_per(dealt.select(*keys, F.col("id").alias("other"), F.col("product_id").alias("other_id")), [*keys, "other"], [F.col("other_id")], limit + 1)
    # A text's best are found once: one more than asked for, as a product isn't its own equivalent.
    best = first_per(both.join(top, [*keys, "other"]), [*keys, "id"], [F.desc("similarity"), F.col("other_id")], limit + 1, "at")
    listed = best.groupBy(*keys, "id").agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "other_id", "similarity"))), lambda x: F.struct(x["other_id"].alias("other_id"), x["similarity"].alias("similarity"))).alias("best"))
    others = F.slice(F.filter("best", lambda x: x["other_id"] != F.col("product_id")), 1, limit)
    rows = dealt.join(listed, [*keys, "id"]).select("product_id", F.posexplode(others).alias("n", "o"))
    return rows.select("product_id", (F.col("n") + 1).cast("long").alias("place"), "o.other_id", "o.similarity")


def upgraded_primary(candidates: DataFrame, keys: list[str], stores: int = 3, times: float = 3.0) -> DataFrame:
    """Per key the first candidate, or the one that most stores have if it is in at least `stores` of them and `times` as many as the first."""
    first = F.min_by(F.struct("product_id", "store_count"), "rank").alias("first")
    best = F.max_by(F.struct("product_id", "store_count"), F.struct(F.col("store_count"), -F.col("rank"))).alias("best")
    rows = candidates.groupBy(*keys).agg(first, best)
    moved = (F.col("best.store_count") >= stores) & (F.col("best.store_count") >= F.col("first.store_count") * times)
    return rows.select(*keys, F.when(moved, F.col("best.product_id")).otherwise(F.col("first.product_id")).alias("product_id"), F.coalesce(moved, F.lit(False)).alias("upgraded"))


def intent_mode(query: Column, brand_named: Column, pack_named: Column) -> Column:
    """exact for a code or a brand with a pack, brand_family for a brand, commodity otherwise."""
    return F.when(query.rlike(r"^\s*[0-9]{8,14}\s*$") | (brand_named & pack_named), "exact").when(brand_named, "brand_family").otherwise("commodity")


def line_risk(options: DataFrame, keys: list[str]) -> DataFrame:
    """Per line: opaque without options, cross_class with several classes, brand_pinned with one brand, else commodity."""
    rows = options.groupBy(*keys).agg(F.count("product_id").alias("n"), F.count_distinct("category").alias("classes"), F.count_distinct("brand").alias("brands"))
    risk = F.when(F.col("n") == 0, "opaque").when(F.col("classes") > 1, "cross_class").when(F.col("brands") == 1, "brand_pinned").otherwise("commodity")
    return rows.select(*keys, "n", risk.alias("risk"))
