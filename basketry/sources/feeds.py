"""Retail feeds: XML files of stores, prices and promotions, as DataFrames of plain records.

Spark reads the XML itself, one row per element, with a schema of strings, so leading zeros stay; numbers are parsed after. What a file's
header says (chain and store) is in its name too, and joins by the file; one row a file grows with the feed, so Spark decides by its size how to join it.
"""

from __future__ import annotations

import gzip
import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from basketry.functions import promo, units
from basketry.functions import text as tx
from basketry.functions.dates import il_time, promo_window
from basketry.functions.money import unit_price
from basketry.sources.storage import fresh_path

ITEM = ("ItemCode", "ItemType", "ItemName", "ManufacturerName", "Quantity", "UnitQty", "ItemPrice", "AllowDiscount", "bIsWeighted", "PriceUpdateDate")
STORE = ("StoreId", "StoreName", "Address", "City", "ZipCode", "Latitude", "Longitude", "StoreType")
PROMOTION = ("PromotionId", "PromotionDescription", "PromotionStartDate", "PromotionStartHour", "PromotionEndDate", "PromotionEndHour", "MinQty", "MaxQty", "DiscountRate", "DiscountType", "MinPurchaseAmnt", "DiscountedPrice", "RewardType", "ClubId")
#: A feed is written in files of so many elements at most: the XML reader takes a file in one task, and for its header the root as one row.
FILE_ROWS = 50_000
#: A store's number has fewer digits than a date.
FILE_NAME = r"([^/]*?)(\d{7,13})-(\d{1,7})-(\d{8})-?(\d{4,6})?[^/]*$"


def _strings(names: tuple[str, ...], *more: T.StructField) -> T.StructType:
    return T.StructType([*(T.StructField(n, T.StringType()) for n in names), *more])


def file_facts(name: Column) -> list[Column]:
    """kind, chain, store and stamp that a feed's file name tells."""
    low = F.lower(name)
    kind = (
        F.when(F.contains(low, F.lit("pricefull")), "pricefull").when(F.contains(low, F.lit("promofull")), "promofull").when(F.contains(low, F.lit("stores")), "stores")
        .when(F.contains(low, F.lit("price")), "price").when(F.contains(low, F.lit("promo")), "promo")
    )
    part = lambda i: F.nullif(F.regexp_extract(name, FILE_NAME, i), F.lit(""))
    return [kind.alias("kind"), part(2).alias("chain_code"), tx.store_code(part(3)).alias("store_code"), F.concat_ws("", part(4), part(5)).alias("stamp")]


def _read(spark: SparkSession, path: str, tag: str, schema: T.StructType) -> DataFrame:
    rows = spark.read.format("xml").option("rowTag", tag).option("mode", "PERMISSIVE").schema(schema).load(path)
    return rows.withColumn("file", F.col("_metadata.file_path"))


def header(spark: SparkSession, path: str, root: str = "Root") -> DataFrame:
    """(file, chain_code, store_code) of each file's header."""
    rows = _read(spark, path, root, _strings(("ChainId", "StoreId")))
    return rows.groupBy("file").agg(F.max("ChainId").alias("chain_code"), F.max(tx.store_code(F.col("StoreId"))).alias("store_code"))


def read_prices(spark: SparkSession, path: str, root: str = "Root") -> DataFrame:
    """One row per priced item; rows without a code or a price go. Identity is the barcode where it is one."""
    return priced(_read(spark, path, "Item", _strings(ITEM)).join(header(spark, path, root), "file", "left"))


def priced(rows: DataFrame) -> DataFrame:
    """The same of raw elements (file, chain_code, store_code and the fields of ITEM)."""
    price, weighted = F.col("price"), F.col("bIsWeighted") == "1"
    code, kind = F.trim("ItemCode"), F.col("ItemType").try_cast("int")
    # Numbers and sizes are made by generators, once a row: as plain columns they would be put into each expression that names them, and be worked out anew for each.
    rows = rows.select("*", F.inline(F.array(F.struct(tx.number(F.col("ItemPrice")).alias("price"), tx.number(F.col("Quantity")).alias("asked"))))).where("price IS NOT NULL")
    rows = rows.select("*", F.explode(F.array(units.measure(F.col("asked"), F.col("UnitQty"), weighted))).alias("m"))
    rows = rows.select(
        "file", "chain_code", "store_code", tx.item_code(kind, code).alias("item_code"), tx.is_gtin(kind, code).alias("is_gtin"), tx.scrubbed(F.col("ItemName")).alias("name"), tx.scrubbed(F.col("ManufacturerName")).alias("brand"),
        price.alias("price"), F.col("m.qty").alias("size_qty"), F.col("m.unit").alias("size_unit"), F.col("m.unparseable").alias("measure_unparseable"), weighted.alias("is_weighted"), (F.col("AllowDiscount") == "1").alias("allow_discount"),
        F.when(~F.col("m.unparseable"), unit_price(price, F.col("m.qty"), F.col("m.unit"))).alias("unit_price"), il_time(F.col("PriceUpdateDate")).alias("source_ts"), units.pack_count(F.col("ItemName")).alias("piece_count"),
    )
    return rows.where(F.col("item_code") != "")


def read_stores(spark: SparkSession, path: str, root: str = "Root") -> DataFrame:
    """One row per store; stores nest in several ways, but each is one element."""
    return placed(_read(spark, path, "Store", _strings(STORE)).join(header(spark, path, root).drop("store_code"), "file", "left"))


def placed(rows: DataFrame) -> DataFrame:
    """The same of raw elements (file, chain_code and the fields of STORE)."""
    city = F.trim("City")
    return rows.where(F.col("StoreId").isNotNull()).select(
        "file", "chain_code", tx.store_code(F.col("StoreId")).alias("store_code"), tx.scrubbed(F.col("StoreName")).alias("store_name"), tx.scrubbed(F.col("Address")).alias("address"), F.when(~city.isin("", "0"), city).alias("city"),
        tx.number(F.col("Latitude")).alias("lat"), tx.number(F.col("Longitude")).alias("lng"), tx.store_kind(F.col("StoreType").try_cast("int"), F.col("StoreName"), F.col("Address")).alias("store_kind"),
    )


_ITEMS = T.StructType([T.StructField("Item", T.ArrayType(_strings(("ItemCode",))))])
_GROUPS = T.StructType([T.StructField("Group", T.ArrayType(T.StructType([T.StructField("PromotionItems", T.StructType([T.StructField("PromotionItem", T.ArrayType(_strings(("ItemCode",))))]))])))])


def read_promotions(spark: SparkSession, path: str, root: str = "Root") -> DataFrame:
    """One row per promotion with its item codes, wherever they nest, and its mechanic."""
    schema = _strings(PROMOTION, T.StructField("ItemCode", T.ArrayType(T.StringType())), T.StructField("PromotionItems", _ITEMS), T.StructField("Groups", _GROUPS))
    rows = _read(spark, path, "Promotion", schema).join(header(spark, path, root), "file", "left")
    nested = F.flatten(F.transform("Groups.Group", lambda g: F.transform(g["PromotionItems"]["PromotionItem"], lambda i: i["ItemCode"])))
    none = F.array().cast("array<string>")
    codes = F.concat(F.coalesce("ItemCode", none), F.coalesce(F.transform("PromotionItems.Item", lambda i: i["ItemCode"]), none), F.coalesce(nested, none))
    return promoted(rows.withColumn("codes", codes))


def promoted(rows: DataFrame) -> DataFrame:
    """The same of raw elements (file, chain_code, store_code, codes and the fields of PROMOTION)."""
    codes = F.array_sort(F.array_distinct(F.filter(F.transform("codes", lambda c: F.trim(c)), lambda c: (c != "") & ~c.rlike("^0+$"))))
    start, end = promo_window(il_time(F.col("PromotionStartDate"), F.col("PromotionStartHour")), il_time(F.col("PromotionEndDate"), F.col("PromotionEndHour")))
    n = lambda c: tx.number(F.col(c))
    return rows.select(
        "file", "chain_code", "store_code", F.trim("PromotionId").alias("promo_code"), tx.scrubbed(F.col("PromotionDescription")).alias("description"), codes.alias("item_codes"), start.alias("start_ts"), end.alias("end_ts"),
        promo.mechanic(F.col("PromotionDescription"), n("MinQty"), n("DiscountRate"), n("DiscountedPrice"), n("MinPurchaseAmnt"), F.col("ClubId")).alias("mechanic"), promo.requires_coupon(F.col("PromotionDescription")).alias("coupon"),
    )


def decoded(content: bytes) -> str:
    """The text of a feed file: gzip or the first file of a zip or plain; UTF-16 with a mark, else UTF-8, else Windows Hebrew."""
    if content[:2] == b"\x1f\x8b":
        content = gzip.decompress(content)
    elif content[:2] == b"PK":
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            content = z.read(z.namelist()[0])
    if content[:2] in (b"\xff\xfe", b"\xfe\xff"):
        return content.decode("utf-16")
    try:
        return content.decode("utf-8-sig")
    except UnicodeDecodeError:
        return content.decode("windows-1255", "replace")


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, text) of landed feed files of any packing."""

    def texts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for p, c in zip(batch["path"], batch["content"]):
                yield pd.DataFrame({"path": [p], "text": [decoded(c)]})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(texts, "path string, text string")


def unpacked(spark: SparkSession, path: str, out: str) -> str:
    """Packed files written as text that the XML reader takes, one file each."""
    read_files(spark, path).select("text").write.option("maxRecordsPerFile", 1).text(out)
    return out


def chosen_files(files: DataFrame, kinds: tuple[str, ...], cap: int, store: tuple[str, ...] = ("chain_code", "store_code")) -> DataFrame:
    """The newest file of each kind and store, for up to `cap` store codes a chain. `store` tells stores apart, where codes cut to a fixed width don't."""
    from pyspark.sql import Window

    newest = F.row_number().over(Window.partitionBy("kind", *store).orderBy(F.desc("stamp"), "path"))
    rows = files.where(F.col("kind").isin(*kinds)).withColumn("nth", newest).where("nth = 1").drop("nth")
    place = F.dense_rank().over(Window.partitionBy("chain_code").orderBy("store_code"))
    return rows.withColumn("place", place).where(F.col("place") <= cap).drop("place")


def landed(df: DataFrame, tag: str) -> str:
    """The path of df written as feed files, one element a row, in a new folder that all executors see (spark.checkpoint.dir; on one machine a folder of its own)."""
    path = fresh_path(df.sparkSession, "feeds")
    df.write.format("xml").option("rootTag", "Root").option("rowTag", tag).option("maxRecordsPerFile", FILE_ROWS).save(path)
    return f"{path}/part-*"
