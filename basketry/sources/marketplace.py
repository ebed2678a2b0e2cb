"""Marketplace pages: JSON objects that stand in HTML, prices in strings."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FOUND = "page_id long, name string, barcode string, price double"


def objects(text: str, key: str) -> Iterator[dict]:
    """JSON objects of a text that have the key: braces are matched outside strings, from each place the key is named."""
    decoder, at = json.JSONDecoder(), 0
    mark = f'"{key}"'
    while (hit := text.find(mark, at)) >= 0:
        at = hit + len(mark)
        start = text.rfind("{", 0, hit)
        while start >= 0:
            try:
                found, end = decoder.raw_decode(text, start)
            except ValueError:
                start = text.rfind("{", 0, start)
                continue
            if isinstance(found, dict) and key in found and end > hit:
                yield found
                at = max(at, end)
            break


def read_items(pages: DataFrame, key: str = "price") -> DataFrame:
    """(page_id, name, barcode, price): items of the pages, prices in agorot as shekels, one per page and barcode."""

    def items(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for page, html in zip(batch["page_id"], batch["html"]):
                for x in objects(html or "", key):
                    price = x.get(key)
                    if isinstance(price, (int, float)) and x.get("name"):
                        rows.append((page, str(x["name"]), str(x["barcode"]) if x.get("barcode") else None, price / 100))
            yield pd.DataFrame(rows, columns=["page_id", "name", "barcode", "price"])

    rows = pages.select("page_id", "html").mapInPandas(items, FOUND)
    coded = rows.where(F.col("barcode").isNotNull()).groupBy("page_id", "barcode").agg(F.min(F.struct("price", "name")).alias("b")).select("page_id", "b.name", "barcode", "b.price")
    return coded.unionByName(rows.where(F.col("barcode").isNull()))


VENUE = "page_id long, name string, slug string, base_price double, minimum string, ring array<struct<lng:double,lat:double>>"


def _outer_ring(range_: object) -> list[tuple[float, float]]:
    """(lng, lat) of the outer ring of a GeoJSON polygon, or of the first of several."""
    if not isinstance(range_, dict):
        return []
    rings = range_.get("coordinates") or []
    if range_.get("type") == "MultiPolygon":
        rings = rings[0] if rings else []
    return [(float(p[0]), float(p[1])) for p in (rings[0] if rings else []) if isinstance(p, list) and len(p) >= 2]


def read_venues(pages: DataFrame, key: str = "delivery_base_price") -> DataFrame:
    """(page_id, name, slug, base_price, minimum, ring): the venue that a marketplace page is about: the first object with the key. The price is the fee at no distance, in shekels."""

    def venues(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for page, html in zip(batch["page_id"], batch["html"]):
                x = next(objects(html or "", key), None)
                if x is not None:
                    fee, info = x.get(key), x.get("info") or {}
                    rows.append((page, x.get("name"), x.get("slug"), fee / 100 if isinstance(fee, (int, float)) else None, info.get("order_minimum"), _outer_ring(x.get("delivery_geo_range"))))
            yield pd.DataFrame(rows, columns=["page_id", "name", "slug", "base_price", "minimum", "ring"])

    return pages.select("page_id", "html").mapInPandas(venues, VENUE)


def venue_terms(venues: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(stores, tariffs, rules) of venues: an online store each, its fee as a floor for any subtotal, and its polygon as a verified rule (none where it publishes no area)."""
    no = F.lit(None)
    stores = venues.select(F.col("page_id").alias("store_id"), F.coalesce("name", "slug").alias("store_name"), F.lit("online").alias("store_kind"), first_number(F.col("minimum")).alias("minimum_order"))
    tariffs = venues.where("base_price IS NOT NULL").select(F.col("page_id").alias("service_id"), F.lit("standard").alias("slot"), no.cast("double").alias("min_subtotal"), no.cast("double").alias("max_subtotal"), F.col("base_price").alias("fee"), no.cast("string").alias("membership"), F.lit(True).alias("is_floor"))
    rules = venues.where(F.size("ring") > 2).select(F.col("page_id").alias("service_id"), F.lit("polygon").alias("scope"), no.cast("string").alias("city"), *(no.cast("double").alias(c) for c in ("lat", "lng", "radius_km")), "ring", F.lit(2).alias("confidence"))
    return stores, tariffs, rules


def first_number(text: Column) -> Column:
    return F.regexp_extract(F.coalesce(text, F.lit("")), r"(\d+(?:\.\d+)?)", 1).try_cast("double")


def brand_of(label: Column) -> Column:
    """The name before a separator."""
    return F.trim(F.regexp_extract(F.coalesce(label, F.lit("")), r"^([^|\-–:]+)", 1))


def settlements(areas: DataFrame, zones: dict[str, list[str]], dropped: tuple[str, ...] = ()) -> DataFrame:
    """areas (service_id, label) as (service_id, settlement): named zones by their list, some regions not at all, else what commas and slashes part."""
    table = F.create_map(*(y for k, v in sorted(zones.items()) for y in (F.lit(k), F.array(*map(F.lit, v))))) if zones else None
    split = F.filter(F.transform(F.split("label", r"[,/]"), lambda x: F.trim(x)), lambda x: x != "")
    parts = split if table is None else F.coalesce(F.try_element_at(table, F.trim("label")), split)
    return areas.where(~F.trim("label").isin(*dropped) if dropped else F.lit(True)).select("service_id", F.explode(F.array_distinct(parts)).alias("settlement"))
