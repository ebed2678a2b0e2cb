"""Money: rounding to two places, unit prices, fees."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def agorot(x: Column) -> Column:
    """x rounded half up to two places, by the same steps in any engine."""
    return F.floor(x * 100 + 0.5) / 100


def unit_price(price: Column, qty: Column, unit: Column) -> Column:
    """Price per piece, or per 100 g or ml; null without a positive price and quantity."""
    usable = (price > 0) & (qty > 0)
    return F.when(usable & (unit == "unit"), price / qty).when(usable & unit.isin("g", "ml"), price / qty * 100)


def service_fee(percent: Column, lowest: Column, highest: Column, subtotal: Column) -> Column:
    """A share of the subtotal within bounds; no rule, no fee."""
    return F.when(percent.isNull(), 0.0).otherwise(agorot(F.least(highest, F.greatest(lowest, subtotal * percent / 100))))
