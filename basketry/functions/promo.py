"""Promotions: what a feed's fields mean, and what a line costs under one."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Below this share of what its own rate implies, an absolute price isn't believed.
TRUST = 0.7

# The wordings that mark a mechanic, in Hebrew and English.
COUPON = "(?i)קופון|coupon"
CLUB_WORD = "(?i)מועדון|club"
CLUB_PRICE = "(?i)מחיר מועדון|club"
N_FOR = r"(?i)(\d+)\s*(?:ב[-–]?\s*|for\s+)(\d+(?:\.\d+)?)"
ONE_PLUS_ONE = r"(?i)1\s*\+\s*1"
FREE = "(?i)בחינם|free"
SECOND_FREE = r"השני(?:יה)?\s*בחינם"
SECOND_HE = r"השני(?:יה)?\s*ב-?\s*(\d+)\s*%"
SECOND_EN = r"(?i)second\s*(?:unit\s*)?(\d+)\s*%"
SPEND = r"(?i)בקנייה מ|spend|מעל\s*\d+"


def requires_coupon(description: Column) -> Column:
    return F.coalesce(description.rlike(COUPON), F.lit(False))


def _group(text: Column, pattern: str, group: int) -> Column:
    return F.regexp_extract(text, pattern, group).try_cast("double")


def mechanic(description: Column, min_qty: Column, discount_rate: Column, discounted_price: Column, min_purchase: Column, club_id: Column) -> Column:
    """Feed fields to a struct (kind, n, price, percent, rate, discounted_price, min_qty); the first rule that fits decides."""
    text = F.trim(F.coalesce(description, F.lit("")))
    club = club_id.isNotNull() & ~F.coalesce(club_id, F.lit("")).isin("0", "")
    priced = F.coalesce(discounted_price > 0, F.lit(False))
    is_club = (club | text.rlike(CLUB_WORD)) & (priced | text.rlike(CLUB_PRICE))
    gated = F.coalesce((min_qty >= 2), F.lit(False)) & priced
    bogo = text.rlike(ONE_PLUS_ONE) | text.rlike(FREE)
    second = text.rlike(ONE_PLUS_ONE) | text.rlike(SECOND_FREE) | text.rlike(SECOND_HE) | text.rlike(SECOND_EN)
    spend = F.coalesce(min_purchase > 0, F.lit(False)) | text.rlike(SPEND)
    none = F.lit(None).cast("double")

    def made(kind: str, n: Column = none, price: Column = none, percent: Column = none, rate: Column = none, absolute: Column = none, least: Column = none) -> Column:
        return F.struct(
            F.lit(kind).alias("kind"), n.alias("n"), price.alias("price"), percent.alias("percent"), rate.alias("rate"), absolute.alias("discounted_price"), least.alias("min_qty")
        )

    n = _group(text, N_FOR, 1)
    share = F.when(bogo, 100.0).otherwise(F.coalesce(_group(text, SECOND_HE, 1), _group(text, SECOND_EN, 1), F.lit(50.0)))
    return (
        F.when(is_club, made("club_price", price=discounted_price))
        .when(text.rlike(N_FOR), made("n_for_price", n=n, price=_group(text, N_FOR, 2), least=F.coalesce(min_qty, n)))
        .when(gated, made("simple_discount", absolute=discounted_price, least=min_qty))
        .when(second, made("second_unit_pct", percent=share))
        .when(spend, made("spend_threshold", rate=discount_rate))
        .when(F.coalesce(discount_rate > 0, F.lit(False)), made("simple_discount", rate=discount_rate, absolute=discounted_price))
        .when(priced, made("simple_discount", absolute=discounted_price))
        .otherwise(made("other", rate=discount_rate, least=min_qty))
    )


def line_total(list_price: Column, qty: Column, kind: Column, n: Column, price: Column, percent: Column, rate: Column, absolute: Column, min_qty: Column) -> Column:
    """What qty units cost under a promotion; where it doesn't apply, the list price."""
    full = list_price * qty
    factor = F.when(rate > 1, F.lit(1.0) - rate / 100).when(rate > 0, F.lit(1.0) - rate)
    factor = F.when((factor > 0) & (factor < 1), factor)
    far_off = F.coalesce(absolute < list_price * factor * TRUST, F.lit(False))
    gated = F.coalesce((min_qty >= 2) & (qty < min_qty), F.lit(False))
    simple = F.when((absolute > 0) & ~far_off, F.when(gated, full).otherwise(absolute * qty)).when(factor.isNotNull(), full * factor).otherwise(full)
    size = F.coalesce(n, min_qty)
    packs = F.floor(qty / size)
    pairs = F.floor(qty / 2)
    return (
        F.when(kind == "simple_discount", simple)
        .when((kind == "n_for_price") & (size > 0) & (price > 0), packs * price + (qty - packs * size) * list_price)
        .when((kind == "second_unit_pct") & (percent > 0) & (percent <= 100), pairs * (list_price + list_price * (F.lit(1.0) - percent / 100)) + (qty - pairs * 2) * list_price)
        .when((kind == "club_price") & (price > 0), price * qty)
        .otherwise(full)
    )


# The same as SQL over columns list_price, qty and those of the promotion view.
_FACTOR = "CASE WHEN (CASE WHEN rate > 1 THEN 1e0 - rate / 100 WHEN rate > 0 THEN 1e0 - rate END) > 0 AND (CASE WHEN rate > 1 THEN 1e0 - rate / 100 WHEN rate > 0 THEN 1e0 - rate END) < 1 THEN (CASE WHEN rate > 1 THEN 1e0 - rate / 100 WHEN rate > 0 THEN 1e0 - rate END) END"
LINE_TOTAL_SQL = f"""CASE
  WHEN kind = 'simple_discount' THEN CASE
    WHEN discounted_price > 0 AND NOT coalesce(discounted_price < list_price * ({_FACTOR}) * 0.7e0, FALSE)
      THEN CASE WHEN coalesce(min_qty >= 2 AND qty < min_qty, FALSE) THEN list_price * qty ELSE discounted_price * qty END
    WHEN ({_FACTOR}) IS NOT NULL THEN list_price * qty * ({_FACTOR}) ELSE list_price * qty END
  WHEN kind = 'n_for_price' AND coalesce(n, min_qty) > 0 AND promo_price > 0
    THEN floor(qty / coalesce(n, min_qty)) * promo_price + (qty - floor(qty / coalesce(n, min_qty)) * coalesce(n, min_qty)) * list_price
  WHEN kind = 'second_unit_pct' AND percent > 0 AND percent <= 100
    THEN floor(qty / 2) * (list_price + list_price * (1e0 - percent / 100)) + (qty - floor(qty / 2) * 2) * list_price
  WHEN kind = 'club_price' AND promo_price > 0 THEN promo_price * qty
  ELSE list_price * qty END"""
