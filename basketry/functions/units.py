"""Quantities: units and their factors, pack sizes, what to buy."""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F

# Surface forms of units with their canonical unit and factor.
GRAMS = "g גרם גרמים ג' ג גר גר' gram grams".split()
KILOS = "kg קג ק\"ג קילו קילוגרם קילוגרמים ק'ג".split()
MILLILITRES = "ml מל מ\"ל מ'ל מיליליטר מיליליטרים".split()
LITRES = "l ליטר ליטרים lit liter litre".split()
PIECES = "unit יחידה יחידות פריט יח יח' units pcs".split()
FORMS = {x: (unit, factor) for group, unit, factor in ((GRAMS, "g", 1.0), (KILOS, "g", 1000.0), (MILLILITRES, "ml", 1.0), (LITRES, "ml", 1000.0), (PIECES, "unit", 1.0)) for x in group}
OVERSHOOT, TOLERANCE = 0.25, 0.5


def clean_unit(unit: Column) -> Column:
    x = F.lower(F.trim(F.coalesce(unit, F.lit(""))))
    x = F.regexp_replace(F.regexp_replace(x, "[׳′]", "'"), "[״″]", '"')
    return F.regexp_replace(F.regexp_replace(x, r"\s+", ""), r"(?<!\d)\.|\.(?!\d)", "")


def _lookup(unit: Column, place: int) -> Column:
    table = F.from_json(F.lit(json.dumps({k: v[place] for k, v in FORMS.items()})), f"map<string,{('string', 'double')[place]}>")  # one constant, not a branch per form
    return F.try_element_at(table, unit)


def let(value: Column, f) -> Column:
    """f(value) with value computed once, however often f uses it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def measure(qty: Column, unit: Column, weighted: Column | None = None) -> Column:
    """struct(qty, unit, unparseable): grams, millilitres or pieces."""
    by_weight = F.lit(False) if weighted is None else F.coalesce(weighted, F.lit(False))
    missing = qty.isNull() | (qty <= 0) | F.isnan(qty.cast("double"))

    def made(q: Column, u: Column, bad: bool) -> Column:
        return F.struct(q.cast("double").alias("qty"), u.alias("unit"), F.lit(bad).alias("unparseable"))

    def by_inner(x: Column) -> Column:
        return F.when((x["qty"] > 0) & x["unit"].isNotNull(), made(x["qty"] * x["factor"], x["unit"], False)).otherwise(made(qty, F.lit("unit"), True))

    def with_number(plain: Column) -> Column:
        inner = clean_unit(F.regexp_extract(plain, r"^([\d.]+)(.+)$", 2))
        return let(F.struct(F.regexp_extract(plain, r"^([\d.]+)(.+)$", 1).try_cast("double").alias("qty"), _lookup(inner, 0).alias("unit"), _lookup(inner, 1).alias("factor")), by_inner)

    def looked_up(plain: Column) -> Column:
        # A number in the unit is looked for only where the unit isn't one as it is.
        return (
            F.when(missing & by_weight, made(F.lit(1000.0), F.lit("g"), False))
            .when(missing, made(F.lit(1.0), F.lit("unit"), True))
            .when(_lookup(plain, 0).isNotNull(), made(qty * _lookup(plain, 1), _lookup(plain, 0), False))
            .otherwise(with_number(plain))
        )

    return let(clean_unit(unit), looked_up)


def pack_from_name(name: Column) -> Column:
    """struct(qty, unit) that a name states: N x M with a unit, or one quantity with a unit; null if none."""
    text = F.lower(F.coalesce(name, F.lit("")))
    forms = "|".join(sorted((x.replace("'", "['׳]").replace('"', '["״]') for x in FORMS), key=len, reverse=True))
    many = rf"(\d+)\s*[x×*]\s*(\d+(?:\.\d+)?)\s*({forms})(?![\p{{L}}\p{{N}}])"
    one = rf"(\d+(?:\.\d+)?)\s*({forms})(?![\p{{L}}\p{{N}}])"
    times = F.regexp_extract(text, many, 1).try_cast("double") * F.regexp_extract(text, many, 2).try_cast("double")
    unit_many, unit_one = clean_unit(F.regexp_extract(text, many, 3)), clean_unit(F.regexp_extract(text, one, 2))
    single = F.regexp_extract(text, one, 1).try_cast("double")
    made = lambda q, u: F.struct((q * _lookup(u, 1)).alias("qty"), _lookup(u, 0).alias("unit"))
    return F.when(times > 0, made(times, unit_many)).when(single > 0, made(single, unit_one))


def pack_count(name: Column, most: int = 1000) -> Column:
    """Pieces in a pack that a name states, 2 at least."""
    n = F.regexp_extract(F.lower(F.coalesce(name, F.lit(""))), r"(?<![\d.])(\d{1,4})\s*(?:יחידות|יחידה|יח['׳]?|units|pcs|pack)(?![\p{L}])", 1).try_cast("int")
    return F.when(n.between(2, most), n)


def packs_to_buy(amount: Column, unit: Column, pack_qty: Column, size_qty: Column, size_unit: Column) -> Column:
    """struct(qty, mode): whole packs that hold the amount, pieces, or kilograms and litres."""
    made = lambda q, m: F.struct(q.cast("double").alias("qty"), F.lit(m).alias("mode"))
    asked = F.when(pack_qty > 0, pack_qty)

    def of(x: Column) -> Column:
        need, have = x["need"], x["have"]
        known = ~have["unparseable"] & (have["unit"] == need["unit"]) & (have["qty"] > 1)
        return (
            F.when(amount.isNull() | (amount <= 0), made(F.coalesce(asked, F.lit(1.0)), "packs"))
            .when(need["unparseable"], made(F.coalesce(asked, amount), "packs"))
            .when(known, made(F.greatest(F.lit(1), F.ceil(need["qty"] / have["qty"])), "packs"))
            .when(need["unit"] == "unit", made(need["qty"], "units"))
            .otherwise(made(need["qty"] / 1000, "weighted"))
        )

    return let(F.struct(measure(amount, unit).alias("need"), measure(size_qty, size_unit).alias("have")), of)


def composes(size_qty: Column, size_unit: Column, amount: Column, unit: Column, overshoot: float = OVERSHOOT) -> Column:
    """Whether whole packs reach the amount without much more than it."""

    def of(x: Column) -> Column:
        want, have = x["want"], x["have"]
        fits = (F.ceil(want["qty"] / have["qty"]) * have["qty"] - want["qty"]) / want["qty"] <= overshoot
        return F.coalesce(~want["unparseable"] & ~have["unparseable"] & want["unit"].isin("g", "ml") & (have["unit"] == want["unit"]) & (amount > 0) & fits, F.lit(False))

    return let(F.struct(measure(amount, unit).alias("want"), measure(size_qty, size_unit).alias("have")), of)


def compatible(qty_a: Column, unit_a: Column, qty_b: Column, unit_b: Column, tolerance: float = TOLERANCE) -> Column:
    """Why two packs can or can't stand for each other: same_unit, qty_tolerance, unit_mismatch, unparseable_mismatch or both_unparseable."""

    def of(x: Column) -> Column:
        a, b = x["a"], x["b"]
        apart = (a["qty"] > 1) & (b["qty"] > 1) & (F.abs(a["qty"] - b["qty"]) / F.least(a["qty"], b["qty"]) > tolerance)
        return (
            F.when(a["unparseable"] & b["unparseable"], "both_unparseable")
            .when(a["unparseable"] | b["unparseable"], "unparseable_mismatch")
            .when(a["unit"] != b["unit"], "unit_mismatch")
            .when(apart, "qty_tolerance")
            .otherwise("same_unit")
        )

    return let(F.struct(measure(qty_a, unit_a).alias("a"), measure(qty_b, unit_b).alias("b")), of)


def family_of_name(qty: Column, unit: Column, name: Column) -> Column:
    """The unit, or the other of g and ml if the name states the same quantity in it."""
    said = pack_from_name(name)
    return F.when(unit.isin("g", "ml") & said["unit"].isin("g", "ml") & (said["qty"] == qty), said["unit"]).otherwise(unit)
