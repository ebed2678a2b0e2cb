"""What a listing sells: pieces, weight of a piece, form of the package, and whether a purchase keeps what was asked for."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from basketry.functions.text import tokens
from basketry.functions.units import let, measure, pack_count, pack_from_name

# Kilograms of one piece by words of a produce name; the weight where only a cue says that it is produce; the cues; words of single portions.
PIECE_KG = {
    "לימון": 0.12, "עגבניה": 0.12, "עגבניות": 0.12, "מלפפון": 0.11, "מלפפונים": 0.11, "פלפל": 0.16, "בצל ירוק": 0.05, "בצל": 0.15, "תפוח": 0.18, "תפוז": 0.2, "שום": 0.05, "גזר": 0.08, 'תפו"א': 0.15, "תפוח אדמה": 0.15,
    "בטטה": 0.2, "קישוא": 0.15, "חציל": 0.25, "אבוקדו": 0.2, "בננה": 0.15, "בננות": 0.15, "אגס": 0.2, "אפרסק": 0.15, "שזיף": 0.08, "קיווי": 0.09, "רימון": 0.3, "אבטיח": 4.0, "מלון": 1.5,
}
DEFAULT_KG = 0.15
CUES = ("ירק", "ירקות", "פירות", "פרי")
PORTIONS = ("מנות", "מנה", "שקית", "שקיות", "סאש", "סאשה", "סשה")


def words_in(name: Column, words: tuple[str, ...]) -> Column:
    """Whether any of a few words is a token of the name."""
    return F.arrays_overlap(tokens(name), F.array(*map(F.lit, words)))


def longest_phrase(text: Column, table: dict[str, object]) -> Column:
    """The value of the longest phrase of a curated table that the text holds; among equally long ones the first."""
    hits = [F.when(F.contains(text, F.lit(p)), F.lit(v)) for p, v in sorted(table.items(), key=lambda e: -len(e[0]))]
    return F.coalesce(*hits)


def piece_weight(name: Column, weights: dict[str, float] = PIECE_KG, cues: tuple[str, ...] = CUES, default: float = DEFAULT_KG) -> Column:
    """Kilograms of a piece by the longest known word in the name, the default for names with a cue, null for all else."""
    plain = F.trim(F.regexp_replace(F.coalesce(name, F.lit("")), r"\s+", " "))
    return F.coalesce(longest_phrase(plain, weights), F.when(words_in(plain, cues), F.lit(default)))


def sale_facts(name: Column, weighted: Column, raw_qty: Column, unit: Column, unparseable: Column) -> Column:
    """struct(sale_basis, piece_count, source, confidence) from a feed row's flags and its name.

    A feed's count of several pieces wins; then a count in the name; then a feed's count of one. Weighted goods go by kilogram or litre.
    """
    from_pack = let(pack_from_name(name), lambda p: F.when(p["unit"] == "unit", p["qty"]))
    said = F.coalesce(pack_count(name).cast("double"), from_pack)

    def of(x: Column) -> Column:
        feed, named = x["feed"], x["named"]
        source = F.when(feed > 1, "feed").when(named > 0, "name_inferred").when(feed.isNotNull(), "feed")
        sure = F.when(feed > 1, 0.9).when(named > 0, 0.7).when(feed.isNotNull(), 0.85)
        pieces = F.when(feed > 1, feed).when(named > 0, named).otherwise(feed)
        by_weight, no_qty = F.coalesce(weighted, F.lit(False)), ~F.coalesce((raw_qty > 0) & ~F.isnan(raw_qty), F.lit(False))
        basis = F.when(by_weight, F.when(unit == "g", "per_kg").when(unit == "ml", "per_l").otherwise("unknown")).when(unit == "unit", F.when(pieces > 1, "per_pack").otherwise("per_piece")).otherwise("unknown")
        missing = F.when(by_weight, "feed").when(unit == "unit", "feed").otherwise("unknown")
        missing_sure = F.when(by_weight, 0.95).when(unit == "unit", 0.85)
        assumed = by_weight & no_qty
        return F.struct(
            basis.alias("sale_basis"), pieces.alias("piece_count"), F.when(assumed, "weighted_default").otherwise(F.coalesce(source, missing)).alias("source"),
            F.when(assumed, 0.5).when(source.isNotNull(), sure).otherwise(missing_sure).alias("confidence"),
        )

    feed = F.when((unit == "unit") & ~F.coalesce(unparseable, F.lit(False)) & (raw_qty > 0) & ~F.isnan(raw_qty), raw_qty.cast("double"))
    return let(F.struct(feed.alias("feed"), said.alias("named")), of)


def package_form(name: Column, piece_count: Column, portions: tuple[str, ...] = PORTIONS) -> Column:
    """multipack for several pieces or a stated multiple, sachet for single portions, else standard."""
    many = F.coalesce(piece_count > 1, F.lit(False)) | F.coalesce(name.rlike(r"\d+\s*[xX×*]"), F.lit(False))
    return F.when(many, "multipack").when(F.coalesce(words_in(name, portions), F.lit(False)), "sachet").otherwise("standard")


def forms_agree(a: Column, b: Column) -> Column:
    """Whether two package forms may stand for each other: alike, or both made of portions."""
    return (a == b) | ((a != "standard") & (b != "standard"))


def counts_as_weight(class_l1: Column, class_l2: Column, request_unit: Column | None = None) -> Column:
    """Whether pieces may be served by goods sold by weight: produce, flat bread, and wine (with a request's unit: only if it is pieces or none)."""
    wine = class_l2 == "wine"
    if request_unit is not None:
        wine = wine & (request_unit.isNull() | (request_unit == "unit"))
    return F.coalesce((class_l1 == "produce") | (class_l2 == "pita_flatbread") | wine, F.lit(False))


def purchase_fault(amount: Column, unit: Column, pack_qty: Column, qty: Column, mode: Column) -> Column:
    """Why a purchase doesn't keep what was asked for: not_positive, unknown_mode, weight_differs or part_of_a_pack; null if it does."""

    def of(need: Column) -> Column:
        asked = F.coalesce(amount > 0, F.lit(False))
        by_measure = asked & ~need["unparseable"] & need["unit"].isin("g", "ml")
        return (
            F.when(~F.coalesce((qty > 0) & ~F.isnan(qty), F.lit(False)), "not_positive")
            .when(asked & ~mode.isin("packs", "weighted", "units"), "unknown_mode")
            .when(by_measure & (mode == "weighted") & (F.abs(qty - need["qty"] / 1000) > 1e-9), "weight_differs")
            .when((mode == "packs") & (qty != F.floor(qty)), "part_of_a_pack")
        )

    return let(measure(amount, unit), of)
