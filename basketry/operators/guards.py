"""What keeps a product from standing for a query, though their words meet: made from it, preserved, for the bath, of another form, size or count."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketry.functions import text as tx
from basketry.functions import units

# Word lists of the guards. Goods made from a staple; words that make it a flavour; words of preserved forms; of the bath; forms that aren't fresh with their words;
# produce by name; heads of goods made from produce; classes that aren't food; classes that aren't fresh.
DERIVED = """חטיף חטיפי חטיפים שוקולד שוקולדים עוגיות עוגייה עוגיה סוכריות סוכריה פופקורן חלבה פריכיות פרכיות פריכית פצפוצי פצפוצים בצקניות בצקנית וופל וופלים אטריות איטריות אטריה נודלס פסטה מקלוני מקלונים מקלון דפי דף פירורי פרורי פירורים בצק
    משקה משקאות שייק רוטב רטבים רסק מחית ריבת ריבה ממרח ממרחים מרק מרקים תרכיז אבקת אבקה תערובת מלית ארוחת ארוחה מנת תבשיל סלט סלטים שימורי שימורים יוגורט מדבקות מדבקה ערכת ערכה""".split()
FLAVOURS = "טעם בטעם טעמים בטעמים".split()
PRESERVED = "כבוש כבושה כבושי כבושים חמוץ חמוצה חמוצים מוחמץ מוחמצים משומר משומרת משומרים מרוסק מרוסקת מרוסקות מרוסקים שימורים פרוס פרוסה פרוסות פרוסים קצוץ קצוצה קצוצים מגורד מגוררת מגורר ממולא ממולאים ליים".split()
BATH = "אמבט אמבטיה רחצה שמפו קוסמטיקה גוף פנים קרם סבון אלסבון".split()
NOT_FRESH = {
    "pickled": "כבוש כבושה כבושי כבושים חמוץ חמוצה חמוצים".split(),
    "canned": "מרוסק מרוסקת מרוסקות מרוסקים משומר משומרת משומרים שימורים".split(),
    "flour": ["קמח"],
    "prepared": "ניוקי רביולי טורטליני קצוץ קצוצה פרוס פרוסה פרוסות מיובש מיובשים".split(),
    "frozen": "קפוא קפואה מוקפא מוקפאת".split(),
}
PRODUCE = ["תפוחי אדמה", "תפוח אדמה", "עגבניות", "עגבניה", "מלפפונים", "מלפפון", "בצל", "לימון", "לימונים", "גזר", "בננה", "בננות", "חסה", "פלפל", "שום", "חציל", "קישוא", "אבוקדו", "בטטה"]
MADE_OF_PRODUCE = "רסק רסקים רוטב רטבים מחית פירה ממרח מרוכז מרוכזת מיץ משקה אבקת מרק ריבה קטשופ".split()
NON_FOOD = ("personal_care", "household", "non_food_other")
NOT_FRESH_CLASSES = ("canned_preserved", "frozen", "pantry_dry", "snacks_sweets", *NON_FOOD)


@dataclass(frozen=True)
class Words:
    """The word lists that the guards go by; another trade brings its own."""

    derived: tuple[str, ...] = tuple(DERIVED)
    flavours: tuple[str, ...] = tuple(FLAVOURS)
    preserved: tuple[str, ...] = tuple(PRESERVED)
    bath: tuple[str, ...] = tuple(BATH)
    not_fresh: tuple[tuple[str, tuple[str, ...]], ...] = tuple((k, tuple(v)) for k, v in NOT_FRESH.items())
    produce: tuple[str, ...] = tuple(PRODUCE)
    made_of_produce: tuple[str, ...] = tuple(MADE_OF_PRODUCE)
    non_food: tuple[str, ...] = NON_FOOD
    not_fresh_classes: tuple[str, ...] = NOT_FRESH_CLASSES


HEBREW = Words()


def _listed(words) -> Column:
    return F.array(*map(F.lit, words)).cast("array<string>")


def _stems(words: Column) -> Column:
    return F.transform(words, tx.stem)


def not_fresh_form(text: Column, words: Words = HEBREW) -> Column:
    """The first form that isn't fresh of which the text has a word, else null."""
    said = tx.tokens(text)
    return F.coalesce(*(F.when(F.arrays_overlap(said, _listed(w)), form) for form, w in words.not_fresh), F.lit(None).cast("string"))


def blocks_fresh(text: Column, words: Words = HEBREW) -> Column:
    """Whether a query names a form that isn't fresh, or what is made of produce rather than produce."""
    return not_fresh_form(text, words).isNotNull() | F.arrays_overlap(tx.tokens(text), _listed(words.made_of_produce))


def looks_like_produce(text: Column, words: Words = HEBREW) -> Column:
    plain = tx.embed_input(text)
    found = F.lit(False)
    for phrase in words.produce:
        found = found | F.contains(plain, F.lit(phrase))
    return F.coalesce(found, F.lit(False))


def for_the_bath(text: Column, words: Words = HEBREW) -> Column:
    return F.arrays_overlap(tx.tokens(text), _listed(words.bath))


def stated_pack(text: Column) -> Column:
    """struct(pieces, quantity, unit) that a query asks for outright: pieces in a tray or pack, litres ("L") or millilitres."""
    x = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))
    end = r"(?=$|[\s,.\-_/])"
    part = lambda p: F.nullif(F.regexp_extract(x, p, 1), F.lit("")).try_cast("double")
    pieces = F.coalesce(part(r"(?i)תבנית\s*(\d+(?:\.\d+)?)"), part(rf"(\d+(?:\.\d+)?)\s*(?:יחידות|יח['׳]?){end}"), part(r"(?:^|\s)(\d+(?:\.\d+)?)\s*ביצ"))
    litres, ml = part(rf"(?i)(\d+(?:\.\d+)?)\s*(?:ליטר|ליטרים|ל\.?|l){end}"), part(rf"(?i)(\d+(?:\.\d+)?)\s*(?:מ[\"״]?ל|ml|מיליליטר){end}")
    quantity = F.coalesce(ml, litres)
    return F.struct(F.when(pieces > 0, F.round(pieces).cast("int")).alias("pieces"), F.when(quantity > 0, quantity).alias("quantity"), F.when(ml > 0, "ml").when(ml.isNull() & (litres > 0), "L").alias("unit"))


def _unsaid(query: Column, name: Column, listed: tuple[str, ...]) -> Column:
    """Whether the name has a listed word that the query hasn't."""
    return F.size(F.array_except(F.array_intersect(tx.tokens(name), _listed(listed)), tx.tokens(query))) > 0


def unasked_preserved(query: Column, name: Column, words: Words = HEBREW) -> Column:
    return _unsaid(query, name, words.preserved)


def unasked_bath(query: Column, name: Column, words: Words = HEBREW) -> Column:
    return _unsaid(query, name, words.bath)


def unasked_addition(query: Column, name: Column, marks: str = "עם|בטעם") -> Column:
    """Whether the name is with, or tastes of, something and the query isn't."""
    pattern = rf"(?:^|\s)(?:{marks})\s+\S+"
    return tx.embed_input(name).rlike(pattern) & ~tx.embed_input(query).rlike(pattern)


def unasked_derived(query: Column, name: Column, words: Words = HEBREW) -> Column:
    """Whether the name is of something made from what the query asks for.

    A word of such goods counts before the query's first word in the name, or right behind it; anywhere if that isn't in the name. A word of flavour counts only before it.
    """
    asked, said = _stems(tx.tokens(query)), _stems(tx.tokens(name))
    derived, flavours = (F.array_distinct(_stems(_listed(w))) for w in (words.derived, words.flavours))
    head = F.array_position(said, F.get(asked, F.lit(0))).cast("int")  # from 1 on, 0 if it isn't there

    def bad(stem: Column, i: Column) -> Column:
        made, flavour, before = F.array_contains(derived, stem), F.array_contains(flavours, stem), i + 1 < head
        placed = F.when(head == 0, made).when(flavour, before).otherwise(before | (i == head))
        return (made | flavour) & ~F.array_contains(asked, stem) & placed

    return F.when((F.size(asked) > 0) & (F.size(said) > 0), F.exists(F.transform(said, bad), lambda x: x)).otherwise(False)


def names_derived(query: Column, words: Words = HEBREW) -> Column:
    return F.arrays_overlap(_stems(tx.tokens(query)), F.array_distinct(_stems(_listed(words.derived))))


def variant_conflict(a: Column, b: Column) -> Column:
    return F.coalesce(a != b, F.lit(False))


def preparation_conflict(a: Column, b: Column) -> Column:
    """Plain and flavoured are both the staple; unknown never conflicts."""
    kind = lambda x: F.when(x.isin("plain", "flavoured"), "staple").otherwise(x)
    return F.coalesce(kind(a) != kind(b), F.lit(False))


def pieces_of(piece_count: Column, size_qty: Column, size_unit: Column, name: Column) -> Column:
    """How many pieces a product's pack holds: as stated, by its size in units, by its name; null if unknown."""
    inside = units.pack_from_name(name)
    return F.coalesce(F.round(piece_count), F.when((size_unit == "unit") & (size_qty > 1), F.round(size_qty)), units.pack_count(name), F.when((inside["unit"] == "unit") & (inside["qty"] > 1), F.round(inside["qty"]))).cast("int")


def pieces_conflict(a: Column, b: Column) -> Column:
    return F.coalesce(a != b, F.lit(False))


def why_not(query: Column, name: Column, preparation: Column, class_l1: Column, class_l2: Column, variant: Column, pieces: Column, wanted_pieces: Column, fresh: Column, non_food_ok: Column, words: Words = HEBREW) -> Column:
    """Why a candidate can't stand for a staple, the first reason that holds: preserved, bath, derived, percent, non_food, not_fresh, pieces; null if it can.

    A known preparation decides on derived goods in place of their words: derived_ingredient and prepared_meal go unless the query names such a form.
    """
    labelled = preparation.isNotNull() & (preparation != "")
    derived = F.when(labelled, preparation.isin("derived_ingredient", "prepared_meal") & ~names_derived(query, words)).otherwise(unasked_derived(query, name, words))
    not_fresh = fresh & (F.coalesce(class_l1.isin(*words.not_fresh_classes), F.lit(False)) | F.coalesce(class_l2.isin("flour_baking", "frozen_prepared"), F.lit(False)) | F.coalesce(variant == "sliced_prepared", F.lit(False)))
    return (
        F.when(unasked_preserved(query, name, words), "preserved")
        .when(unasked_bath(query, name, words), "bath")
        .when(derived, "derived")
        .when(tx.percents_conflict(query, name), "percent")
        .when(F.coalesce(class_l1.isin(*words.non_food), F.lit(False)) & ~non_food_ok & ~for_the_bath(query, words), "non_food")
        .when(not_fresh, "not_fresh")
        .when(F.coalesce(pieces != wanted_pieces, F.lit(False)), "pieces")
    )


def asks_non_food(candidates: DataFrame, words: Words = HEBREW, keys: tuple[str, ...] = ("query_id",)) -> DataFrame:
    """(keys, non_food_ok): a query whose best candidate isn't food, or none of whose candidates is, asks for such goods (candidates: class_l1, rank)."""
    other = F.coalesce(F.col("class_l1").isin(*words.non_food), F.lit(False))
    return candidates.groupBy(*keys).agg((F.min_by(other, "rank") | F.min(other)).alias("non_food_ok"))


def direct_first(query: Column, name: Column, words: Words = HEBREW) -> Column:
    """A sort key: the goods themselves before what is made from them."""
    return unasked_derived(query, name, words).cast("int")


def valid_path(rows: DataFrame, taxonomy: DataFrame, none: str = "none") -> DataFrame:
    """rows with `valid`: whether (l1, l2, l3) is a path of the taxonomy (l1, l2, l3); l2 and l3 may be missing from below, l3 may be `none`."""
    l1s = taxonomy.select(F.col("l1").alias("t1")).distinct()
    l2s = taxonomy.select(F.col("l1").alias("u1"), F.col("l2").alias("u2")).where("u2 IS NOT NULL").distinct()
    l3s = taxonomy.select(F.col("l2").alias("v2"), F.col("l3").alias("v3")).where("v3 IS NOT NULL").distinct()
    out = rows.join(l1s, F.col("l1") == F.col("t1"), "left").join(l2s, (F.col("l1") == F.col("u1")) & (F.col("l2") == F.col("u2")), "left").join(l3s, (F.col("l2") == F.col("v2")) & (F.col("l3") == F.col("v3")), "left")
    open_ = F.col("l3").isNull() | (F.col("l3") == none)
    valid = F.col("t1").isNotNull() & F.when(F.col("l2").isNull(), open_).otherwise(F.col("u2").isNotNull() & (open_ | F.col("v3").isNotNull()))
    return out.select(*rows.columns, valid.alias("valid"))
