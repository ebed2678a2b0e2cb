"""Scalar functions on stated cases."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from basketry.functions import promo, units, vectors
from basketry.functions import text as tx


def values(spark, rows, schema, *columns):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*columns).collect()]


def test_morphology(spark):
    got = dict(values(spark, [("עגבניות",), ("מלפפונים",), ("לחם",), ("הא",)], "t string", "t", tx.stem(F.col("t"))))
    assert got == {"עגבניות": "עגבני", "מלפפונים": "מלפפונ", "לחם": "לחמ", "הא": "הא"}
    assert values(spark, [("מלפפונים",)], "t string", tx.singulars(F.col("t"))) == [(["מלפפון"],)]
    assert values(spark, [("פרגיות",)], "t string", tx.singulars(F.col("t"))) == [(["פרגיה", "פרגית"],)]


def test_tokens_satisfied(spark):
    rows = [("טייסטרס", "קפה טסטרס"), ("חלב", "גבינה"), ("", "x")]
    assert [r[0] for r in values(spark, rows, "q string, n string", tx.all_tokens_in(F.col("q"), F.col("n")))] == [True, False, True]


@pytest.mark.parametrize(
    "fields, kind, extra",
    [
        (("2 ב-30", None, None, None, None, None), "n_for_price", {"n": 2.0, "price": 30.0}),
        (("3 for 20", None, None, None, None, None), "n_for_price", {"n": 3.0, "price": 20.0}),
        (("מחיר מועדון", None, None, 9.9, None, "7"), "club_price", {"price": 9.9}),
        (("1+1 שוקולד 3%", None, None, None, None, None), "second_unit_pct", {"percent": 100.0}),
        (("השני ב-50%", None, None, None, None, None), "second_unit_pct", {"percent": 50.0}),
        (("deal", 3.0, None, 5.0, None, None), "simple_discount", {"discounted_price": 5.0, "min_qty": 3.0}),
        (("deal", None, 15.0, None, None, "0"), "simple_discount", {"rate": 15.0}),
        (("x", None, None, None, 50.0, None), "spend_threshold", {}),
        ((None, None, None, None, None, None), "other", {}),
    ],
)
def test_mechanics(spark, fields, kind, extra):
    c = [F.col(x) for x in ("d", "q", "r", "p", "s", "c")]
    got = values(spark, [fields], "d string, q double, r double, p double, s double, c string", promo.mechanic(*c))[0][0]
    assert got["kind"] == kind
    assert {k: got[k] for k in extra} == extra


@pytest.mark.parametrize(
    "case, total",
    [
        ((10.0, 2.0, "simple_discount", None, None, None, 10.0, None, None), 18.0),
        ((10.0, 2.0, "simple_discount", None, None, None, None, 7.0, None), 14.0),
        ((79.9, 1.0, "simple_discount", None, None, None, 5.0, 13.21, None), 79.9 * 0.95),  # the absolute price contradicts the rate
        ((10.0, 1.0, "simple_discount", None, None, None, None, 7.0, 2.0), 10.0),
        ((10.0, 5.0, "n_for_price", 2.0, 15.0, None, None, None, None), 40.0),
        ((10.0, 3.0, "second_unit_pct", None, None, 50.0, None, None, None), 25.0),
        ((10.0, 2.0, "club_price", None, 8.0, None, None, None, None), 16.0),
        ((10.0, 2.0, "spend_threshold", None, None, None, 5.0, None, None), 20.0),
        ((10.0, 2.0, "other", None, None, None, None, None, None), 20.0),
    ],
)
def test_line_total(spark, case, total):
    names = ("lp", "q", "k", "n", "p", "pc", "r", "a", "m")
    got = values(spark, [case], "lp double, q double, k string, n double, p double, pc double, r double, a double, m double", promo.line_total(*map(F.col, names)))
    assert got[0][0] == pytest.approx(total)


def test_units(spark):
    rows = [(2.0, "קג", None), (500.0, " גרם. ", None), (1.0, "1.5ליטר", None), (3.0, "crate", None), (None, "g", True), (None, "g", None)]
    got = [tuple(r[0]) for r in values(spark, rows, "q double, u string, w boolean", units.measure(F.col("q"), F.col("u"), F.col("w")))]
    assert got == [(2000.0, "g", False), (500.0, "g", False), (1500.0, "ml", False), (3.0, "unit", True), (1000.0, "g", False), (1.0, "unit", True)]


def test_pack_from_name(spark):
    rows = [("6 x 330 ml cola",), ("שמן 1.5 ליטר",), ("water",), ("8×150 גרם",)]
    got = [None if r[0] is None else tuple(r[0]) for r in values(spark, rows, "n string", units.pack_from_name(F.col("n")))]
    assert got == [(1980.0, "ml"), (1500.0, "ml"), None, (1200.0, "g")]


def test_hashed_embedding(spark):
    def brute(text, size=384):
        out = np.zeros(size)
        for n in (2, 3, 4):
            for i in range(len(text) - n + 1):
                h = 0x811C9DC5
                for c in text[i : i + n]:
                    h = ((h ^ ord(c)) * 0x01000193) & 0xFFFFFFFF
                out[h % size] += 1 if h % 2 == 0 else -1
        return out / (np.linalg.norm(out) or 1)

    texts = ["olive oil", "", "שמן זית", "a"]
    got = values(spark, [(t,) for t in texts], "t string", vectors.hashed_embedding(F.col("t")))
    for t, g in zip(texts, got):
        assert np.allclose(g[0], brute(t))


def test_name_similarity_bounds(spark):
    rows = [("", ""), ("a", ""), ("milk", "milk"), ("choco", "chocolate"), ("tea", "rice")]
    got = [r[0] for r in values(spark, rows, "a string, b string", tx.name_similarity(F.col("a"), F.col("b")))]
    assert got[:3] == [1.0, 0.0, 1.0] and got[3] >= 5 / 9 and got[4] == 0.0
