"""Lines of a list to products: pack facts, towns in texts, safe choices, tiers, covering peers against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from basketry.functions import packs, vectors
from basketry.operators import basket, lines, merge, places, quality


def column(spark, rows, schema, made):
    return [r[0] for r in spark.createDataFrame(rows, schema).orderBy("i").select(made).collect()]


def test_piece_weights_take_the_longest_word_and_cues_are_whole_words(spark):
    names = ["בצל ירוק טרי", "בצל יבש", "מארז פירות", "קפה פרימיום", "", None]
    assert column(spark, list(enumerate(names)), "i int, name string", packs.piece_weight(F.col("name"))) == [0.05, 0.15, 0.15, None, None, None]


def test_sale_facts(spark):
    cases = [
        ("eggs 12 units", False, 1.0, "unit", False), ("eggs", False, 6.0, "unit", False), ("one", False, 1.0, "unit", False), ("apples", True, None, "g", True), ("apples", True, 500.0, "g", False),
        ("juice", True, 1.0, "ml", False), ("flour", False, 1000.0, "g", False), ("odd", None, float("nan"), "unit", None), (None, None, None, "unit", None), ("6 units in grams", False, 300.0, "g", False),
    ]
    made = packs.sale_facts(*(F.col(c) for c in ("name", "weighted", "qty", "unit", "bad")))
    got = column(spark, [(i, *c) for i, c in enumerate(cases)], "i int, name string, weighted boolean, qty double, unit string, bad boolean", made)
    assert [tuple(x) for x in got] == [
        ("per_pack", 12.0, "name_inferred", 0.7), ("per_pack", 6.0, "feed", 0.9), ("per_piece", 1.0, "feed", 0.85), ("per_kg", None, "weighted_default", 0.5), ("per_kg", None, "feed", 0.95),
        ("per_l", None, "feed", 0.95), ("unknown", None, "unknown", None), ("per_piece", None, "feed", 0.85), ("per_piece", None, "feed", 0.85), ("unknown", 6.0, "name_inferred", 0.7),
    ]


def test_package_forms(spark):
    rows = [(0, "coffee 3x50", None), (1, "קפה שקית", 1), (2, "coffee jar", None), (3, "jar", 4), (4, None, None)]
    forms = column(spark, rows, "i int, name string, n int", packs.package_form(F.col("name"), F.col("n")))
    assert forms == ["multipack", "sachet", "standard", "multipack", "standard"]


def test_purchases_keep_what_was_asked_for(spark):
    rows = [(0, 2.0, "kg", None, 2.0, "weighted"), (1, 2.0, "kg", None, 1.5, "weighted"), (2, 2.0, "kg", None, 1.5, "packs"), (3, None, None, 2.0, 2.0, "packs"), (4, 1.0, "kg", None, 0.0, "packs"), (5, 1.0, "kg", None, None, "packs"), (6, 1.0, "unit", None, 1.0, "?")]
    got = column(spark, rows, "i int, amount double, unit string, pack double, qty double, mode string", packs.purchase_fault(*(F.col(c) for c in ("amount", "unit", "pack", "qty", "mode"))))
    assert got == [None, "weight_differs", "part_of_a_pack", None, "not_positive", "not_positive", "unknown_mode"]


TOWNS = [("שדרות", "שדרות", "town"), ("אילת", "אילת", "town"), ("ירושלים", "ירושלים", "town"), ("רמת גן", "רמת גן", "town"), ("מעלות תרשיחא", "מעלות", "town"), ("תרשיחא", "מעלות", "town"), ("רעננה", "רעננה", "town"), ("נווה עמל", "הרצליה", "quarter"), ("תל אביב-יפו", "תל אביב", "town"), ("תל אביב", "תל אביב", "town")]


def test_streets_give_way_to_towns(spark):
    cases = {
        "שדרות התמרים 1, אילת": "אילת", "שדרות": "שדרות", "שדרות מערב": "שדרות", "ברחוב ירושלים 3, רמת גן": "רמת גן", "שדרות ירושלים, ירושלים": "ירושלים", "שדרות מעלות תרשיחא 5, רעננה": "רעננה",
        "נווה עמל 3": "הרצליה", "רחוב הרצל, נווה עמל, אילת": "אילת", "תל אביב - יפו": "תל אביב", "somewhere": None, "": None, None: None,
    }
    texts = spark.createDataFrame(list(enumerate(cases)), "text_id int, text string")
    got = {r["text_id"]: r["town"] for r in places.town_of_text(texts, spark.createDataFrame(TOWNS, "alias string, town string, kind string")).collect()}
    assert {t: got.get(i) for i, t in enumerate(cases)} == cases


def test_towns_of_store_names(spark):
    names = ["שלי רעננה- הבנים", "Store 799", "סניף 4170 (אילת)", 'פ"ת מרכז', None, "", "רמת גן"]
    stores = spark.createDataFrame(list(enumerate(names)), "store_id int, name string")
    short = spark.createDataFrame([('פ"ת', "פתח תקווה")], "short string, town string")
    got = {r["store_id"]: r["town"] for r in places.town_of_store_name(stores, spark.createDataFrame(TOWNS, "alias string, town string, kind string"), ("שלי", "סניף"), short).collect()}
    assert got == {0: "רעננה", 2: "אילת", 3: "פתח תקווה", 6: "רמת גן"}


def brute_cover(rows, limit):
    """Stores by how few peers they have, each taking its cheapest unless it is served, then the cheapest of the rest."""
    price, sold = {}, {}
    for product, store, p in rows:
        price[product] = min(p, price.get(product, p))
        sold.setdefault(store, set()).add(product)
    by_price = sorted(price, key=lambda x: (price[x], x))
    out = []
    for store in sorted(sold, key=lambda s: (len(sold[s]), s)):
        if not sold[store] & set(out):
            out.append(next(x for x in by_price if x in sold[store]))
    covers = len(out)
    out += [x for x in by_price if x not in out][: max(0, limit - len(out))]
    return [(x, i + 1, "covers" if i < covers else "price") for i, x in enumerate(out)]


@pytest.mark.parametrize("seed", range(4))
def test_covering_peers_equal_brute_force(spark, seed):
    rng = random.Random(seed)
    groups = {f"line{n}": [(rng.randrange(40), rng.randrange(25), float(rng.randrange(1, 9))) for _ in range(rng.choice([1, 10, 120]))] for n in range(4)}
    peers = spark.createDataFrame([(g, *r) for g, rows in groups.items() for r in rows], "line string, product_id long, store_id long, price double")
    got = {g: [] for g in groups}
    for r in sorted(lines.covering_peers(peers, 6).collect(), key=lambda r: r["place"]):
        got[r["line"]].append((r["product_id"], r["place"], r["why"]))
    assert got == {g: brute_cover(rows, 6) for g, rows in groups.items()}
    assert lines.covering_peers(peers.where("false"), 6).count() == 0


def test_looser_tiers_serve_only_what_stricter_ones_lack(spark):
    candidates = spark.createDataFrame([(1, 1, 0), (1, 2, 1), (1, 3, 1), (1, 4, 2)], "product_id long, candidate_id long, tier int")
    prices = spark.createDataFrame([(1, 10, 9.0), (2, 10, 1.0), (3, 20, 5.0), (2, 20, 5.0), (4, 20, 1.0), (4, 30, 2.0), (1, 40, 0.0)], "product_id long, store_id long, price double")
    assert sorted(tuple(r) for r in lines.tiered_units(candidates, prices).collect()) == [(1, 10, 1, 0, 9.0), (1, 20, 2, 1, 5.0), (1, 30, 4, 2, 2.0)]


def pool(spark, rows):
    schema = "query_id int, product_id long, category string, score double, store_count long, chain_count long, brand string, guarded boolean, brand_wanted string, variant string, variant_wanted string, pack_fits boolean"
    return spark.createDataFrame(rows, schema)


def test_safe_candidates_keep_to_what_was_said(spark):
    rows = [
        (1, 1, "a", 1.0, 1, 1, None, False, "Foo Bar", None, None, None), (1, 2, "a", 1.0, 1, 1, "bar foo", None, "Foo Bar", None, None, None), (1, 3, "a", 1.0, 1, 1, "baz", False, "Foo Bar", None, None, None), (1, 4, "a", 1.0, 1, 1, None, True, None, None, None, None),
        (2, 5, "a", 1.0, 1, 1, None, False, None, "organic", "organic", None), (2, 6, "a", 1.0, 1, 1, None, False, None, None, "organic", None), (2, 7, "a", 1.0, 1, 1, None, False, None, "regular", "organic", None),
    ]
    assert {r["product_id"] for r in lines.safe(pool(spark, rows)).collect()} == {1, 2, 5}


def test_the_policy_answers_or_says_why_not(spark):
    plain = [None, False, None, None, None, None]
    rows = [(1, 1, "a", 0.9, 2, 1, *plain), (1, 2, "a", 0.8, 9, 3, *plain), (2, 3, "a", 1.0, 5, 1, *plain), (2, 4, "b", 1.0, 5, 1, *plain), (3, 5, "a", 1.0, 0, 0, *plain), (4, 6, "a", 1.0, 5, 1, None, True, None, None, None, None), (6, 7, None, 1.0, None, None, *plain)]
    queries = spark.createDataFrame([(i,) for i in range(1, 7)], "query_id int")
    got = {r["query_id"]: tuple(r)[1:] for r in lines.fast_policy(queries, pool(spark, rows)).collect()}
    assert got == {1: (2, "selected", True), 2: (None, "ambiguous_class", False), 3: (None, "no_local_price", False), 4: (None, "no_safe_match", False), 5: (None, "no_safe_match", False), 6: (None, "no_local_price", False)}


def test_known_storefronts_outlive_a_feed(spark):
    known = spark.createDataFrame([(1, 1, "online"), (2, 1, "pickup"), (3, 1, "branch"), (4, 1, "online")], "store_id long, chain_id long, store_kind string")
    feed = spark.createDataFrame([(1, 1, "warehouse"), (4, 1, "online"), (5, 1, None)], "store_id long, chain_id long, store_kind string")
    got = {r["store_id"]: (r["store_kind"], r["origin"]) for r in merge.kept_storefronts(known, feed).collect()}
    assert got == {1: ("online", "rescued"), 2: ("pickup", "restored"), 4: ("online", "feed"), 5: (None, "feed")}


def test_transient_errors(spark):
    assert column(spark, [(0, "read ECONNRESET"), (1, "bad XML"), (2, None), (3, "Timeout exceeded when trying to connect")], "i int, m string", quality.transient(F.col("m"))) == [True, False, False, True]


def test_nearest_equals_brute_force_with_ties_and_odd_vectors(spark):
    rng = random.Random(5)
    points = [(i, [rng.gauss(0, 1) for _ in range(6)]) for i in range(300)] + [(900, [0.0] * 6), (901, None)]
    points += [(i + 400, v) for i, v in points[:60]]  # exact copies
    rows = spark.createDataFrame(points, "id long, vector array<double>").repartition(7)
    queries = rows.where("id % 20 = 0").select(F.col("id").alias("query_id"), "vector")
    got = {(r["query_id"], r["rank"]): r["id"] for r in vectors.nearest(queries, rows, 4, 0.8).collect()}
    good = [(i, v) for i, v in points if v and any(v)]
    size = lambda v: sum(x * x for x in v) ** 0.5
    want = {}
    for q, v in good:
        if q % 20 == 0:
            near = sorted((round(1 - sum(a * b for a, b in zip(v, w)) / size(v) / size(w), 9), i) for i, w in good)
            want |= {(q, n + 1): i for n, (d, i) in enumerate([x for x in near if x[0] <= 0.8][:4])}
    assert got == want


def test_comparable_totals_equal_brute_force(spark):
    rng = random.Random(9)
    rows = [(b, p, s, 1.0, float(rng.randrange(1, 900)) / 10) for b in range(6) for p in range(rng.randrange(1, 6)) for s in range(5) if rng.random() < 0.6]
    priced = spark.createDataFrame(rows, "basket_id long, product_id long, store_id long, qty double, line_total double")
    by_line = {}
    for b, p, s, _, t in rows:
        by_line.setdefault((b, p), {})[s] = t
    middle = lambda v: (sorted(v)[(len(v) - 1) // 2] + sorted(v)[len(v) // 2]) / 2
    for r in basket.comparable(priced).collect():
        mine = {p: m for (b, p), m in by_line.items() if b == r["basket_id"]}
        lacking = [middle(list(m.values())) for m in mine.values() if r["store_id"] not in m]
        assert r["imputed_lines"] == len(lacking) and abs(r["imputed_total"] - sum(lacking)) < 0.011
        assert abs(r["total"] - sum(m[r["store_id"]] for m in mine.values() if r["store_id"] in m)) < 1e-6
