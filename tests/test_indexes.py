"""Operators that find pairs without making all of them: vocabulary, coverage, similar sets, vectors. Each against brute force."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from basketry.functions import vectors
from basketry.operators import delivery, resolve
from basketry.operators import vocabulary as vo
from basketry.plans.registry import QUERIES

TERMS = "term string, mode string, kind string, attribute string, value string, priority int, implies_attribute string, implies_value string"
RULES = "service_id int, scope string, city string, lat double, lng double, radius_km double, ring array<struct<lng:double,lat:double>>, confidence int"


def chosen(words, terms):
    """Spans by trying every term at every place, then taking the best that fit."""
    hits = []
    for t in terms:
        w = t[0].split()
        if t[2] == "stopword":
            continue
        if t[1] == "exact":
            hits += [(0, len(words), t)] if words == w and w else []
            continue
        hits += [(i, i + len(w), t) for i in range(len(words) - len(w) + 1) if w and words[i : i + len(w)] == w]
    hits.sort(key=lambda h: (-(h[2][5] or 0), h[0] - h[1], -len(h[2][0]), h[0], h[2][0], h[2][2], h[2][3] or "", h[2][4] or ""))
    out = []
    for a, b, t in hits:
        if all((a, b) == (x, y) or b <= x or y <= a for x, y, _ in out):
            out.append((a, b, t))
    return sorted((a, b, t[0], t[2], t[4]) for a, b, t in out)


@pytest.fixture(scope="module")
def terms():
    rng, words = random.Random(1), [f"w{i}" for i in range(14)]
    out = []
    for _ in range(2500):
        t = " ".join(rng.choice(words) for _ in range(rng.choice([1, 1, 2, 2, 3, 4])))
        kind = rng.choice(["attribute", "concept", "penalty", "stopword"])
        out.append((t, rng.choice(["token", "phrase", "alias", "exact"]), kind, rng.choice("abc") if kind in ("attribute", "penalty") else None, rng.choice("xyz"), rng.choice([None, 0, 1, 5]), rng.choice([None, "a", "b"]), "x"))
    return sorted(set(out), key=str) + [("", "token", "concept", None, "none", 1, None, None)]


@pytest.mark.parametrize("most", [vo.MOST_TERMS, 10])
def test_spans_equal_brute_force(spark, terms, most):
    """By the automaton, and by the join that a larger vocabulary takes."""
    rng = random.Random(2)
    texts = [" ".join(f"w{rng.randint(0, 15)}" for _ in range(rng.randint(0, 9))) for _ in range(150)] + ["", "W1  w2!", None, "zz"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(999, texts[0])], "id int, text string")
    got = vo.spans(rows, spark.createDataFrame(terms, TERMS), most_terms=most).collect()
    assert len(got) == len(texts) + 1
    for r in got:
        words = (r["text"] or "").lower().replace("!", "").split()
        assert sorted((s["start"], s["end"], s["term"], s["kind"], s["value"]) for s in r["spans"]) == chosen(words, terms)


def test_implied_constraints_are_never_hard(spark):
    terms = [("cold", "token", "attribute", "state", "cold", 1, "pack", "box"), ("box", "token", "attribute", "pack", "box", 1, None, None), ("bag", "token", "attribute", "pack", "bag", 1, None, None), ("x y", "alias", "alias", None, "z", 1, None, None), ("xy", "alias", "alias", None, "z", 1, None, None)]
    vocabulary = spark.createDataFrame(terms, TERMS)
    rows = spark.createDataFrame([("cold",), ("cold box",), ("cold bag",), ("nothing",)], "text string")
    got = {r["text"]: {(x["attribute"], x["value"], x["strength"], x["source"]) for x in r["c"]} for r in vo.spans(rows, vocabulary).select("text", vo.constraints(F.col("spans"), {"state": "hard", "pack": "hard"}).alias("c")).collect()}
    assert got["cold"] == {("state", "cold", "hard", "explicit"), ("pack", "box", "ranking", "implied")}
    assert got["cold box"] == {("state", "cold", "hard", "explicit"), ("pack", "box", "hard", "explicit")}
    assert ("pack", "bag", "hard", "explicit") in got["cold bag"] and got["nothing"] == set()
    said = {r["text"]: r["said"] for r in vo.expansions(spark.createDataFrame([("X Y",), ("x",), (" xy ",)], "text string"), vocabulary).collect()}
    assert said == {"X Y": ["X Y", "z", "x y", "xy"], "x": ["x"], " xy ": ["xy", "z", "x y"]}


def ring(*points):
    return [{"lng": float(x), "lat": float(y)} for x, y in points]


def in_ring(lng, lat, r):
    inside = False
    for a, b in zip(r, r[-1:] + r[:-1]):
        if (a["lat"] > lat) != (b["lat"] > lat) and lng < (b["lng"] - a["lng"]) * (lat - a["lat"]) / (b["lat"] - a["lat"]) + a["lng"]:
            inside = not inside
    return inside


def test_coverage_equals_every_rule_at_every_place(spark):
    import math

    rng = random.Random(4)
    star = ring(*((35 + (0.9 if i % 2 else 0.2) * math.cos(i * math.pi / 9), 31 + (0.9 if i % 2 else 0.2) * math.sin(i * math.pi / 9)) for i in range(18)))
    rules = [(1, "polygon", None, None, None, None, star, 2), (1, "city", "town", None, None, None, None, 3), (2, "polygon", None, None, None, None, ring((34, 30), (36, 30), (36, 32), (34, 32)), 1), (3, "radius", None, 31.5, 35.2, 20.0, None, 1)]
    rules += [(4, "national", None, None, None, None, None, 1), (4, "polygon", None, None, None, None, star, 1), (5, "polygon", None, None, None, None, ring((34, 30), (35, 30)), 1), (6, "polygon", None, None, None, None, ring((34.99, 30.99), (35.01, 30.99), (35, 31.013)), 1), (7, "radius", None, None, None, None, None, 1)]
    rules += [(8, "city", "town", None, None, None, None, 1)]
    places = [(i, rng.choice(["town", "other", None]), round(rng.uniform(29.8, 32.2), 2) if i % 9 else None, round(rng.uniform(33.9, 36.1), 2)) for i in range(500)] + [(500, None, 30.0, 34.0), (501, None, 32.0, 36.0), (502, None, 31.0, 35.0)]

    def km(a, b, c, d):
        h = math.sin(math.radians(c - a) / 2) ** 2 + math.cos(math.radians(a)) * math.cos(math.radians(c)) * math.sin(math.radians(d - b) / 2) ** 2
        return 12742 * math.asin(min(1, math.sqrt(h)))

    want = {}
    for (i, town, lat, lng), service in itertools.product(places, range(1, 10)):
        hits, vague, own = [], False, [r for r in rules if r[0] == service]
        for _, scope, city, y, x, most, shape, trust in own:
            if scope == "national" or (scope == "city" and town == city):
                hits.append((trust, scope))
            vague |= (scope == "city" and town is None) or (scope in ("radius", "polygon") and lat is None)
            if lat is not None and ((scope == "polygon" and len(shape) > 2 and in_ring(lng, lat, shape)) or (scope == "radius" and y is not None and km(y, x, lat, lng) <= most)):
                hits.append((trust, scope))
        want[i, service] = (max(hits)[1], None) if hits else (None, "coverage_unknown" if not own else "address_too_vague" if vague else "outside")
    services = spark.createDataFrame([(i,) for i in range(1, 10)], "service_id int")
    out = delivery.coverage(spark.createDataFrame(rules, RULES), spark.createDataFrame(places, "place_id int, place_city string, place_lat double, place_lng double"), services)
    assert {(r["place_id"], r["service_id"]): (r["scope"], r["reason"]) for r in out.collect()} == want


@pytest.mark.parametrize("name", ["f15_coverage", "f15_polygon_coverage", "l5_served_by", "r17_equivalents", "r11_gate"])
def test_no_join_without_a_key(spark, sf, name):
    df = QUERIES[name](spark, sf)
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_similar_sets_equal_all_pairs_with_fewer_candidates(spark):
    rng = random.Random(5)
    pool = ["the"] * 30 + ["of"] * 15 + [f"x{i}" for i in range(60)]
    sets = [(c, i, sorted({rng.choice(pool) for _ in range(rng.randint(0, 9))})) for c in "ab" for i in range(150)]
    rows = spark.createDataFrame(sets, "c string, id int, words array<string>")
    for least in (0.5, 0.8):
        want = {(c, i, j) for (c, i, a), (d, j, b) in itertools.product(sets, sets) if c == d and i < j and a and b and 2 * len({*a} & {*b}) / (len(a) + len(b)) >= least - 1e-12}
        got = resolve.similar_sets(rows, ["c"], least)
        assert {(r["c"], r["id"], r["other"]) for r in got.collect()} == want
        joined = sum(1 for (c, i, a), (d, j, b) in itertools.product(sets, sets) if c == d and i < j and {*a} & {*b})
        node = got._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in node or "HashJoin" in node
        assert len(want) < joined


@pytest.mark.parametrize("folder", ["sf0.001", "sf0.01"])
def test_indexed_search_recalls_the_exact_scan(spark, folder, monkeypatch):
    where = f"/root/testdata/{folder}"
    exact = {(r["query_id"], r["id"]) for r in QUERIES["v2_vector_search"](spark, where).collect()}
    assert len(exact & {(r["query_id"], r["id"]) for r in QUERIES["v2_indexed_search"](spark, where).collect()}) >= 0.9 * len(exact)


def test_indexed_search_compares_fewer_pairs(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    rows = spark.createDataFrame([(i, (rng.normal(size=8) + 3 * np.eye(8)[i % 8]).tolist()) for i in range(800)] + [(900, None)], "id long, vector array<double>")
    at = vectors.centroids(rows, 16)
    lists = vectors._listed(rows, "id", at, 1).select("list", F.explode("ids").alias("id"))
    assert lists.count() == 800 and lists.select("id").distinct().count() == 800  # every row is in one list
    asked = vectors._listed(rows.where("id % 20 = 0"), "id", at, 4).select("list", F.explode("ids").alias("q"))
    assert asked.join(lists, "list").count() < 0.5 * 800 * 40
    whole = {tuple(r)[:2] for r in vectors.nearest_indexed(rows.where("id % 20 = 0").withColumnRenamed("id", "query_id"), rows, 3, 2.0, 16, 16).collect()}
    assert whole == {tuple(r)[:2] for r in vectors.nearest(rows.where("id % 20 = 0").withColumnRenamed("id", "query_id"), rows, 3, 2.0).collect()}


@pytest.mark.parametrize("name", ["v2_vector_search", "v2_indexed_search", "v3_rank_fusion", "r6_hybrid_search"])
def test_a_task_is_handed_one_pair_of_groups_at_a_time(spark, sf, name):
    """Joined blocks went to Python ten thousand pairs a batch, each with both matrices."""
    plan = QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapCoGroupsInPandas" in plan and "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan and "q_matrix" not in plan


@pytest.mark.parametrize("name", ["v3_rank_fusion", "r6_hybrid_search"])
def test_names_are_embedded_once_each(spark, sf, name):
    """The filter on vectors went below the distinct names, and the embedding with it, once a product."""
    plan = QUERIES[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString().split("\n")
    depth = [len(x) - len(x.lstrip(" :+-")) for x in plan]
    for i, x in enumerate(plan):
        if "embed(" in x and "ArrowEvalPython" in x:
            end = next((j for j in range(i + 1, len(plan)) if depth[j] <= depth[i]), len(plan))
            assert any("Aggregate" in y for y in plan[i:end])


def test_groups_of_vectors_equal_brute_force_with_ties(spark, monkeypatch):
    import numpy as np

    for size in ("QUERY_ROWS", "BLOCK_ROWS", "PIECE_ROWS", "ASKED_ROWS"):
        monkeypatch.setattr(vectors, size, 7)
    rng = np.random.default_rng(6)
    own = rng.normal(size=(30, 4))
    m = {i: own[rng.integers(30)] * rng.uniform(1, 2) for i in range(150)} | {200: own[0] * 0}
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in m.items()] + [(300, None)], "id long, vector array<double>")
    asked = rows.where("id % 20 = 0").withColumnRenamed("id", "query_id")
    near = lambda a, b: round(1 - float(a @ b) / float(np.sqrt((a @ a) * (b @ b))), 12)
    want = {(q, i, n + 1) for q in range(0, 150, 20) for n, (d, i) in enumerate(sorted((near(m[q], m[i]), i) for i in range(150) if near(m[q], m[i]) <= 0.9)[:6])}
    assert {(r["query_id"], r["id"], r["rank"]) for r in vectors.nearest(asked, rows, 6, 0.9).collect()} == want
    assert {(r["query_id"], r["id"], r["rank"]) for r in vectors.nearest_indexed(asked, rows, 6, 0.9, 5, 5).collect()} == want


def test_venues_on_the_line_of_their_area_equal_sql(spark, tmp_path):
    """Every place that a store can have, 37 times 17: by rounding fifteen of them fell on the other side."""
    import duckdb

    from basketry.plans.registry import ORACLE_SQL

    spark.range(629).selectExpr("id AS s_suppkey", "int(id % 25) AS s_nationkey", "'S' || id AS s_name").write.parquet(f"{tmp_path}/supplier.parquet")
    spark.range(629).selectExpr("id + 629 * 2 AS s_suppkey", "int(id % 25) AS s_nationkey", "'T' || id AS s_name").write.mode("append").parquet(f"{tmp_path}/supplier.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW supplier AS SELECT * FROM '{tmp_path}/supplier.parquet/*.parquet'")
    want = set(con.execute(f"SELECT store_id, reason FROM ({ORACLE_SQL['z15_venue_records']})").fetchall())
    assert set(map(tuple, QUERIES["z15_venue_records"](spark, str(tmp_path)).select("store_id", "reason").collect())) == want and len(want) == 1258


def test_an_exact_ring_has_one_side_for_its_line(spark):
    from basketry.functions import geo

    corners = [(34.0, 30.0), (35.0, 30.0), (35.0, 31.0), (34.0, 31.0)]
    ring_ = F.array(*(F.struct(F.lit(x).alias("lng"), F.lit(y).alias("lat")) for x, y in corners))
    points = [(34.5, 30.5), (35.0, 30.5), (34.0, 30.5), (34.5, 30.0), (34.5, 31.0), (33.0, 30.5), (35.5, 30.5), (34.5, 29.0), (34.5, 32.0)]
    got = spark.createDataFrame(points, "x double, y double").select("x", "y", geo.in_ring_exactly(F.col("x"), F.col("y"), ring_).alias("inside")).collect()
    assert {(r["x"], r["y"]) for r in got if r["inside"]} == {(34.5, 30.5), (35.0, 30.5), (34.5, 30.0)}
