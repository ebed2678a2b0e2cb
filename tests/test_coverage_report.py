"""A report found once a point is that of every place there."""

from basketry.operators import delivery


def test_places_of_one_point_share_their_report(spark, monkeypatch):
    rules = spark.createDataFrame([(1, "national", None, None, None, None, 1), (2, "city", "lod", None, None, None, 3), (3, "radius", None, 32.0, 34.8, 10.0, 2)], "service_id int, scope string, city string, lat double, lng double, radius_km double, confidence int")
    services = spark.createDataFrame([(1,), (2,), (3,), (4,)], "service_id int")
    spots = [("lod", 32.0, 34.8), ("lod", None, None), (None, None, None), ("haifa", 32.8, 35.0), (None, 32.0, 34.8)]
    places = spark.createDataFrame([(i, *spots[i % len(spots)]) for i in range(40)], "place_id long, place_city string, place_lat double, place_lng double")
    asked = []
    plain = delivery.coverage
    monkeypatch.setattr(delivery, "coverage", lambda r, p, s: asked.append(p.count()) or plain(r, p, s))
    for some in (rules, rules.where("service_id > 1")):
        of = services if some is rules else services.where("service_id > 1")
        got = delivery.report_by_place(some, places, of)
        want = delivery.coverage_report(plain(some, places, of))
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.select(got.columns).collect())) and got.count() == 40
    assert asked == [len(spots)] * 2


def test_pairs_of_places_and_services_are_not_shuffled(spark, sf):
    """After a row is made per pair, nothing is joined or dealt out."""
    from basketry.plans.registry import QUERIES

    plan = QUERIES["f15_polygon_coverage"](spark, sf)._jdf.queryExecution().executedPlan().toString().split("\n")
    unfolds = next(i for i, x in enumerate(plan) if "Generate explode" in x)
    assert not any("Exchange" in x or "Join" in x for x in plan[:unfolds])


def test_a_place_that_is_listed_with_two_points_has_the_verdicts_of_each(spark):
    rules = spark.createDataFrame([(1, "radius", None, 32.0, 34.8, 10.0, 2), (None, "national", None, None, None, None, 2)], "service_id int, scope string, city string, lat double, lng double, radius_km double, confidence int")
    places = spark.createDataFrame([(1, None, 32.0, 34.8), (1, None, 30.0, 34.8), (None, None, 32.0, 34.8), (2, None, 32.0, None)], "place_id long, place_city string, place_lat double, place_lng double")
    got = delivery.coverage(rules, places, spark.createDataFrame([(1,), (2,), (1,)], "service_id int"))
    unknown = [(x, 2, False, None, "coverage_unknown") for x in (1, 1, 2, None)]
    want = [(1, 1, True, "radius", None), (1, 1, False, None, "outside"), (None, 1, True, "radius", None), (2, 1, False, None, "address_too_vague"), *unknown]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))
