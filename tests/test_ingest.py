"""Feeds, merges and streams."""

import datetime as dt
import gzip
import random

import pytest
from pyspark.sql import functions as F

from basketry.operators import basket, merge
from basketry.sources import feeds, marketplace
from basketry.streaming import prices as stream

PRICES = """<?xml version="1.0" encoding="UTF-8"?><Root><ChainId>7290000000001</ChainId><StoreId>7</StoreId><Items>
<Item><ItemCode>0729000000042</ItemCode><ItemType>1</ItemType><ItemName>Olive  oil &amp; herbs</ItemName><Quantity>1,5</Quantity><UnitQty>liter</UnitQty><ItemPrice>30.00</ItemPrice><bIsWeighted>0</bIsWeighted><AllowDiscount>1</AllowDiscount><PriceUpdateDate>2024-01-15 10:00:00</PriceUpdateDate></Item>
<Item><ItemCode>0012</ItemCode><ItemType>0</ItemType><ItemName>Tomato</ItemName><Quantity>0</Quantity><UnitQty>kg</UnitQty><ItemPrice>6.9</ItemPrice><bIsWeighted>1</bIsWeighted><AllowDiscount>0</AllowDiscount><PriceUpdateDate>bad</PriceUpdateDate></Item>
<Item><ItemCode>13</ItemCode><ItemType>0</ItemType><ItemName>No price</ItemName></Item></Items></Root>"""
STORES = """<Root><ChainId>7290000000001</ChainId><SubChains><SubChain><Stores><Store><StoreId>7</StoreId><StoreName>Main</StoreName><Address>1&#x0D; Road</Address><City>0</City><StoreType>1</StoreType></Store>
<Store><StoreId>0008</StoreId><StoreName>Online shop</StoreName><City>Haifa</City><StoreType>2</StoreType></Store></Stores></SubChain></SubChains></Root>"""
PROMOS = """<Root><ChainId>7290000000001</ChainId><StoreId>007</StoreId><Promotions><Promotion><PromotionId>5</PromotionId><PromotionDescription>2 for 30</PromotionDescription>
<PromotionStartDate>2024-01-01</PromotionStartDate><PromotionStartHour>00:00</PromotionStartHour><PromotionEndDate>2023-01-01</PromotionEndDate><Groups><Group><PromotionItems><PromotionItem><ItemCode>0000</ItemCode></PromotionItem><PromotionItem><ItemCode>42</ItemCode></PromotionItem></PromotionItems></Group></Groups></Promotion>
<Promotion><PromotionId>6</PromotionId><PromotionItems><Item><ItemCode>7</ItemCode></Item><Item><ItemCode>7</ItemCode></Item></PromotionItems><DiscountRate>10</DiscountRate></Promotion></Promotions></Root>"""


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    out = tmp_path_factory.mktemp("feeds")
    for name, text in (("PriceFull7290000000001-007-20240115-0300.xml", PRICES), ("Stores7290000000001-000-20240115.xml", STORES), ("PromoFull7290000000001-007-20240115-0300.xml", PROMOS)):
        (out / name).write_text(text)
    (out / "packed").mkdir()
    (out / "packed" / "PriceFull7290000000001-007-20240115-0300.gz").write_bytes(gzip.compress(PRICES.encode("windows-1255")))
    return out


def test_prices(spark, folder):
    rows = {r["item_code"]: r for r in feeds.read_prices(spark, f"{folder}/PriceFull*.xml").collect()}
    assert set(rows) == {"729000000042", "0012"}
    oil, tomato = rows["729000000042"], rows["0012"]
    assert (oil["is_gtin"], oil["name"], oil["size_qty"], oil["size_unit"], oil["unit_price"], oil["store_code"]) == (True, "Olive oil & herbs", 1500.0, "ml", 2.0, "007")
    assert oil["source_ts"] == dt.datetime(2024, 1, 15, 8)
    assert (tomato["is_gtin"], tomato["size_qty"], tomato["size_unit"], tomato["source_ts"]) == (False, 1000.0, "g", None)


def test_stores_and_promotions(spark, folder):
    stores = {r["store_code"]: r for r in feeds.read_stores(spark, f"{folder}/Stores*.xml").collect()}
    assert (stores["007"]["address"], stores["007"]["city"], stores["007"]["store_kind"], stores["008"]["store_kind"]) == ("1 Road", None, "branch", "online")
    promos = {r["promo_code"]: r for r in feeds.read_promotions(spark, f"{folder}/PromoFull*.xml").collect()}
    assert promos["5"]["item_codes"] == ["42"] and promos["6"]["item_codes"] == ["7"]
    assert promos["5"]["mechanic"]["kind"] == "n_for_price" and promos["6"]["mechanic"]["rate"] == 10.0
    assert promos["5"]["end_ts"].year == 2099 and promos["6"]["start_ts"].year in (1999, 2000)


def test_packed_files(spark, folder, tmp_path):
    out = feeds.unpacked(spark, f"{folder}/packed", str(tmp_path / "plain"))
    assert feeds.read_prices(spark, out).count() == 2


def test_marketplace_items(spark):
    html = 'x <script>var a = {"item": {"name": "Milk \\"1%\\"", "barcode": "729", "price": 590}}; var b = {"price": 100};</script> {"name": "Tea", "price": 1250'
    html += '} {"name": "Milk", "barcode": "729", "price": 610}'
    rows = marketplace.read_items(spark.createDataFrame([(1, html), (2, None)], "page_id long, html string")).collect()
    assert sorted((r["name"], r["barcode"], r["price"]) for r in rows) == [('Milk "1%"', "729", 5.9), ("Tea", None, 12.5)]


def observations(n=300, seed=3):
    rng = random.Random(seed)
    day = dt.datetime(2024, 1, 1)
    return [(rng.randint(1, 5), rng.randint(1, 3), round(rng.choice([1.0, 2.0, 2.0001, 3.5]), 4), day + dt.timedelta(days=rng.randint(0, 30)), day + dt.timedelta(days=i), i) for i in range(n)]


SCHEMA = "listing_id long, store_id long, price double, source_ts timestamp, seen_at timestamp, arrival long"


def folded(rows):
    """The merge row by row, in order of arrival, with what belongs into the history."""
    state, history = {}, []
    for listing, store, price, ts, seen, arrival in rows:
        old = state.get((listing, store))
        if old is None or ts >= old[1]:
            if old is None or abs(price - old[0]) > merge.CHANGE:
                history.append((listing, store, price, arrival))
            state[listing, store] = (price, ts, seen)
        else:
            state[listing, store] = (*old[:2], max(old[2], seen))
    return state, history


def test_price_merge_is_the_fold(spark):
    rows = observations()
    df = spark.createDataFrame(rows, SCHEMA)
    state, _ = folded(rows)
    got = {(r["listing_id"], r["store_id"]): (r["price"], r["source_ts"], r["last_seen_at"]) for r in merge.store_prices(df.where("arrival < 100"), df.where("arrival >= 100")).collect()}
    assert got == state


def test_price_history_is_the_fold(spark):
    rows = observations()
    _, history = folded(rows)
    got = merge.price_changes(spark.createDataFrame(rows, SCHEMA)).select("listing_id", "store_id", "price", "arrival").collect()
    # the fold compares with the last kept price, the window with the previous kept row; they differ only in steps below the threshold
    assert sorted(map(tuple, got)) == sorted(history)


def test_streamed_prices_equal_the_batch_merge(spark, tmp_path):
    rows = observations()
    for i in range(3):
        spark.createDataFrame(rows[i * 100 : i * 100 + 100], SCHEMA).coalesce(1).write.parquet(str(tmp_path / "in" / f"batch={i}"))
    source = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    got: dict = {}

    def keep(df, _):
        got.update({(r["listing_id"], r["store_id"]): (r["price"], r["source_ts"], r["last_seen_at"]) for r in df.collect()})

    q = stream.price_updates(source).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    q.stop()
    # files come in no fixed order, so every batch is one arrival order; prices are by source time and last sights by maximum
    best = {}
    for listing, store, price, ts, seen, arrival in rows:
        best.setdefault((listing, store), []).append((ts, price, seen))
    assert set(got) == set(best)
    for key, values in best.items():
        assert got[key][1] == max(v[0] for v in values) and got[key][2] == max(v[2] for v in values)


def test_windowed_calls(spark, tmp_path):
    base = dt.datetime(2024, 1, 1)
    spark.createDataFrame([(1, base), (1, base + dt.timedelta(seconds=30)), (2, base)], "api_key_id long, created_at timestamp").write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema("api_key_id long, created_at timestamp").parquet(str(tmp_path / "in"))
    q = stream.call_counts(source).writeStream.outputMode("complete").format("memory").queryName("calls").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.sql("SELECT max(calls) FROM calls WHERE api_key_id = 1").first()[0] == 2
    q.stop()


def test_reconcile_guards(spark):
    day = dt.datetime(2024, 1, 1)
    rows = [(s, i, day if i < stale else day + dt.timedelta(days=2)) for s, stale in ((1, 2), (2, 8), (3, 2)) for i in range(10)]
    current = spark.createDataFrame(rows, "store_id long, listing_id long, last_seen_at timestamp")
    full = spark.createDataFrame([(1, day + dt.timedelta(days=1), 60), (2, day + dt.timedelta(days=1), 60), (3, day + dt.timedelta(days=1), 10)], "store_id long, seen_since timestamp, rows_seen int")
    left = {r["store_id"]: r["count"] for r in merge.reconcile(current, full).groupBy("store_id").count().collect()}
    assert left == {1: 8, 2: 10, 3: 10}
    report = {r["store_id"]: r["verdict"] for r in merge.reconcile_report(current, full).collect()}
    assert report == {1: "deleted", 2: "too_many_stale", 3: "too_few_rows"}


def test_keep_list_refuses_nothing(spark):
    old = spark.createDataFrame([(1,), (2,)], "slug long")
    some, none = spark.createDataFrame([(1,)], "slug long"), spark.createDataFrame([], "slug long")
    assert {tuple(r) for r in merge.kept_only(old, some, "slug").collect()} == {(1, True), (2, False)}
    assert {tuple(r) for r in merge.kept_only(old, none, "slug").collect()} == {(1, True), (2, True)}
    idle = old.withColumn("active", F.col("slug") == 1).withColumn("feed", F.lit("b"))
    assert {(r["slug"], r["active"]) for r in merge.kept_only(idle, none, "slug").collect()} == {(1, True), (2, False)}
    assert {(r["slug"], r["active"]) for r in merge.kept_only(idle, some, "slug", F.col("feed") == "a").collect()} == {(1, True), (2, False)}


def test_multi_store_plan(spark):
    lines = [(1, 10, 1, 5.0), (1, 11, 1, 100.0), (1, 10, 2, 6.0), (1, 11, 2, 40.0), (1, 12, 3, 7.0), (1, 12, 1, 9.0)]
    priced = spark.createDataFrame(lines, "basket_id long, product_id long, store_id long, line_total double")
    ways = spark.createDataFrame([(1, 1.0), (2, 1.0), (3, 50.0)], "store_id long, km double")
    got = {(r["product_id"], r["store_id"], r["line_total"]) for r in basket.multi_store(priced, ways).collect()}
    assert got == {(10, 1, 5.0), (11, 2, 40.0), (12, 1, 9.0)}  # store 1 covers all; store 2 saves 60; store 3 would save 2


def test_candidate_fold_depends_on_order(spark):
    rows = [(1, 0, 100, 5.0, 50.0), (1, 1, 101, 4.0, 60.0), (1, 2, 102, None, 55.0), (1, 3, 103, 3.0, 70.0)]
    df = spark.createDataFrame(rows, "line long, candidate_rank int, candidate_id long, unit_price double, line_total double")
    # 101 by unit price, then 102 by total, as it has no unit price, then 103 loses to it by total
    assert basket.cheapest_candidate(df, ["line"]).first()["candidate_id"] == 102


def test_decoding():
    assert feeds.decoded("שלום".encode("windows-1255")) == "שלום"
    assert feeds.decoded("שלום".encode("utf-16")) == "שלום"


def test_file_facts(spark):
    df = spark.createDataFrame([("PriceFull7290027600007-7-20240115-0300.gz",)], "p string")
    r = df.select(*feeds.file_facts(F.col("p"))).first()
    assert tuple(r) == ("pricefull", "7290027600007", "007", "202401150300")


def test_multi_store_plans_equal_plain_choices(spark):
    """Every basket against the same rule told in plain loops, with baskets that run over batches."""
    rng = random.Random(12)
    ways = [(s, None if s == 3 else float(s)) for s in range(9)]
    rows = [(b, p, s, round(rng.uniform(1, 30), 2)) for b in range(60) for p in rng.sample(range(40), rng.randint(1, 12)) for s in rng.sample(range(9), rng.randint(1, 9))] + [(None, 1, 1, 1.0)]
    want = {}
    for b in range(60):
        cost = {(p, s): t for bb, p, s, t in rows if bb == b}
        lines, stores = sorted({p for p, _ in cost}), sorted({s for _, s in cost})
        km = {s: (50.0 if k is None else k) * 0.5 * 2 for s, k in ways}
        chosen, left = [], set(lines)
        while left:
            free = [s for s in stores if s not in chosen]
            new = {s: sum((p, s) in cost for p in left) for s in free}
            top = [s for s in free if new[s] == max(new.values())]
            s = min(top, key=lambda s: (round(sum(cost.get((p, s), 0) for p in left) + (km[s] if chosen else 0), 6), s))
            chosen.append(s)
            left -= {p for p in left if (p, s) in cost}
        while len(chosen) < basket.STOPS:
            now = {p: min(cost[p, s] for s in chosen if (p, s) in cost) for p in lines}
            gain = {s: sum(max(0, now[p] - cost.get((p, s), 1e9)) for p in lines) for s in stores if s not in chosen}
            nets = {s: g - km[s] for s, g in gain.items() if g >= basket.SAVING}
            if not nets or max(nets.values()) <= 0:
                break
            chosen.append(max(nets, key=lambda s: (nets[s], -s)))
        want[b] = {(p, round(min(cost[p, s] for s in chosen if (p, s) in cost), 6)) for p in lines}, len(chosen)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        got = basket.multi_store(spark.createDataFrame(rows, "basket_id long, product_id long, store_id long, line_total double"), spark.createDataFrame(ways, "store_id long, km double"), 0.5).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    by = {}
    for r in got:
        by.setdefault(r["basket_id"], [set(), r["stops"]])[0].add((r["product_id"], round(r["line_total"], 6)))
    assert {b: (lines, n) for b, (lines, n) in by.items()} == want


def test_plan_of_several_stores_in_one_row(spark):
    lines = spark.createDataFrame([(1, 10, 7, 2.5, 2), (1, 11, 7, 1.25, 2), (1, 12, 8, 4.0, 2)], basket.PLAN)
    ways = spark.createDataFrame([(7, 3.0), (8, None)], "store_id long, km double")
    asked = spark.createDataFrame([(1, 4), (2, 3)], "basket_id long, asked_lines long")
    got = {r["basket_id"]: r for r in basket.multi_plan(lines, ways, asked).collect()}
    assert (got[1]["total"], got[1]["store_count"], got[1]["max_km"], got[1]["priced_lines"], got[1]["missing_lines"]) == (7.75, 2, 3.0, 3, 1)
    assert [tuple(s) for s in got[1]["stops"]] == [(7, 3.75, 2), (8, 4.0, 1)]
    assert (got[2]["total"], got[2]["priced_lines"], got[2]["missing_lines"], got[2]["stops"]) == (None, 0, 3, None)
