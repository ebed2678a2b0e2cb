"""The feed data source, the raw archive, venues."""

import datetime
import gzip
import zipfile

import pytest
from pyspark.sql import functions as F

from basketry.sources import archive, feed_source, feeds, marketplace

HEAD = "<ChainId>7290000000001</ChainId>"
ITEM = "<Item><ItemCode>{0}</ItemCode><ItemType>1</ItemType><ItemName>{1}</ItemName><Quantity>1</Quantity><UnitQty>kg</UnitQty><ItemPrice>{2}</ItemPrice><bIsWeighted>0</bIsWeighted></Item>"


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    out = tmp_path_factory.mktemp("landed")
    items = ITEM.format("729000000042", "שמן זית", "9.90") + ITEM.format("729000000059", "Tea &amp; mint", "5") + "<Item><ItemCode>1</ItemCode></Item>"
    root = f'<?xml version="1.0" encoding="windows-1255"?><Root>{HEAD}<StoreId>7</StoreId><Items>{items}</Items></Root>'
    (out / "PriceFull7290000000001-007-20240115-0300.gz").write_bytes(gzip.compress(root.encode("windows-1255")))
    with zipfile.ZipFile(out / "PriceFull7290000000001-008-20240115-0300.zip", "w") as z:
        z.writestr("x.xml", root.replace("windows-1255", "utf-8").replace("<StoreId>7", "<StoreId>8"))
    (out / "Price7290000000001-009-20240115-0400.xml").write_bytes(f"<Prices>{HEAD}<Products>{items.replace('Item>', 'Product>')}</Products></Prices>".encode("utf-16"))
    (out / "PromoFull7290000000001-007-20240115-0300.xml").write_text(
        f"<Root>{HEAD}<StoreId>007</StoreId><Promotions><Promotion><PromotionId>5</PromotionId><PromotionDescription>2 for 30</PromotionDescription><Groups><Group><PromotionItems><PromotionItem><ItemCode>42</ItemCode></PromotionItem></PromotionItems></Group><Group><PromotionItems><PromotionItem><ItemCode>0</ItemCode></PromotionItem>"
        "<PromotionItem><ItemCode>41</ItemCode></PromotionItem></PromotionItems></Group></Groups></Promotion><Promotion><PromotionId>6</PromotionId><PromotionItems><Item><ItemCode>7</ItemCode></Item></PromotionItems></Promotion></Promotions></Root>"
    )
    (out / "Stores7290000000001-000-20240115.xml").write_text(f"<Store><Branches><Branch><StoreId>1</StoreId></Branch></Branches></Store>".replace("<Store>", "<Root>").replace("</Store>", "</Root>").replace("Branch>", "Store>").replace("<Storees>", "<Branches>").replace("</Storees>", "</Branches>"))
    (out / "_SUCCESS").write_text("")
    return str(out)


def test_feeds_of_any_packing_and_nesting(spark, folder):
    rows = feed_source.read(spark, folder)
    got = {(r["store_code"], r["item_code"]): r for r in feed_source.prices(rows).collect()}
    assert set(got) == {(s, i) for s in ("007", "008", "009") for i in ("729000000042", "729000000059")}
    assert all(r["name"] == "שמן זית" and r["price"] == 9.9 and r["size_qty"] == 1000.0 for (_, i), r in got.items() if i == "729000000042")
    promos = {r["promo_code"]: r["item_codes"] for r in feed_source.promotions(rows).collect()}
    assert promos == {"5": ["41", "42"], "6": ["7"]}
    assert {r["store_code"] for r in feed_source.stores(rows).collect()} == {"001"}


def test_same_rows_as_the_xml_reader(spark, tmp_path):
    text = f"<Root>{HEAD}<StoreId>7</StoreId><Items>{''.join(ITEM.format(729000000000 + i, f'name {i}', i + 1) for i in range(300))}</Items></Root>"
    (tmp_path / "PriceFull7290000000001-007-20240115-0300.xml").write_text(text)
    a = feeds.read_prices(spark, f"{tmp_path}/*.xml").drop("file")
    assert sorted(map(tuple, a.collect()), key=str) == sorted(map(tuple, feed_source.prices(feed_source.read(spark, str(tmp_path))).drop("file").collect()), key=str)


def test_filters_leave_files_unread(folder):
    from pyspark.sql.datasource import EqualTo, In

    reader = feed_source.FeedReader(f"file://{folder}")
    list(reader.pushFilters([In(("kind",), ("price", "pricefull")), EqualTo(("store_code",), "009")]))
    assert [p.rsplit("/", 1)[1] for x in reader.partitions() for p in x.paths] == ["Price7290000000001-009-20240115-0400.xml"]
    assert len([p for x in feed_source.FeedReader(f"file://{folder}").partitions() for p in x.paths]) == 5


def test_filtered_read_equals_filter_of_all(spark, folder):
    rows = feed_source.read(spark, folder)
    assert rows.where("kind = 'pricefull'").count() == 6 and rows.where("kind = 'pricefull' AND store_code = '008'").count() == 3 and rows.where("chain_code = '1'").count() == 0


def test_archive_keeps_each_content_once(spark, tmp_path):
    root, day = str(tmp_path / "archive"), datetime.date(2024, 1, 1)
    files = lambda *rows: spark.createDataFrame([(s, p, day, bytearray(c)) for s, p, c in rows], "source string, path string, day date, content binary")
    first = files(("a", "../x/one.gz", b"1"), ("a", "two.gz", b"1"), ("b", "one.gz", b"2"))
    for landing in ("1", "1", "2"):  # run again as itself, then as another
        archive.land(first, root, landing)
    assert archive.blobs(spark, root).count() == 2 and archive.manifest(spark, root).count() == 3
    assert archive.manifest(spark, root).where("landing = '2'").count() == 0
    archive.land(files(("a", "two.gz", b"3"), ("a", "three.gz", b"2")), root, "3")
    assert archive.blobs(spark, root).where("landing = '3'").count() == 1
    assert {(r["source"], r["file_name"], bytes(r["content"])) for r in archive.contents(spark, root).collect()} == {("a", "one.gz", b"1"), ("a", "two.gz", b"1"), ("b", "one.gz", b"2"), ("a", "two.gz", b"3"), ("a", "three.gz", b"2")}
    for bad in ("x/..", "", "a\\..", "dir/"):
        with pytest.raises(ValueError, match="not a file name"):
            archive.land(files(("a", bad, b"1")), root, "4")


def test_venues(spark):
    html = '<script>{"delivery_base_price": 1500, "name": "Shop", "slug": "shop", "info": {"order_minimum": "min 80.5"}, "delivery_geo_range": {"type": "MultiPolygon", "coordinates": [[[[34, 31], [35, 31], [35, 32]]]]}}</script>'
    rows = spark.createDataFrame([(1, html), (2, "none"), (3, None), (4, '{"delivery_base_price": null, "name": "No fee"}')], "page_id long, html string")
    stores, tariffs, rules = marketplace.venue_terms(marketplace.read_venues(rows))
    assert {tuple(r) for r in stores.collect()} == {(1, "Shop", "online", 80.5), (4, "No fee", "online", None)}
    assert [(r["service_id"], r["fee"], r["is_floor"]) for r in tariffs.collect()] == [(1, 15.0, True)]
    (rule,) = rules.collect()
    assert rule["service_id"] == 1 and [(p["lng"], p["lat"]) for p in rule["ring"]] == [(34.0, 31.0), (35.0, 31.0), (35.0, 32.0)]


def test_feeds_are_written_compressed_and_packed_by_their_text(spark, sf, tmp_path, monkeypatch):
    from basketry.plans import queries_sources
    from basketry.plans.registry import QUERIES

    monkeypatch.setattr(queries_sources, "fresh_path", lambda spark, name: f"file://{tmp_path}/{name}")
    assert QUERIES["s1_s6_feed_source"](spark, sf).count() > 0
    files = [x for x in (tmp_path / "feeds").rglob("part-*")]
    assert files and all(x.name.endswith(".gz") for x in files)
    monkeypatch.setattr(feed_source, "PACKED", 25 * max(x.stat().st_size for x in files))
    assert max(len(p.paths) for p in feed_source.FeedReader(f"file://{tmp_path}/feeds").partitions()) < 2 + 3 * max(x.stat().st_size for x in files) / min(x.stat().st_size for x in files)
