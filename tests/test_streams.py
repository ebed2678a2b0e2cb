"""Streams that keep an index and that forget: crashes, repeated batches, late rows, expiry."""

import datetime

import pytest
from pyspark.sql import functions as F

from basketry.functions import vectors
from basketry.plans.queries_streams import _with_rocks
from basketry.streaming import drain, expiry

PRODUCT = "product_id long, name string, brand string, category string, queued_at int"


def run(spark, landing, folder, embed=vectors.hashed_embedding):
    stream = spark.readStream.schema(PRODUCT).parquet(landing)
    query = drain.drain(stream, folder, embed).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()


def state(spark, folder):
    index = {r["product_id"]: (r["text_hash"], r["batch"], [round(x, 9) for x in r["vector"]]) for r in drain.current(spark, folder).collect()}
    return index, {r["product_id"]: (r["attempts"], r["given_up"]) for r in drain.failing(spark, folder).collect()}


def test_drain_survives_a_crash_between_write_and_commit(spark, tmp_path, monkeypatch):
    rounds = [
        [(1, "red bolt", "a", "x", 0), (2, "old ring", "b", "x", 0), (3, None, "c", "y", 0), (1, "newer bolt", "a", "x", 1), (4, " ", None, None, 0)],
        [(1, "newer bolt", "a", "x", 2), (2, "cold ring", "b", "x", 2), (3, None, "c", "y", 2), (5, "gear", None, "z", 2)],
        [(3, "named now", "c", "y", 3), (4, "", "q", "q", 3)],
        [(4, None, None, None, 4)],
        [(4, None, None, None, 5), (3, None, "c", "y", 5)],
    ]
    for crash in (False, True):
        landing, folder = str(tmp_path / f"in{crash}"), str(tmp_path / f"out{crash}")
        for i, rows in enumerate(rounds):
            spark.createDataFrame(rows, PRODUCT).coalesce(1).write.mode("append").parquet(landing)
            if crash and i in (1, 2):
                whole = drain.drained

                def half(*args):
                    good, bad = whole(*args)
                    good.write.mode("overwrite").parquet(f"{folder}/index/batch={args[3]}")  # written, then the driver dies
                    raise RuntimeError("killed")

                monkeypatch.setattr(drain, "drained", half)
                with pytest.raises(Exception, match="killed"):
                    run(spark, landing, folder)
                monkeypatch.setattr(drain, "drained", whole)
            run(spark, landing, folder)
        if not crash:
            want = state(spark, folder)
            index, bad = want
            assert {k: v[1] for k, v in index.items()} == {1: 0, 2: 1, 3: 2, 5: 1}  # unchanged texts keep their version
            assert bad == {3: (1, False), 4: (3, True)}  # a success in between starts the count anew; the third failure is the last
        else:
            assert state(spark, folder) == want


def test_shelf_prices_expire_and_late_rows_keep_the_price(spark, tmp_path):
    at = lambda day, hour=0: datetime.datetime(2024, 1, day, hour)
    schema = "listing_id long, store_id long, price double, source_ts timestamp, seen_at timestamp, arrival long"
    batches = [
        [(1, 1, 5.0, at(1), at(1), 1), (2, 1, 3.0, at(1), at(1), 2)],
        [(1, 1, 4.0, at(1, -0), at(2), 3), (2, 1, 3.0, at(2), at(2), 4), (1, 1, 9.0, datetime.datetime(2023, 12, 1), at(2), 5)],  # the second of 1 is late: its price doesn't count
        [(1, 1, 4.0, at(8), at(8), 6)],
        [(1, 1, 4.0, at(9), at(9), 7)],
        [(2, 1, 7.0, at(10), at(10), 8)],
    ]
    landing, folder = str(tmp_path / "in"), str(tmp_path / "out")
    seen = []

    def keep(batch, number):
        seen.extend((r["listing_id"], r["event"], r["price"], r["changes"]) for r in batch.collect())

    def all_() -> None:
        for rows in batches:
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(landing)
            stream = expiry.shelf_prices(spark.readStream.schema(schema).parquet(landing), 3)
            stream.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{folder}/c").trigger(availableNow=True).start().awaitTermination()

    _with_rocks(spark, all_)
    assert seen[:2] == [(1, "listed", 5.0, 1), (2, "listed", 3.0, 1)] or seen[:2] == [(2, "listed", 3.0, 1), (1, "listed", 5.0, 1)]
    assert (1, "changed", 4.0, 2) in seen and (2, "seen", 3.0, 1) in seen
    assert (2, "delisted", 3.0, 1) in seen  # not seen since the second day
    assert seen[-1] == (2, "listed", 7.0, 1)  # forgotten, so listed anew with no price from before
    assert sum(e[1] == "delisted" and e[0] == 1 for e in seen) <= 1
