"""Prices as state that ends: a listing that no feed has shown for a while is delisted by a timer, and its state goes."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from basketry.operators.merge import CHANGE

OUT = "listing_id long, store_id long, event string, price double, source_ts timestamp, last_seen_at timestamp, changes int"
DAY_MS = 86_400_000


class ShelfPrice(StatefulProcessor):
    """Per listing and store: a value state with its price and times, a list state with the prices it has had, and one event-time timer."""

    def __init__(self, kept_ms: int):
        self.kept_ms = kept_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.now = handle.getValueState("now", "price double, source_ts timestamp, arrival long, last_seen_at timestamp")
        self.had = handle.getListState("had", "price double")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        before, ts, arrival, seen = self.now.get() if self.now.exists() else (None, None, None, None)
        price = before
        for batch in rows:  # in any order: the newest time counts, then the latest arrival
            top = batch.sort_values(["source_ts", "arrival"], kind="stable").iloc[-1]
            latest = batch["seen_at"].max()
            seen = latest if seen is None else max(seen, latest)
            if ts is None or (top["source_ts"], top["arrival"]) >= (ts, arrival):
                price, ts, arrival = float(top["price"]), top["source_ts"], int(top["arrival"])
        event = "listed" if before is None else "changed" if abs(price - before) > CHANGE else "seen"
        if event != "seen":
            self.had.appendValue((price,))
        self.now.update((price, ts, arrival, seen))
        for timer in self.handle.listTimers():
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(int(pd.Timestamp(seen).value // 1_000_000) + self.kept_ms)
        yield self._row(key, event)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        row = self._row(key, "delisted")
        self.now.clear()
        self.had.clear()
        yield row

    def _row(self, key: tuple, event: str) -> pd.DataFrame:
        price, ts, _, seen = self.now.get()
        return pd.DataFrame({"listing_id": [key[0]], "store_id": [key[1]], "event": [event], "price": [price], "source_ts": [ts], "last_seen_at": [seen], "changes": pd.array([sum(1 for _ in self.had.get())], dtype="int32")})

    def close(self) -> None:
        pass


def shelf_prices(observations: DataFrame, kept_days: float = 3, late: str = "1 day") -> DataFrame:
    """A stream of observations (listing_id, store_id, price, source_ts, seen_at, arrival) as events: listed, changed, seen, delisted.

    A listing that isn't seen for kept_days of event time (seen_at, which may come `late`) is delisted and forgotten; when it comes back it is listed anew. An observation
    whose source_ts is older than the state's keeps the price. `changes` counts the prices since it was listed, one a micro-batch at most. Needs the RocksDB state store (spark.sql.streaming.stateStore.providerClass).
    """
    rows = observations.select("listing_id", "store_id", "price", "source_ts", "seen_at", "arrival").withWatermark("seen_at", late)
    return rows.groupBy("listing_id", "store_id").transformWithStateInPandas(ShelfPrice(int(kept_days * DAY_MS)), OUT, "Update", "eventtime")
