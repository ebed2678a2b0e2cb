"""Price feeds as streams: the same merges as in batch, kept as state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState

from basketry.operators.merge import CHANGE

CHANGES = "listing_id long, store_id long, price double, source_ts timestamp, last_seen_at timestamp, changed boolean"


def price_updates(observations: DataFrame) -> DataFrame:
    """A stream of observations (listing_id, store_id, price, source_ts, seen_at, arrival) as a stream of current prices.

    State per listing and store is its price, time and last sight. An observation older than the state only advances last_seen_at; `changed` marks the
    rows that belong into the history. State is one row per key; the keys are spread by hash.
    """

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        price, ts, seen = state.get if state.exists else (None, None, None)
        changed = False
        for x in pd.concat(list(batches)).sort_values("arrival", kind="stable").itertuples():
            seen = x.seen_at if seen is None else max(seen, x.seen_at)
            if ts is None or x.source_ts >= ts:
                changed |= price is None or abs(x.price - price) > CHANGE
                price, ts = float(x.price), x.source_ts
        state.update((price, ts, seen))
        yield pd.DataFrame({"listing_id": [key[0]], "store_id": [key[1]], "price": [price], "source_ts": [ts], "last_seen_at": [seen], "changed": [changed]})

    rows = observations.select("listing_id", "store_id", "price", "source_ts", "seen_at", "arrival")
    return rows.groupBy("listing_id", "store_id").applyInPandasWithState(update, CHANGES, "price double, source_ts timestamp, last_seen_at timestamp", "update", "NoTimeout")


def call_counts(events: DataFrame, key: str = "api_key_id", ts: str = "created_at", late: str = "10 minutes", size: str = "60 seconds", slide: str = "10 seconds") -> DataFrame:
    """Calls per key in sliding windows, for limits; state goes once the watermark passes."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, size, slide), key).agg(F.count(F.lit(1)).alias("calls")).select(key, F.col("window.end").alias("until"), "calls")


def quarantine(rows: DataFrame, valid) -> tuple[DataFrame, DataFrame]:
    """Rows that pass a check, and those that don't with the reason, each for its own sink."""
    return rows.where(F.coalesce(valid, F.lit(False))), rows.where(~F.coalesce(valid, F.lit(False))).withColumn("reason", F.lit("invalid"))
