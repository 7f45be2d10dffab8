"""Streaming jobs over bids: de-duplication, counts, clusters, soft close, enrichment.

Bids wait until the watermark has passed them and are then handled in event-time
order; what arrives later than that is dropped by Spark's watermark. The causal
features are in ``features.py``.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from gavelworks.operators.bids import SECOND

DELAY = "10 minutes"


def deduplicated(bids: DataFrame, delay: str = DELAY) -> DataFrame:
    """Each (item_id, bid_id) once, remembered until the watermark passes it."""
    return bids.withWatermark("bid_time", delay).dropDuplicatesWithinWatermark(["item_id", "bid_id"])


def window_counts(bids: DataFrame, length: str = "5 minutes", slide: str = "1 minute", delay: str = DELAY) -> DataFrame:
    """Bids per item and window on a fixed grid."""
    return (
        bids.withWatermark("bid_time", delay)
        .groupBy("item_id", F.window("bid_time", length, slide).alias("w"))
        .agg(F.count("*").alias("bids"))
        .select("item_id", F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "bids")
    )


def clusters(bids: DataFrame, gap: str = "30 seconds", delay: str = DELAY) -> DataFrame:
    """Runs of bids with no gap above ``gap``. Merging is associative, so Spark combines map-side."""
    return (
        bids.withWatermark("bid_time", delay)
        .groupBy("item_id", F.session_window("bid_time", gap).alias("w"))
        .agg(F.count("*").alias("cluster_size"), F.min("bid_time").alias("cluster_start"))
        .select("item_id", "cluster_start", "cluster_size")
    )


# ------------------------------------------------------------------ soft close

CLOSES = T.StructType(
    [
        T.StructField("item_id", T.LongType()),
        T.StructField("end_us", T.LongType()),
        T.StructField("extensions", T.LongType()),
    ]
)
_CLOSE_STATE = T.StructType(
    [
        T.StructField("end_us", T.LongType()),
        T.StructField("extensions", T.LongType()),
        T.StructField("wait_u", T.ArrayType(T.LongType())),
    ]
)


def _extend(end: int, count: int, u: int, mode: str) -> tuple[int, int]:
    two = 120 * SECOND
    if end - two <= u <= end:
        return (u if mode == "bid" else end) + two, count + 1
    return end, count


def soft_close_ends(bids: DataFrame, end: str, mode: str = "bid", delay: str = DELAY) -> DataFrame:
    """Running end and extension count per item; the last row of an item is its state.

    ``mode='bid'`` sets the end two minutes after the bid, ``mode='end'`` two
    minutes after the current end. Bids of an item whose end is not known, and
    bids without a time, extend nothing.
    """
    if mode not in ("bid", "end"):
        raise ValueError(f"unknown mode {mode!r}")

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        ends, count, waiting = (None, 0, [])
        if state.exists:
            ends, count, waiting = state.get
            waiting = list(waiting)
        for frame in frames:
            known = frame["end_us"].dropna()
            if len(known):
                ends = int(known.iloc[0]) if ends is None else ends
            waiting += frame["bid_us"].astype("int64").tolist()
        waiting.sort()
        passed = state.getCurrentWatermarkMs() * 1000
        ready = [u for u in waiting if u < passed]
        waiting = waiting[len(ready) :]
        for u in ready if ends is not None else []:
            ends, count = _extend(ends, count, u, mode)
        state.update((ends, count, waiting))
        if waiting:
            state.setTimeoutTimestamp(max(waiting[0] // 1000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame([(key[0], ends, count)] if ready else [], columns=CLOSES.names)

    ready = bids.filter(F.col("bid_time").isNotNull()).withWatermark("bid_time", delay).select(
        F.col("item_id").cast("long"),
        "bid_time",
        F.unix_micros("bid_time").alias("bid_us"),
        F.unix_micros(F.col(end)).alias("end_us"),
    )
    return ready.groupBy("item_id").applyInPandasWithState(
        step, CLOSES, _CLOSE_STATE, "update", GroupStateTimeout.EventTimeTimeout
    )


# ------------------------------------------------------------------ enrichment


def enriched(bids: DataFrame, auction_items: DataFrame, keys: tuple[str, ...] = ("auction_id", "item_id")) -> DataFrame:
    """Stream of bids joined with the static auction and item features."""
    on = [k for k in keys if k in bids.columns and k in auction_items.columns]
    if not on:
        raise ValueError("Cannot merge datasets: no common keys (auction_id, item_id)")
    shared = (set(bids.columns) & set(auction_items.columns)) - set(on)
    return bids.withColumnsRenamed({c: c + "_bid" for c in shared}).join(auction_items, on, "left")
