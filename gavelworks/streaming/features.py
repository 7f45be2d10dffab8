"""Causal bid features as a stream, on keyed state in RocksDB.

A bid waits in list state until the watermark has passed it; a timer then takes the item's due bids in event-time order
through its scalars. The features are the batch's own projections over the same working columns, so no rule
is written twice. Running rank and median need the whole history of an item and stay in the batch.

State is appended to and read per item, never rewritten as a whole: a trigger that brings an item new bids appends them,
and only what falls due is folded. Every call of the state is a question to the executor and an answer, which costs more
than the bids of an ordinary item; so scalars and bids are one list state, whose values hold up to ``MOST`` bids each. The times of the last ten minutes are the only history that is kept. Given the time at
which an item ends, its state is removed when the watermark passes that, and bids after their item's end are left out.

A missing amount is skipped as in the batch, and bids without an item are an item like any other. A bid without a time
has no place in a stream and is left out.
"""

from __future__ import annotations

import math
import struct
from array import array
from bisect import bisect_left
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from gavelworks.operators.bids import CLUSTER_GAP, DECAY, GROUPS, SECOND, N, PREV_A, PREV_U, U, finish, increment

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
DELAY = "10 minutes"
# Bids in one value of list state.
MOST = 10_000
# Need the whole history of an item.
NOT_IN_STREAM = ("bid_amount_percentile_so_far", "bid_amount_relative_to_median")
_LONG, _DOUBLE = T.LongType(), T.DoubleType()

# Names of the frames that come begin with a letter, as their rows become named tuples.
_BID = {"bid_id": _LONG, "bid_us": _LONG, "bid_amount": _DOUBLE, "is_proxy_bid": _LONG, "bid_number": _LONG}
_WORKING = {
    N: _LONG,
    PREV_U: _LONG,
    "_first_u": _LONG,
    "_max_u": _LONG,
    PREV_A: _DOUBLE,
    "_mean_a": _DOUBLE,
    "_max_a": _DOUBLE,
    "_first_a": _DOUBLE,
    "_prev_a2": _DOUBLE,
    "_sum_inc": _DOUBLE,
    "_mean_inc_5": _DOUBLE,
    "_max_number": _LONG,
    "_cluster_u": _LONG,
    "_cluster_n": _LONG,
    "_before_60": _LONG,
    "_before_300": _LONG,
    "_before_600": _LONG,
    "_decayed": _DOUBLE,
}
_SCALARS = {
    "n": _LONG,
    "first_u": _LONG,
    "last_u": _LONG,
    "first_a": _DOUBLE,
    "last_a": _DOUBLE,
    "before_last_a": _DOUBLE,
    "known_a": _LONG,
    "sum_a": _DOUBLE,
    "max_a": _DOUBLE,
    "known_inc": _LONG,
    "sum_inc": _DOUBLE,
    "max_number": _LONG,
    "cluster_u": _LONG,
    "cluster_n": _LONG,
    "decayed": _DOUBLE,
} | {f"inc_{i}": _DOUBLE for i in range(5)}  # the last five increments


def _struct(fields: dict[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


def _known(value):
    """None for every kind of missing value that pandas has."""
    return None if value is None or value != value or value is pd.NA else value


class _Packed:
    """Rows of these fields as bytes: which values are known, and the values."""

    def __init__(self, fields: dict[str, T.DataType]):
        self.kinds = [float if kind == _DOUBLE else int for kind in fields.values()]
        self.line = struct.Struct("<q" + "".join("d" if kind is float else "q" for kind in self.kinds))

    def pack(self, row: Sequence) -> bytes:
        known = sum(1 << i for i, value in enumerate(row) if value is not None)
        return self.line.pack(known, *[0 if value is None else kind(value) for kind, value in zip(self.kinds, row)])

    def unpack(self, data: bytes) -> Iterator[tuple]:
        for known, *row in self.line.iter_unpack(data):
            yield tuple(value if known >> i & 1 else None for i, value in enumerate(row))


_BIDS, _STATE = _Packed(_BID), _Packed(_SCALARS)


class Running:
    """An item so far: the scalars that the working columns of its next bid need."""

    def __init__(self, state: bytes | None):
        values = (0, *[None] * 5, 0, 0.0, None, 0, 0.0, *[None] * 3, 0.0, *[None] * 5)
        if state is not None:
            (values,) = _STATE.unpack(state[: _STATE.line.size])
        for name, value in zip(_SCALARS, values):
            setattr(self, name, value)
        self.last_incs = list(values[-5:])[: min(self.n, 5)]
        self.recent = list(array("q", b"" if state is None else state[_STATE.line.size :]))

    def state(self) -> bytes:
        scalars = [getattr(self, name) for name in list(_SCALARS)[:-5]]
        incs = self.last_incs + [None] * (5 - len(self.last_incs))
        return _STATE.pack([*scalars, *incs]) + array("q", self.recent).tobytes()

    def advance(self, u: int, amount: float | None, number: int | None) -> tuple:
        """Take one more bid; the values of its working columns."""
        previous_u, previous_a, previous_a2 = self.last_u, self.last_a, self.before_last_a
        self.n += 1
        if self.n == 1:
            self.first_u, self.first_a, step = u, amount, amount
            self.cluster_u, self.cluster_n, self.decayed = u, 1, 1.0
        else:
            step = None if amount is None or previous_a is None else amount - previous_a
            self.decayed = 1.0 + self.decayed * math.exp(-DECAY * (u - previous_u) / SECOND)
            if u - previous_u > CLUSTER_GAP:
                self.cluster_u, self.cluster_n = u, self.n
        self.last_u, self.last_a, self.before_last_a = u, amount, previous_a
        if amount is not None:
            self.known_a, self.sum_a = self.known_a + 1, self.sum_a + amount
            self.max_a = amount if self.max_a is None else max(self.max_a, amount)
        if step is not None:
            self.known_inc, self.sum_inc = self.known_inc + 1, self.sum_inc + step
        if number is not None:
            self.max_number = number if self.max_number is None else max(self.max_number, number)
        self.last_incs = [*self.last_incs, step][-5:]
        steps = [s for s in self.last_incs if s is not None]
        self.recent.append(u)
        del self.recent[: bisect_left(self.recent, u - 600 * SECOND)]
        older = self.n - len(self.recent)
        before = [older + bisect_left(self.recent, u - s * SECOND) for s in (60, 300, 600)]
        return (
            self.n,
            previous_u,
            self.first_u,
            u,
            previous_a,
            self.sum_a / self.known_a if self.known_a else None,
            self.max_a,
            self.first_a,
            previous_a2,
            self.sum_inc if self.known_inc else None,
            sum(steps) / len(steps) if steps else None,
            self.max_number,
            self.cluster_u,
            self.cluster_n,
            *before,
            self.decayed,
        )


class BidState(StatefulProcessor):
    """Working columns of each bid, once the watermark has passed it.

    An item's next timer and its end are only kept if items have ends; else a trigger sets a timer of its own for its first
    bid, and one that finds nothing due does nothing.
    """

    def __init__(self, ends: bool):
        self.ends = ends

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # Waiting bids; the first value also has the scalars, from the item's first due bid on.
        self.item = handle.getListState("item", _struct({"running": T.BinaryType(), "bids": T.BinaryType()}))
        # The timer that is set, and when the item ends.
        self.clock = handle.getValueState("clock", _struct({"due": _LONG, "end": _LONG})) if self.ends else None

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        due, end = (self.clock.get() if self.ends else None) or (None, None)
        soonest = due
        for frame in rows:
            if not len(frame):
                continue
            bids = [tuple(_known(v) for v in row) for row in zip(*[frame[c].tolist() for c in _BID])]
            self.item.appendList(_values(None, bids))
            first = min(bid[1] for bid in bids) // 1000
            soonest = int(first if soonest is None else min(soonest, first))
            ends = [e for e in map(_known, frame["end_ms"].tolist()) if e is not None] if self.ends else []
            if ends:
                end = int(max([*ends, *([] if end is None else [end])]))
        self._set(due, soonest, end)
        return iter([])

    def _set(self, due: int | None, soonest: int | None, end: int | None) -> None:
        if soonest is not None and soonest != due:
            if due is not None:
                self.handle.deleteTimer(due)
            self.handle.registerTimer(soonest)
        if self.ends:
            self.clock.update((soonest, end))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        end = self.clock.get()[1] if self.ends else None
        values = list(self.item.get())
        waiting = sorted(
            (bid for _, bids in values for bid in _BIDS.unpack(bytes(bids))), key=lambda bid: (bid[1], bid[0])
        )
        ready = [bid for bid in waiting if bid[1] < passed]
        waiting = waiting[len(ready) :]
        if ready:
            held = values[0][0]
            item = Running(None if held is None else bytes(held))
            done = [(*bid, *item.advance(bid[1], bid[2], bid[4])) for bid in ready]
            self.item.put(_values(item.state(), waiting))
            yield _frame(key, done)
        if waiting:
            self._set(None, waiting[0][1] // 1000, end)
            return
        if not self.ends:
            return
        if end is None or end >= passed // 1000:
            self._set(None, end, end)  # by then nothing may wait
            return
        for state in (self.item, self.clock):
            state.clear()

    def close(self) -> None:
        pass


def _values(running: bytes | None, bids: list[tuple]) -> list[tuple]:
    """An item's values of list state."""
    lines = [_BIDS.pack(bid) for bid in bids]
    parts = [b"".join(lines[at : at + MOST]) for at in range(0, max(1, len(lines)), MOST)]
    return [(running if i == 0 else None, part) for i, part in enumerate(parts)]


_COLUMNS = _BID | _WORKING
_LONGS, _DOUBLES = ([name for name, kind in _COLUMNS.items() if kind == wanted] for wanted in (_LONG, _DOUBLE))
_PLACES = [[i for i, name in enumerate(_COLUMNS) if name in names] for names in (_LONGS, _DOUBLES)]


def _frame(key: tuple, rows: list[tuple]) -> pd.DataFrame:
    """A bid's columns as two lists, as every column of each item's frame is converted by itself, which costs far more."""
    no_item, item = key
    # A missing item is a flag beside the key, as a key itself may not be missing.
    longs, doubles = ([[row[i] for i in places] for row in rows] for places in _PLACES)
    item = pd.array([None if no_item else item] * len(rows), dtype="Int64")
    return pd.DataFrame({"item_id": item, "longs": longs, "doubles": doubles})


def use_state_store(spark) -> None:
    """Keyed state of several kinds for an item is kept in RocksDB."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def causal_features(bids: DataFrame, delay: str = DELAY, end: str | None = None) -> DataFrame:
    """Each bid with the batch's features, but for rank and median, once the watermark has passed it.

    ``end`` may name a column with the time after which an item gets no bids any more.
    """
    use_state_store(bids.sparkSession)
    optional = {c: F.col(c).cast("long") if c in bids.columns else F.lit(None).cast("long") for c in ("is_proxy_bid", "bid_number")}
    ready = (
        bids.filter(F.col("bid_time").isNotNull())
        .withWatermark("bid_time", delay)
        .select(
            F.col("item_id").isNull().cast("int").alias("no_item"),
            F.coalesce(F.col("item_id").cast("long"), F.lit(0)).alias("item"),
            "bid_time",
            F.col("bid_id").cast("long").alias("bid_id"),
            F.unix_micros("bid_time").alias("bid_us"),
            F.col("bid_amount").cast("double").alias("bid_amount"),
            *[c.alias(name) for name, c in optional.items()],
            (F.unix_millis(F.col(end)) if end else F.lit(None).cast("long")).alias("end_ms"),
        )
    )
    fields = {"item_id": _LONG, "longs": T.ArrayType(_LONG), "doubles": T.ArrayType(_DOUBLE)}
    ready = ready.filter(F.col("end_ms").isNull() | (F.unix_millis("bid_time") <= F.col("end_ms")))
    state = BidState(end is not None)
    working = ready.groupBy("no_item", "item").transformWithStateInPandas(state, _struct(fields), "append", "EventTime")
    listed = {name: F.col(part)[i] for part, names in (("longs", _LONGS), ("doubles", _DOUBLES)) for i, name in enumerate(names)}
    working = working.select("item_id", *[listed[name].alias(U if name == "bid_us" else name) for name in _COLUMNS])
    numbered = "bid_number" in bids.columns
    original = ["item_id", "bid_id", U, "bid_amount", "is_proxy_bid", *(["bid_number"] if numbered else [])]
    working = working.withColumn("bid_increment", increment()).withColumns(
        {c: F.lit(None).cast("double") for c in ("_not_above", "_known_a", "_median_a")}
    )
    if not numbered:
        working = working.withColumns({"bid_number": F.col(N), "_max_number": F.col(N)})
    out = finish(working, working.select(*original), GROUPS, None)
    return out.drop(*NOT_IN_STREAM, "bid_amount", "is_proxy_bid").withColumnRenamed(U, "bid_us")
