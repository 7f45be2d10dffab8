"""Causal per-bid features: each row looks only at itself and earlier bids of its item."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gavelworks.functions.money import increment_deviation, is_unusual_increment
from gavelworks.functions.times import as_timestamp
from gavelworks.operators.checks import require_columns
from gavelworks.operators.order_statistics import standing_so_far
from gavelworks.operators.scans import GROUP_LIMIT, split_by_size

SECOND = 1_000_000
DAY_MICROS = 86400 * SECOND
CLUSTER_GAP = 30 * SECOND
# Decay of the weighted bid count: half-life of two minutes.
DECAY = math.log(2) / 120

GROUPS = ("time_series", "bid_counts", "bid_amounts", "auction_progress", "temporal_activity")

# Sorts bids without a time after all others.
LATEST = 10**18

# Working columns. They are dropped before the result is returned. ``AT`` is
# the bid time for sorting, ``U`` the same or NULL.
U, AT, DAY, N, PREV_U, PREV_A = "_u", "_at_u", "_day", "_n", "_prev_u", "_prev_a"

Order = Sequence[str | Column]


def bid_order(df: DataFrame, tiebreak: Order | None) -> list[Column]:
    """Columns that settle the order of bids made at the same instant."""
    if tiebreak is None:
        if "bid_number" not in df.columns:
            raise ValueError("bids at the same time need an order: pass tiebreak=[...] or a bid_number column")
        tiebreak = ["bid_number"]
    return [F.col(c).asc() if isinstance(c, str) else c for c in tiebreak]


def prepared(df: DataFrame) -> DataFrame:
    """Parsed bid time, its micros and its day. The scraped names of two columns are accepted."""
    require_columns(df, ["item_id", "bid_time", "bid_amount"])
    out = df.withColumn("bid_time", as_timestamp(df, "bid_time"))
    out = out.withColumn(U, F.unix_micros("bid_time")).withColumn(AT, F.coalesce(U, F.lit(LATEST)))
    return out.withColumn(DAY, F.expr(f"{AT} div {DAY_MICROS}"))


def _proxy(df: DataFrame) -> Column:
    name = next((c for c in ("is_proxy_bid", "bid_is_proxy") if c in df.columns), None)
    return F.lit(0) if name is None else F.coalesce(F.col(name).cast("int"), F.lit(0))


class BidWindows:
    """The window specs shared by the features of ordinary items.

    All of them partition by ``item_id`` first, so one exchange serves every
    feature. Days come before times in the order because the decayed count
    restarts its exponents each day; that does not change the order, and it
    lets the per-item and per-day windows share one sort.
    """

    def __init__(self, tiebreak: Sequence[Column]):
        in_time = [F.col(AT).asc(), *tiebreak]
        self.order = [F.col(DAY).asc(), *in_time]
        self.item = Window.partitionBy("item_id").orderBy(*self.order)
        self.so_far = self.item.rowsBetween(Window.unboundedPreceding, 0)
        self.last_five = self.item.rowsBetween(-4, 0)
        self.today_so_far = (
            Window.partitionBy("item_id", DAY).orderBy(*in_time).rowsBetween(Window.unboundedPreceding, 0)
        )
        self.yesterday = Window.partitionBy("item_id").orderBy(DAY).rangeBetween(-1, -1)

    def before(self, seconds: int):
        """Bids strictly earlier than ``seconds`` ago."""
        return (
            Window.partitionBy("item_id")
            .orderBy(AT)
            .rangeBetween(Window.unboundedPreceding, -seconds * SECOND - 1)
        )


def decayed_sum(weight: Column, at: Column, day: Column, today_so_far, yesterday) -> Column:
    """Sum of earlier weights, each halved for every two minutes that passed.

    Within a day the weights are scaled to midnight, which stays inside the
    range of a double; from the day before, what is left at midnight is
    carried; anything older has decayed below the smallest double.
    """
    since_midnight = (at - day * DAY_MICROS) / F.lit(float(SECOND))
    until_midnight = ((day + 1) * DAY_MICROS - at) / F.lit(float(SECOND))
    scaled = F.sum(weight * F.exp(since_midnight * DECAY)).over(today_so_far)
    left_over = F.coalesce(F.sum(weight * F.exp(-until_midnight * DECAY)).over(yesterday), F.lit(0.0))
    return (scaled + left_over) * F.exp(-since_midnight * DECAY)


# ------------------------------------------------------- shared projections
# The formulas below are pure projections over working columns. The windowed
# path here and the chunked path for oversized items fill the same columns.


def elapsed_columns() -> dict[str, Column]:
    since_first = (F.col(U) - F.col("_first_u")) / F.lit(float(SECOND))
    since_last = F.coalesce((F.col(U) - F.col(PREV_U)) / F.lit(float(SECOND)), F.lit(0.0))
    longest = (F.col("_max_u") - F.col("_first_u")) / F.lit(float(SECOND))
    return {
        "time_since_first_bid_seconds": since_first,
        "time_since_last_bid_seconds": since_last,
        "elapsed_time_fraction": F.when(longest > 0, since_first / longest).otherwise(0.0),
        "time_since_first_bid_minutes": since_first / F.lit(60.0),
        "time_since_first_bid_hours": since_first / F.lit(3600.0),
        "time_since_last_bid_minutes": since_last / F.lit(60.0),
    }


def count_columns() -> dict[str, Column]:
    known = F.col(U).isNotNull()
    n = F.col(N)
    last_1 = F.when(known, n - F.col("_before_60")).otherwise(F.lit(0))
    last_5 = F.when(known, n - F.col("_before_300")).otherwise(F.lit(0))
    five_before = F.when(known, F.col("_before_300") - F.col("_before_600")).otherwise(F.lit(0))
    return {
        "number_of_bids_so_far": n,
        "is_first_bid": (n == 1).cast("int"),
        "rolling_bid_count_1min": last_1,
        "rolling_bid_count_5min": last_5,
        "bid_velocity_5min": last_5 / F.lit(5.0),
        "bid_acceleration": last_5 / F.lit(5.0) - five_before / F.lit(5.0),
        "time_weighted_bid_velocity": F.col("_decayed"),
    }


def amount_columns(df: DataFrame) -> dict[str, Column]:
    amount, previous = F.col("bid_amount"), F.col(PREV_A)
    increment = F.col("bid_increment")
    return {
        "bid_increment": increment,
        "bid_increment_pct": F.when(previous > 0, increment / previous * 100),
        "is_unusual_increment": is_unusual_increment(previous, amount).cast("int"),
        "increment_deviation_ratio": increment_deviation(previous, amount),
        "proxy_bid_flag": _proxy(df),
        # Among the known amounts; a bid without one has no place among them.
        "bid_amount_percentile_so_far": F.col("_not_above") / F.col("_known_a") * F.lit(100.0),
        "bid_amount_relative_to_mean": amount - F.col("_mean_a"),
        "bid_amount_relative_to_median": amount - F.col("_median_a"),
        "bid_amount_relative_to_max": _share_of_max(amount),
        "cumulative_bid_increment_sum": F.col("_sum_inc"),
        "rolling_avg_increment_5": F.col("_mean_inc_5"),
    }


def _share_of_max(amount: Column) -> Column:
    return F.when(F.col("_max_a") > 0, amount / F.col("_max_a")).otherwise(1.0)


def progress_columns(starting_bid: str | None) -> dict[str, Column]:
    amount, n = F.col("bid_amount"), F.col(N)
    start = F.col("_first_a") if starting_bid is None else F.col(starting_bid)
    overall = (amount - F.col("_first_a")) / n
    recent = (amount - F.col("_prev_a2")) / F.lit(3.0)
    return {
        "bid_number_normalized": F.col("bid_number") / F.col("_max_number"),
        "current_to_starting_bid_ratio": F.when(start > 0, amount / start),
        "current_to_highest_ratio": _share_of_max(amount),
        "is_new_high": (amount == F.col("_max_a")).cast("int"),
        "bid_momentum": F.when((n > 2) & (overall > 0), (recent - overall) / overall).otherwise(0.0),
    }


def increment() -> Column:
    """Step from the bid before; the first bid's is its amount. Missing where either amount is."""
    return F.when(F.col(N) == 1, F.col("bid_amount")).otherwise(F.col("bid_amount") - F.col(PREV_A))


def starts_cluster() -> Column:
    return (F.col(N) == 1) | ((F.col(U) - F.col(PREV_U)) > CLUSTER_GAP)


def cluster_columns() -> dict[str, Column]:
    size = F.col(N) - F.col("_cluster_n") + 1
    return {
        "bid_cluster_size_so_far": size,
        "is_in_bid_cluster": (size > 1).cast("int"),
        "time_since_cluster_start_seconds": (F.col(U) - F.col("_cluster_u")) / F.lit(float(SECOND)),
    }


def finish(df: DataFrame, original: DataFrame, groups: Sequence[str], starting_bid: str | None) -> DataFrame:
    """Turn filled working columns into the named features."""
    if starting_bid is not None and starting_bid not in original.columns:
        starting_bid = None
    out: dict[str, Column] = {}
    if "time_series" in groups:
        out |= elapsed_columns()
    if "bid_counts" in groups:
        out |= count_columns()
    if "bid_amounts" in groups:
        out |= amount_columns(original)
    if "auction_progress" in groups:
        if "bid_number" not in original.columns:
            out["bid_number"] = F.col("bid_number")
        out |= progress_columns(starting_bid)
    if "temporal_activity" in groups:
        out |= cluster_columns()
        if "time_series" not in groups:
            out["time_since_last_bid_seconds"] = elapsed_columns()["time_since_last_bid_seconds"]
    return df.select(*original.columns, *[c.alias(n) for n, c in out.items()])


# --------------------------------------------------------- ordinary items

STANDING = T.StructType([T.StructField("not_above", T.LongType()), T.StructField("median", T.DoubleType())])


@F.pandas_udf(STANDING)
def _standing(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    """Rank and running median of each amount among the amounts seen so far.

    Rows arrive in window order, item by item; position 1 starts a new item. A
    missing amount has neither and changes neither for those after it. All
    items of a batch are taken together; of an item that goes on in the next
    batch the amounts are kept.
    """
    seen = np.zeros(0)
    for position, amount in batches:
        values = np.concatenate([seen, amount.to_numpy(dtype="float64", na_value=np.nan)])
        begins = np.concatenate([np.zeros(len(seen), bool), position.to_numpy() == 1])
        # Where each row's item begins; what was kept begins the first one.
        start = np.maximum.accumulate(np.where(begins, np.arange(len(values)), 0))
        known = ~np.isnan(values)
        place = np.concatenate([[0], np.cumsum(known)])
        ranks, medians = standing_so_far(values[known], place[start[known]])
        not_above = np.full(len(values), -1, dtype="int64")
        median = np.full(len(values), np.nan)
        not_above[known], median[known] = ranks, medians
        new = slice(len(seen), None)
        missing = ~known[new]
        yield pd.DataFrame(
            {
                "not_above": pd.arrays.IntegerArray(not_above[new], missing),
                "median": pd.arrays.FloatingArray(median[new], missing.copy()),
            }
        )
        last = start[-1] if len(start) else 0
        seen = values[last:][known[last:]]


# Spark must not move a filter below this function: it reads its rows in order.
standing = _standing.asNondeterministic()


def windowed(df: DataFrame, groups: Sequence[str], tiebreak: Sequence[Column]) -> DataFrame:
    """Fill the working columns with window functions: one exchange on item_id."""
    w = BidWindows(tiebreak)
    amount, u = F.col("bid_amount"), F.col(U)
    wants = set(groups)
    counts, amounts = "bid_counts" in wants, "bid_amounts" in wants
    progress, clusters = "auction_progress" in wants, "temporal_activity" in wants

    first: dict[str, Column] = {N: F.row_number().over(w.item).cast("long")}
    if "time_series" in wants or clusters:
        first[PREV_U] = F.lag(U).over(w.item)
    if "time_series" in wants:
        first["_first_u"] = F.first(U).over(w.so_far)
        first["_max_u"] = F.max(U).over(w.so_far)
    if amounts:
        first[PREV_A] = F.lag("bid_amount").over(w.item)
        first["_mean_a"] = F.avg("bid_amount").over(w.so_far)
        first["_known_a"] = F.count("bid_amount").over(w.so_far)
    if amounts or progress:
        first["_max_a"] = F.max("bid_amount").over(w.so_far)
    if progress:
        first["_first_a"] = F.first("bid_amount").over(w.so_far)
        first["_prev_a2"] = F.lag("bid_amount", 2).over(w.item)
    out = df
    if counts:
        # These sort by time alone, so they come before the sort all others share.
        out = out.withColumns({f"_before_{s}": F.count("*").over(w.before(s)) for s in (60, 300, 600)})
    out = out.withColumns(first)

    second: dict[str, Column] = {}
    if amounts:
        out = out.withColumn("bid_increment", increment())
        second["_sum_inc"] = F.sum("bid_increment").over(w.so_far)
        second["_mean_inc_5"] = F.avg("bid_increment").over(w.last_five)
    if progress:
        if "bid_number" not in df.columns:
            out = out.withColumn("bid_number", F.col(N))
        second["_max_number"] = F.max("bid_number").over(w.so_far)
    if clusters:
        second["_cluster_u"] = F.max(F.when(starts_cluster(), u)).over(w.so_far)
        second["_cluster_n"] = F.max(F.when(starts_cluster(), F.col(N))).over(w.so_far)
    if second:
        out = out.withColumns(second)
    if counts:
        out = out.withColumn(
            "_decayed", decayed_sum(F.lit(1.0), u, F.col(DAY), w.today_so_far, w.yesterday)
        )
    if amounts:
        # Already in this order; stated because the function depends on it. It
        # comes last because Spark forgets the partitioning behind it.
        out = out.sortWithinPartitions("item_id", *w.order)
        out = out.withColumn("_standing", standing(F.col(N), amount.cast("double")))
        out = out.withColumns({"_not_above": F.col("_standing.not_above"), "_median_a": F.col("_standing.median")})
    return out


# -------------------------------------------------------------- entry point


def engineer_bid_features(
    df: DataFrame,
    tiebreak: Order | None = None,
    starting_bid: str | None = None,
    groups: Sequence[str] = GROUPS,
    item_limit: int = GROUP_LIMIT,
) -> DataFrame:
    """All bid features of the chosen groups, next to the input columns.

    Items with more than ``item_limit`` bids are spread over many tasks; see
    ``gavelworks.operators.long_items``. Both paths give the same values. A
    chunk of an item has no more rows than a Python worker should hold, also
    where the caller's limit is higher.
    """
    unknown = set(groups) - set(GROUPS)
    if unknown:
        raise ValueError(f"unknown feature groups: {sorted(unknown)}")
    ready = prepared(df)
    original = ready.drop(U, AT, DAY)
    order = bid_order(df, tiebreak)
    parts = split_by_size(ready, ["item_id"], item_limit)
    out = finish(windowed(parts.small, groups, order), original, groups, starting_bid)
    if parts.large is None:
        return out
    from gavelworks.operators.long_items import chunked

    large = chunked(parts.large, groups, order, parts.large_rows, min(item_limit, GROUP_LIMIT))
    return out.unionByName(finish(large, original, groups, starting_bid))
