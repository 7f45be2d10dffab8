"""Bid features of items too long for one task.

An item's bids are numbered across the cluster and cut into chunks of equal
length. Each feature is then a value inside the chunk combined with a small
carry from the chunks before it:

* running sums, maxima and clusters carry one row per chunk;
* "the bids before" come from the last rows of the chunk before, copied over;
* trailing time windows ask the one earlier chunk that holds the window's edge;
* ranks and medians among all earlier bids combine a grid of counts (chunk of
  time by chunk of amount) with comparisons inside single chunks.

No task ever holds more than a few chunks, and every value is exact.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gavelworks.operators.bids import (
    AT,
    DAY,
    DAY_MICROS,
    DECAY,
    N,
    PREV_A,
    PREV_U,
    SECOND,
    U,
    decayed_sum,
    increment,
    starts_cluster,
)
from gavelworks.operators.order_statistics import earlier_below, running_medians
from gavelworks.operators.scans import carried_in, chunk_size, numbered
from gavelworks.session import written

C = "_chunk"
BAND = "_band"
KEY = ["item_id"]
ITEM = "_item"


def chunked(
    df: DataFrame, groups: Sequence[str], order: Sequence[Column], rows: int, limit: int
) -> DataFrame:
    """Fill the working columns of ``finish`` for oversized items.

    Bids without an item are an item like any other: all steps join on a key
    that is never missing, and the item comes back at the end.
    """
    size = chunk_size(rows, limit)
    key = F.coalesce(F.concat(F.lit("="), F.col("item_id").cast("string")), F.lit(""))
    df = df.withColumn(ITEM, F.col("item_id")).withColumn("item_id", key)
    by = [F.col(AT).asc(), *order]
    placed = numbered(df, KEY, by, N, rows, size)
    placed = written(placed.withColumn(C, F.floor((F.col(N) - 1) / size)), "placed")
    if "bid_number" not in df.columns:
        placed = placed.withColumn("bid_number", F.col(N))
    out = _running(placed, size)
    if "bid_counts" in groups:
        out = out.join(_earlier_counts(placed, size), ["item_id", N], "left")
        out = out.withColumns({f"_before_{s}": F.coalesce(f"_before_{s}", F.lit(0)) for s in (60, 300, 600)})
    if "bid_amounts" in groups:
        # Missing amounts have no place among the known ones, whose own count is the place of each.
        out = out.withColumn("_k", F.when(F.col("bid_amount").isNotNull(), F.col("_known_a")))
        known = placed.join(_known_before(placed), ["item_id", C]).filter(F.col("bid_amount").isNotNull())
        inside = Window.partitionBy("item_id", C).orderBy(N).rowsBetween(Window.unboundedPreceding, 0)
        place = F.col("_c_known") + F.count("*").over(inside)
        known = known.select("item_id", place.alias(N), "bid_amount").withColumn(C, F.floor((F.col(N) - 1) / size))
        standings = _standings(known, size, rows).withColumnRenamed(N, "_k")
        out = out.join(standings, ["item_id", "_k"], "left")
    return out.withColumn("item_id", F.col(ITEM)).drop(ITEM)


def _known_before(placed: DataFrame) -> DataFrame:
    """Known amounts in all earlier chunks of the item."""
    counts = placed.groupBy("item_id", C).agg(F.count("bid_amount").alias("_n_known"))
    earlier = carried_in(counts, KEY, C, {"_c_known": F.sum("_n_known")})
    return earlier.withColumn("_c_known", F.coalesce("_c_known", F.lit(0)))


# ------------------------------------------------------------ running values


def _with_neighbours(placed: DataFrame, size: int) -> DataFrame:
    """Earlier bids of each bid. The last five rows of a chunk also visit the next one."""
    ends_chunk = F.col(N) > (F.col(C) + 1) * size - 5
    visits = F.when(ends_chunk, F.array(F.col(C), F.col(C) + 1)).otherwise(F.array(F.col(C)))
    w = Window.partitionBy("item_id", "_in").orderBy(N)
    return (
        placed.withColumn("_in", F.explode(visits))
        .withColumns(
            {
                PREV_U: F.lag(U).over(w),
                PREV_A: F.lag("bid_amount").over(w),
                "_prev_a2": F.lag("bid_amount", 2).over(w),
            }
        )
        .withColumn("bid_increment", increment())
        .withColumn("_mean_inc_5", F.avg("bid_increment").over(w.rowsBetween(-4, 0)))
        .filter(F.col("_in") == F.col(C))
        .drop("_in")
    )


def _running(placed: DataFrame, size: int) -> DataFrame:
    inside = Window.partitionBy("item_id", C).orderBy(N).rowsBetween(Window.unboundedPreceding, 0)
    today = Window.partitionBy("item_id", C, DAY).orderBy(N).rowsBetween(Window.unboundedPreceding, 0)
    yesterday = Window.partitionBy("item_id", C).orderBy(DAY).rangeBetween(-1, -1)
    local = _with_neighbours(placed, size).withColumns(
        {
            "_in_max_u": F.max(U).over(inside),
            "_in_sum_a": F.sum("bid_amount").over(inside),
            "_in_known": F.count("bid_amount").over(inside),
            "_in_max_a": F.max("bid_amount").over(inside),
            "_in_sum_inc": F.sum("bid_increment").over(inside),
            "_in_max_number": F.max("bid_number").over(inside),
            "_in_cluster_u": F.max(F.when(starts_cluster(), F.col(U))).over(inside),
            "_in_cluster_n": F.max(F.when(starts_cluster(), F.col(N))).over(inside),
            "_in_decayed": decayed_sum(F.lit(1.0), F.col(U), F.col(DAY), today, yesterday),
        }
    )
    summary = local.groupBy("item_id", C).agg(
        F.min_by(U, N).alias("_start_u"),
        F.min_by("bid_amount", N).alias("_start_a"),
        F.max(U).alias("_end_u"),
        F.sum("bid_amount").alias("_sum_a"),
        F.count("bid_amount").alias("_n_known"),
        F.max("bid_amount").alias("_top_a"),
        F.sum("bid_increment").alias("_sum_i"),
        F.max("bid_number").alias("_top_number"),
        F.max("_in_cluster_u").alias("_last_cluster_u"),
        F.max("_in_cluster_n").alias("_last_cluster_n"),
        F.max_by("_in_decayed", N).alias("_decayed_end"),
    )
    carry = _carry(summary)
    out = local.join(carry, ["item_id", C], "left")
    since_end = (F.col(U) - F.col("_c_end_u")) / F.lit(float(SECOND))
    older = F.coalesce(F.col("_c_decayed") * F.exp(-since_end * DECAY), F.lit(0.0))
    known = F.col("_in_known") + F.coalesce("_c_known", F.lit(0))
    return out.withColumns(
        {
            "_max_u": F.greatest("_in_max_u", "_c_end_u"),
            "_known_a": known,
            "_mean_a": F.when(known > 0, _both("_in_sum_a", "_c_sum_a") / known),
            "_max_a": F.greatest("_in_max_a", "_c_max_a"),
            "_sum_inc": _both("_in_sum_inc", "_c_sum_inc"),
            "_max_number": F.greatest("_in_max_number", "_c_max_number"),
            "_cluster_u": F.coalesce("_in_cluster_u", "_c_cluster_u"),
            "_cluster_n": F.coalesce("_in_cluster_n", "_c_cluster_n"),
            "_decayed": F.col("_in_decayed") + older,
        }
    )


def _both(inside: str, before: str) -> Column:
    """Sum of two sums, each missing where it has nothing to add."""
    return F.coalesce(F.col(inside) + F.col(before), F.col(inside), F.col(before))


def _carry(summary: DataFrame) -> DataFrame:
    """What each chunk takes over from the chunks before it. One row per chunk."""
    end_day = F.floor(F.col("_end_u") / F.lit(DAY_MICROS))
    w = Window.partitionBy("item_id").orderBy(C)
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    today = Window.partitionBy("item_id", "_end_day").orderBy(C).rowsBetween(Window.unboundedPreceding, 0)
    yesterday = Window.partitionBy("item_id").orderBy("_end_day").rangeBetween(-1, -1)
    chunks = summary.withColumn("_end_day", end_day).withColumn(
        "_decayed_all",
        decayed_sum(F.col("_decayed_end"), F.col("_end_u"), F.col("_end_day"), today, yesterday),
    )
    firsts = chunks.select(
        "item_id",
        C,
        F.first("_start_u").over(so_far).alias("_first_u"),
        F.first("_start_a").over(so_far).alias("_first_a"),
        F.lag("_decayed_all").over(w).alias("_c_decayed"),
    )
    earlier = carried_in(
        summary,
        KEY,
        C,
        {
            "_c_end_u": F.max("_end_u"),
            "_c_sum_a": F.sum("_sum_a"),
            "_c_known": F.sum("_n_known"),
            "_c_max_a": F.max("_top_a"),
            "_c_sum_inc": F.sum("_sum_i"),
            "_c_max_number": F.max("_top_number"),
            "_c_cluster_u": F.max("_last_cluster_u"),
            "_c_cluster_n": F.max("_last_cluster_n"),
        },
    )
    return firsts.join(earlier, ["item_id", C])


# ------------------------------------------------------- trailing time windows


def _window_edges(chunks: pd.DataFrame) -> pd.DataFrame:
    """Which earlier chunks hold the edges of a chunk's windows.

    Input is one row per chunk of one item. Edges move forward with the bids,
    so all pairs together number at most twice the chunks for each window.
    """
    chunks = chunks.sort_values(C)
    starts, ends = chunks["_start"].to_numpy(), chunks["_end"].to_numpy()
    until = np.append(starts[1:], np.iinfo(np.int64).max)
    out = []
    for c in range(len(starts)):
        for seconds in (60, 300, 600):
            first = np.searchsorted(starts, starts[c] - seconds * SECOND, side="left") - 1
            last = np.searchsorted(starts, ends[c] - seconds * SECOND, side="left") - 1
            for d in range(max(first, 0), last + 1):
                out.append((chunks["item_id"].iloc[0], c, seconds, d, starts[d], until[d]))
    return pd.DataFrame(out, columns=["item_id", "_asks", "_seconds", "_holds", "_from", "_to"])


def _earlier_counts(placed: DataFrame, size: int) -> DataFrame:
    """Number of bids before each window's edge, as ``_before_60`` and so on."""
    kind = placed.schema["item_id"].dataType.simpleString()
    timed = placed.filter(F.col(U).isNotNull())
    chunks = timed.groupBy("item_id", C).agg(F.min(U).alias("_start"), F.max(U).alias("_end"))
    edges = chunks.groupBy("item_id").applyInPandas(
        _window_edges, f"item_id {kind}, _asks long, _seconds int, _holds long, _from long, _to long"
    )
    pair = ["item_id", "_seconds", "_asks", "_holds"]
    asking = (
        timed.select("item_id", N, U, F.col(C).alias("_asks"))
        .join(edges, ["item_id", "_asks"])
        .withColumn("_t", F.col(U) - F.col("_seconds") * SECOND)
        .filter((F.col("_t") > F.col("_from")) & (F.col("_t") <= F.col("_to")))
        .select(*pair, "_t", N, F.lit(0).alias("_row"))
    )
    held = (
        timed.select("item_id", F.col(U).alias("_t"), F.col(C).alias("_holds"))
        .join(edges.select(*pair), ["item_id", "_holds"])
        .select(*pair, "_t", F.lit(None).cast("long").alias(N), F.lit(1).alias("_row"))
    )
    w = Window.partitionBy(*pair).orderBy("_t", "_row").rowsBetween(Window.unboundedPreceding, 0)
    counted = (
        asking.unionByName(held)
        .withColumn("_before", F.col("_holds") * size + F.sum("_row").over(w))
        .filter(F.col("_row") == 0)
    )
    return counted.groupBy("item_id", N).agg(
        *[
            F.max(F.when(F.col("_seconds") == s, F.col("_before"))).alias(f"_before_{s}")
            for s in (60, 300, 600)
        ]
    )


# --------------------------------------------------------- ranks and medians


def _earlier_chunks_in_band(band: pd.DataFrame) -> pd.DataFrame:
    """Within one band of amounts: lower-ranked bids that lie in an earlier chunk of time."""
    band = band.sort_values("_rank")
    return band.assign(_in_band=earlier_below(band[C].to_numpy()))


def _standing_in_chunk(own: pd.DataFrame, middle: pd.DataFrame) -> pd.DataFrame:
    """Within one chunk of time: rank among the chunk's own bids, and the running median.

    ``middle`` holds the earlier amounts the median can reach during this
    chunk; ``_under`` says how many earlier amounts lie under them.
    """
    own = own.sort_values(N)
    if own.empty:
        return pd.DataFrame({"item_id": [], N: [], "_not_above": [], "_median_a": []})
    below = int(middle["_under"].min()) if len(middle) else 0
    medians = running_medians(
        middle["_amount"].to_numpy(dtype="float64"), own["bid_amount"].to_numpy(), below, int(own[N].iloc[0])
    )
    not_above = own["_below"] + own["_in_band"] + earlier_below(own["_rank"].to_numpy()) + 1
    return pd.DataFrame({"item_id": own["item_id"], N: own[N], "_not_above": not_above, "_median_a": medians})


def _grid(cells: DataFrame) -> DataFrame:
    """For each chunk of time and band of amounts: earlier bids in the band, and in lower bands.

    An item has as many bands as chunks, and chunks are at least as long as
    they are many, so the grid has no more cells than there are bids.
    """
    last = cells.groupBy("item_id").agg(F.max(C).alias("_last"))
    every = last.select("item_id", "_last", F.explode(F.sequence(F.lit(0).cast("long"), "_last")).alias(C))
    every = every.select("item_id", C, F.explode(F.sequence(F.lit(0).cast("long"), "_last")).alias(BAND))
    before = Window.unboundedPreceding, -1
    in_time = Window.partitionBy("item_id", BAND).orderBy(C).rowsBetween(*before)
    in_amount = Window.partitionBy("item_id", C).orderBy(BAND).rowsBetween(*before)
    zero = F.lit(0).cast("long")
    return (
        every.join(cells, ["item_id", C, BAND], "left")
        .withColumn("_earlier", F.coalesce(F.sum("count").over(in_time), zero))
        .withColumn("_below", F.coalesce(F.sum("_earlier").over(in_amount), zero))
        .drop("count")
    )


def _standings(placed: DataFrame, size: int, rows: int) -> DataFrame:
    """How many bids so far are not above each bid, and their median."""
    kind = placed.schema["item_id"].dataType.simpleString()
    narrow = placed.select("item_id", N, C, F.col("bid_amount").cast("double").alias("bid_amount"))
    by_amount = [F.col("bid_amount").asc(), F.col(N).asc()]
    ranked = numbered(narrow, KEY, by_amount, "_rank", rows, size)
    ranked = written(ranked.withColumn(BAND, F.floor((F.col("_rank") - 1) / size)), "ranked")
    grid = _grid(ranked.groupBy("item_id", C, BAND).count())

    row = f"item_id {kind}, {N} long, {C} long, bid_amount double, _rank long, {BAND} long"
    own = (
        ranked.groupBy("item_id", BAND)
        .applyInPandas(_earlier_chunks_in_band, f"{row}, _in_band long")
        .join(grid.select("item_id", C, BAND, "_below"), ["item_id", C, BAND])
    )
    # Earlier amounts the median can reach while the chunk's own bids arrive.
    seen = F.col(C) * size
    reach_low = F.floor((seen - size) / 2) - 1
    reach_high = F.floor((seen + size) / 2) + 1
    reached = grid.filter(
        (F.col("_earlier") > 0)
        & (F.col("_below") <= reach_high)
        & (F.col("_below") + F.col("_earlier") > reach_low)
    ).select("item_id", F.col(C).alias("_for"), BAND, "_below")
    middle = (
        ranked.select("item_id", C, BAND, "bid_amount")
        .join(reached, ["item_id", BAND])
        .filter(F.col(C) < F.col("_for"))
        .select(
            F.col("item_id").alias("_for_item"),
            "_for",
            F.col("bid_amount").alias("_amount"),
            F.col("_below").alias("_under"),
        )
    )
    return (
        own.groupBy("item_id", C)
        .cogroup(middle.groupBy("_for_item", "_for"))
        .applyInPandas(
            _standing_in_chunk, f"item_id {kind}, {N} long, _not_above long, _median_a double"
        )
    )
