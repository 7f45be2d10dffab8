"""Aggregates over auctions, items and bids. All of them combine map-side first."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gavelworks.functions.times import micros, seconds_between
from gavelworks.operators.joins import left_join
from gavelworks.operators.scans import (
    WINDOW_LIMIT,
    chunk_size,
    grouped_median,
    row_numbers,
    running_total,
    split_by_size,
    with_previous,
)


def value_counts(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count("*").alias("count"))


def distinct_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Exact distinct values per column, counted over (column, value) pairs so no column is special."""
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns])
    return (
        df.select(F.explode(pairs).alias("p"))
        .groupBy("p.column", "p.value")
        .agg(F.lit(1))
        .groupBy("column")
        .agg(F.count("value").alias("distinct"))
    )


# Rows of a sketch are 2 to this power: a relative error of about 0.4 %, and at most 64 KB for each column and batch.
SKETCH_BITS = 16


def distinct_sketches(df: DataFrame, columns: Sequence[str], batch: str) -> DataFrame:
    """``batch, column, sketch``: a mergeable count of the distinct values of each column, NULL apart, for one batch of rows.

    The values are counted as text, so that sketches of batches with other
    types of the same column still merge.
    """
    sketches = [F.hll_sketch_agg(F.col(f"`{c}`").cast("string"), SKETCH_BITS).alias(f"_{i}") for i, c in enumerate(columns)]
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"_{i}").alias("sketch")) for i, c in enumerate(columns)])
    return df.agg(*sketches).select(F.lit(batch).alias("batch"), F.explode(pairs).alias("s")).select("batch", "s.*")


def add_sketches(df: DataFrame, columns: Sequence[str], batch: str, path: str) -> None:
    """Store the sketches of a new batch; neither older batches nor their sketches are read. A batch that comes again replaces itself."""
    distinct_sketches(df, columns, batch).drop("batch").write.mode("overwrite").parquet(f"{path}/batch={batch}")


def merged_distinct_counts(sketches: DataFrame) -> DataFrame:
    """``column, distinct``: estimates over all batches, the same in whatever order they merge."""
    merged = F.hll_sketch_estimate(F.hll_union_agg("sketch"))
    return sketches.groupBy("column").agg(merged.alias("distinct"))


def top_values(df: DataFrame, column: str, k: int = 10) -> DataFrame:
    """Most frequent values; ties go to the smaller value."""
    return value_counts(df.filter(F.col(column).isNotNull()), column).orderBy(F.desc("count"), column).limit(k)


def mean_by(df: DataFrame, by: str, value: str, out: str) -> DataFrame:
    return df.groupBy(by).agg(F.avg(value).alias(out))


def coverage(df: DataFrame, columns: Sequence[str], targets: dict[str, float] | None = None) -> DataFrame:
    """Share of rows with a value, per column; with targets, whether the share reaches them."""
    shares = df.agg(*[F.avg(F.col(c).isNotNull().cast("int")).alias(c) for c in columns])
    rows = F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("share")) for c in columns])
    out = shares.select(F.explode(rows).alias("r")).select("r.*")
    if targets is None:
        return out
    goal = F.element_at(F.create_map(*[F.lit(x) for kv in targets.items() for x in kv]), F.col("field"))
    return out.withColumn("target", goal).withColumn("reached", (F.col("share") >= F.col("target")).cast("int"))


def describe(df: DataFrame, column: str) -> DataFrame:
    """Count, mean, deviation, extremes and exact quartiles (linear between ranks).

    Quartiles come from counts of distinct values, ranked across the cluster.
    """
    stats = df.agg(
        F.count(column).alias("count"),
        F.avg(column).alias("mean"),
        F.stddev_samp(column).alias("std"),
        F.min(column).alias("min"),
        F.max(column).alias("max"),
    )
    one = F.lit(0).alias("_all")
    both = stats.select("*", one).join(quartiles(df, column).select("*", one), "_all")
    return both.select("count", "mean", "std", "min", "p25", "p50", "p75", "max")


def quartiles(df: DataFrame, column: str, limit: int = WINDOW_LIMIT) -> DataFrame:
    counts = df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("_n"))
    total = counts.agg(F.sum("_n").alias("t")).first()["t"] or 0
    ranked = _cumulative(counts, column, limit)
    out = []
    for name, q in (("p25", 0.25), ("p50", 0.5), ("p75", 0.75)):
        at = q * max(total - 1, 0)
        low, part = int(at), at - int(at)
        value = lambda rank: F.min(F.when(F.col("_upto") > rank, F.col(column)))
        out.append((value(low) * (1 - part) + value(min(low + 1, max(total - 1, 0))) * part).alias(name))
    return ranked.agg(*out)


def _cumulative(counts: DataFrame, column: str, limit: int) -> DataFrame:
    keyed = counts.withColumn("_all", F.lit(0))
    parts = split_by_size(keyed, ["_all"], limit)
    if parts.large is None:
        w = Window.partitionBy("_all").orderBy(column).rowsBetween(Window.unboundedPreceding, 0)
        return keyed.withColumn("_upto", F.sum("_n").over(w))
    size = chunk_size(parts.large_rows, limit)
    order = [F.col(column).asc()]
    return running_total(parts.large, ["_all"], order, F.col("_n"), "_upto", parts.large_rows, size)


def fill_with_medians(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Missing numbers replaced by the column's exact median."""
    for c in columns:
        median = grouped_median(df.select(F.lit(0).alias("_all"), c), ["_all"], c, "_median")
        df = df.withColumn("_all", F.lit(0)).join(F.broadcast(median), "_all", "left")
        df = df.withColumn(c, F.coalesce(F.col(c), F.col("_median"))).drop("_all", "_median")
    return df


def distribution(df: DataFrame, column: str) -> DataFrame:
    return value_counts(df, column).orderBy(column)


def with_bid_count(bids: DataFrame, limit: int = WINDOW_LIMIT) -> DataFrame:
    """Bids of the item on each row, and ids that count down from it."""
    counted = bids.groupBy("item_id").agg(F.count("*").alias("bid_count"))
    order = [F.col("bid_time").asc_nulls_last(), F.col("bid_id").asc()]
    placed = row_numbers(left_join(bids, counted, ["item_id"]), ["item_id"], order, "_place", limit, sizes=bids)
    return placed.withColumn("bid_down_id", F.col("bid_count") - F.col("_place") + 1).drop("_place")


def auction_totals(auctions: DataFrame) -> DataFrame:
    """Sums and means over all auctions."""
    names = ["auction_item_count", "auction_total_winning_price", "auction_total_bid_count", "auction_total_images"]
    out: list[Column] = [F.count("*").alias("auctions")]
    for c in names:
        short = c.removeprefix("auction_").removeprefix("total_")
        out += [F.sum(c).alias(f"sum_{short}"), F.avg(c).alias(f"avg_{short}")]
    return auctions.agg(*out)


def category_statistics(items: DataFrame, category: str, price: str, limit: int = WINDOW_LIMIT) -> DataFrame:
    """Average and median price and the share sold, per category."""
    base = items.groupBy(category).agg(
        F.avg(price).alias("category_avg_price"),
        F.avg(F.coalesce(F.col(price) > 0, F.lit(False)).cast("int")).alias("category_sell_rate"),
    )
    median = grouped_median(items, [category], price, "category_median_price", limit)
    median = median.withColumnRenamed(category, "_category")
    return base.join(median, F.col(category).eqNullSafe(F.col("_category")), "left").drop("_category")


def auction_results(items: DataFrame) -> DataFrame:
    sold = F.coalesce(F.col("winning_bid") > 0, F.lit(False))
    return items.groupBy("auction_id").agg(
        F.sum("bid_count").alias("total_bids"),
        F.sum(F.when(sold, F.col("winning_bid")).otherwise(0.0)).alias("total_revenue"),
        F.count_if(sold).alias("items_sold"),
        F.count_if(~sold).alias("items_unsold"),
    )


def no_bid_rate(items: DataFrame, by: str) -> DataFrame:
    return items.groupBy(by).agg(F.avg((F.col("bid_count") == 0).cast("int")).alias("no_bid_rate"))


def bid_sequence_statistics(bids: DataFrame, start: str, end: str, bidder: str = "bidder_id") -> DataFrame:
    """Per item: bids, bidders, first bid, mean gap, last-hour pace and soft-close bids.

    The gaps between consecutive bids add up to last minus first, so the mean
    gap needs no ordering.
    """
    left = seconds_between(F.col(end), F.col("bid_time"))
    span = (F.max(micros(F.col("bid_time"))) - F.min(micros(F.col("bid_time")))) / F.lit(1e6)
    return bids.groupBy("item_id").agg(
        F.count("*").alias("bid_count"),
        F.count_distinct(bidder).alias("unique_bidders"),
        F.min(seconds_between(F.col("bid_time"), F.col(start))).alias("time_to_first_bid_seconds"),
        F.try_divide(span, (F.count("*") - 1).cast("double")).alias("avg_time_between_bids_seconds"),
        (F.count_if(left.between(0, 3600)) / F.lit(60.0)).alias("bid_velocity_last_hour"),
        F.count_if(left.between(0, 120)).alias("soft_close_bid_count"),
    )


def with_bid_position(bids: DataFrame, end: str, limit: int = WINDOW_LIMIT) -> DataFrame:
    """Sequence number, seconds to the scheduled close, and whether the bid falls in the last two minutes."""
    order = [F.col("bid_time").asc_nulls_last(), F.col("bid_id").asc()]
    left = seconds_between(F.col(end), F.col("bid_time"))
    return row_numbers(bids, ["item_id"], order, "bid_sequence", limit).withColumns(
        {
            "time_to_close_seconds": left,
            "is_soft_close_trigger": F.coalesce(left.between(0, 120), F.lit(False)).cast("int"),
        }
    )


def bid_sequences(bids: DataFrame, limit: int = WINDOW_LIMIT) -> DataFrame:
    """Every bid's place, amount and increment in its item's sequence, one row per bid.

    The first increment is the amount; one is missing where either amount is.
    """
    order = [F.col("bid_time").asc_nulls_last(), F.col("bid_id").asc()]
    placed = row_numbers(bids, ["item_id"], order, "position", limit)
    known = with_previous(placed, ["item_id"], [F.col("position").asc()], {"bid_amount": "_before"}, limit)
    step = F.when(F.col("position") == 1, F.col("bid_amount")).otherwise(F.col("bid_amount") - F.col("_before"))
    return known.select("item_id", "position", "bid_amount", step.alias("bid_increment"))


def bid_sequence_arrays(bids: DataFrame, most: int, limit: int = WINDOW_LIMIT) -> DataFrame:
    """``bid_sequences`` as one row of arrays per item, of items with at most ``most`` bids.

    The caller states the length that a row may have; longer items stay in the
    long form alone.
    """
    sequence = F.array_sort(F.collect_list(F.struct("position", "bid_amount", "bid_increment")))
    counts = bids.groupBy(F.col("item_id").alias("_item")).agg(F.count("*").alias("_bids")).filter(F.col("_bids") <= most)
    short = bids.join(counts, F.col("item_id").eqNullSafe(F.col("_item")), "left_semi")
    return (
        bid_sequences(short, limit)
        .groupBy("item_id")
        .agg(sequence.alias("_seq"))
        .select(
            "item_id",
            F.transform("_seq", lambda s: s["bid_amount"]).alias("bid_amount_sequence"),
            F.transform("_seq", lambda s: s["bid_increment"]).alias("bid_increment_sequence"),
        )
    )


def padded_sequences(
    bids: DataFrame, length: int = 100, padding: str = "post", value: str = "bid_amount", limit: int = WINDOW_LIMIT
) -> DataFrame:
    """Fixed-length sequences. ``post`` keeps the first bids and pads behind, ``pre`` the last and in front."""
    if padding not in ("pre", "post"):
        raise ValueError(f"unknown padding {padding!r}")
    forward = padding == "post"
    keys = [F.col("bid_time"), F.col("bid_id")]
    order = [k.asc_nulls_last() if forward else k.desc_nulls_first() for k in keys]
    # Only the kept places reach the collect, so the arrays are bounded.
    kept = row_numbers(bids, ["item_id"], order, "_place", limit).filter(F.col("_place") <= length)
    place = F.col("_place") if forward else -F.col("_place")
    filled = kept.groupBy("item_id").agg(
        F.array_sort(F.collect_list(F.struct(place.alias("p"), F.col(value).cast("double").alias("v")))).alias("_seq")
    )
    values = F.transform("_seq", lambda s: s["v"])
    pad = F.array_repeat(F.lit(0.0), F.lit(length) - F.size("_seq"))
    return filled.select(
        "item_id",
        F.size("_seq").cast("long").alias("length"),
        (F.concat(values, pad) if forward else F.concat(pad, values)).alias("sequence"),
    )


SOFT_CLOSE_MICROS = 120_000_000


def soft_close(bids: DataFrame, end: str, limit: int = WINDOW_LIMIT, mode: str = "bid") -> DataFrame:
    """Extensions and actual end per item. An item without an end has neither; bids without a time extend nothing.

    With ``mode="bid"`` a bid within two minutes of the current end moves the
    end to two minutes after the bid. So the extending bids form one run: it
    starts with the first bid in the last two minutes and ends at the first gap
    of more than two minutes. Finding that gap needs only the bid before each
    bid. With ``mode="end"`` it adds two minutes to the end; see
    :func:`_added_ends`.
    """
    if mode not in ("bid", "end"):
        raise ValueError(f"unknown mode {mode!r}")
    if mode == "end":
        return _added_ends(bids, end)
    close = micros(F.col(end))
    two = SOFT_CLOSE_MICROS
    rows = bids.select("item_id", "bid_id", F.unix_micros("bid_time").alias("_u"), close.alias("_end"))
    late = rows.filter(F.col("_u") >= F.col("_end") - two)
    order = [F.col("_u").asc(), F.col("bid_id").asc()]
    known = with_previous(late, ["item_id"], order, {"_u": "_before"}, limit)
    misses = F.when(F.col("_before").isNull(), F.col("_u") > F.col("_end")).otherwise(
        F.col("_u") - F.col("_before") > two
    )
    breaks = known.filter(misses).groupBy("item_id").agg(F.min("_u").alias("_stop"))
    run = left_join(known, breaks, ["item_id"]).filter(F.col("_stop").isNull() | (F.col("_u") < F.col("_stop")))
    extended = run.groupBy("item_id").agg(F.count("*").alias("_n"), F.max("_u").alias("_last"))
    ends = rows.groupBy("item_id").agg(F.max("_end").alias("_end"))
    return ends.join(extended, "item_id", "left").select(
        "item_id",
        F.coalesce("_n", F.lit(0)).alias("soft_close_extensions"),
        F.timestamp_micros(F.coalesce(F.col("_last") + two, F.col("_end"))).alias("actual_end_time"),
    )


def _added_ends(bids: DataFrame, end: str) -> DataFrame:
    """Soft close that adds two minutes to the end with each extending bid.

    After ``k`` extensions the end is ``k`` times two minutes after the first
    one, so whether a bid extends depends on ``k`` and on its place on a grid of
    two minutes alone. Cell ``n`` holds the bids from ``n`` to ``n + 1`` steps
    after the first end. A bid on the cell's lower edge counts for ``k = n`` or
    ``n + 1``, as both ends of the last two minutes belong to them; one inside
    the cell for ``k = n + 1``. When cell ``n`` begins, ``k`` is ``n`` or
    ``n + 1``, or the run is over:

    * two edge bids, or one and one inside: ``k`` is one ahead afterwards;
    * one edge bid alone: as far ahead as before;
    * bids inside only: the run goes on, one ahead, if ``k`` was;
    * an empty cell: the run goes on, not ahead, if ``k`` was.

    So the run ends where a cell without an edge bid meets a ``k`` that is not
    ahead, and ``k`` was not ahead if the last cell before that had not one edge
    bid alone was empty. Cells are counted before they move, and an item has at
    most one for every two minutes that it lasts.
    """
    at = F.col("_u") - F.col("_end")
    rows = bids.select("item_id", F.unix_micros("bid_time").alias("_u"), micros(F.col(end)).alias("_end"))
    ends = rows.groupBy("item_id").agg(F.max("_end").alias("_end"))
    cells = (
        rows.filter(at >= -SOFT_CLOSE_MICROS)
        .groupBy("item_id", F.floor(at / SOFT_CLOSE_MICROS).cast("long").alias("_cell"))
        .agg(
            F.count_if(at % SOFT_CLOSE_MICROS == 0).alias("_edge"),
            F.count_if(at % SOFT_CLOSE_MICROS != 0).alias("_inside"),
        )
    )
    order = Window.partitionBy("item_id").orderBy("_cell")
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    cell = F.col("_cell")
    # In front of the first cell stands one that leaves k ahead.
    cells = cells.withColumns(
        {
            "_before": F.lag("_cell", 1, -2).over(order),
            "_following": F.lead("_cell").over(order),
            "_alone": (F.col("_edge") == 1) & (F.col("_inside") == 0),
        }
    )
    gap = cell - F.col("_before") - 1
    cells = cells.withColumns(
        {
            "_gap": gap,
            "_last_gap": F.max(F.when(gap > 0, cell)).over(order),
            "_last_ahead": F.max(F.when(~F.col("_alone"), cell)).over(earlier),
        }
    )
    cells = cells.withColumn(
        "_ahead", F.col("_last_gap").isNull() | F.coalesce(F.col("_last_ahead") >= F.col("_last_gap"), F.lit(False))
    )
    cells = cells.withColumn("_ahead_after", ~F.col("_alone") | F.col("_ahead"))
    cells = cells.withColumn("_ahead_before", F.coalesce(F.lag("_ahead_after").over(order), F.lit(True)))
    in_gap = F.when((F.col("_gap") > 0) & ~F.col("_ahead_before"), F.col("_before") + 1).when(
        F.col("_gap") > 1, F.col("_before") + 2
    )
    here = F.when((F.col("_edge") == 0) & ~F.col("_ahead"), cell)
    behind = F.when(F.col("_following").isNull(), cell + F.when(F.col("_ahead_after"), 2).otherwise(1))
    counts = cells.groupBy(F.col("item_id").alias("_item")).agg(F.min(F.least(in_gap, here, behind)).alias("_n"))
    n = F.when(F.col("_end").isNotNull(), F.coalesce("_n", F.lit(0).cast("long")))
    return ends.join(counts, F.col("item_id").eqNullSafe(F.col("_item")), "left").select(
        "item_id",
        F.coalesce(n, F.lit(0)).alias("soft_close_extensions"),
        F.timestamp_micros(F.col("_end") + n * SOFT_CLOSE_MICROS).alias("actual_end_time"),
    )
