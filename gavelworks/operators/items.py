"""Item-grain features."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gavelworks.functions.jsons import LIST_COUNTS, list_count_columns
from gavelworks.functions.money import add_item_prices
from gavelworks.functions.text import PRESENCE_FLAGS, TEXT_LENGTHS, presence_columns, text_length_columns
from gavelworks.functions.times import as_timestamp
from gavelworks.operators.encode import Encoder, fit_item_encoder
from gavelworks.operators.joins import left_join, merge
from gavelworks.operators.scans import WINDOW_LIMIT, chunk_size, numbered, split_by_size

# Raw columns that do not belong in the final item table.
DROPPED = {
    "item_title",
    "item_description",
    "item_name",
    "item_currentBid",
    "item_current_bid",
    "item_biddingExtended",
    "item_closes",
    "item_numberOfImages",
    "item_numImages",
    "item_condition_",
    "item_working_",
}
# Final column by the names it may arrive under, best first.
SYNONYMS = {
    "item_bidding_extended": ["item_bidding_extended", "item_biddingExtended"],
    "item_number_of_images": ["item_number_of_images", "item_numberOfImages", "item_numImages"],
    "item_end_time": ["item_end_time", "item_closes", "item_endTime"],
}


def add_closing_order(
    df: DataFrame, limit: int = WINDOW_LIMIT, sizes: DataFrame | None = None
) -> DataFrame:
    """Dense rank of the end time within the auction; 0 without an end time.

    In an oversized auction the distinct end times are ranked across the
    cluster and joined back, so no task holds the whole auction. ``sizes`` is
    where auctions are counted, if not in ``df``.
    """
    out = "item_closing_order"
    source = next((c for c in ("item_end_time", "item_closes") if c in df.columns), None)
    if source is None or "auction_id" not in df.columns:
        return df.withColumn(out, F.lit(0))
    df = df.withColumn(source, as_timestamp(df, source))
    ends = F.col(source)
    parts = split_by_size(df, ["auction_id"], limit, sizes)
    rank = F.dense_rank().over(Window.partitionBy("auction_id").orderBy(ends.asc_nulls_last()))
    small = parts.small.withColumn(out, F.when(ends.isNull(), 0).otherwise(rank))
    if parts.large is None:
        return small
    times = parts.large.filter(ends.isNotNull()).select("auction_id", source).distinct()
    size = chunk_size(parts.large_rows, limit)
    ranked = numbered(times, ["auction_id"], [ends.asc()], "_rank", parts.large_rows, size)
    # Items without an auction are ranked together, as in the window.
    ranked = ranked.select(F.col("auction_id").alias("_auction"), F.col(source).alias("_end"), "_rank")
    same = parts.large["auction_id"].eqNullSafe(F.col("_auction")) & (parts.large[source] == F.col("_end"))
    large = parts.large.join(ranked, same, "left")
    large = large.withColumn(out, F.coalesce(F.col("_rank").cast("int"), F.lit(0)))
    return small.unionByName(large.select(*small.columns))


def add_lot_share(df: DataFrame, lot: str = "lot_number", out: str = "lot_number_normalized") -> DataFrame:
    """Lot number over the auction's highest one, from a pre-aggregated maximum."""
    top = df.groupBy("auction_id").agg(F.max(lot).alias("_lots"))
    joined = left_join(df, top, ["auction_id"])
    return joined.withColumn(out, F.try_divide(F.col(lot), F.col("_lots"))).drop("_lots")


def select_item_columns(df: DataFrame) -> DataFrame:
    """Engineered and kept raw columns: keys first, the rest by name."""
    aliased = {}
    for final, names in SYNONYMS.items():
        source = next((c for c in names if c in df.columns), None)
        if source is not None and source != final:
            aliased[final] = F.col(source)
    df = df.withColumns(aliased) if aliased else df
    kept = {c for c in df.columns if (c.startswith("item_") or c == "auction_id") and c not in DROPPED}
    keys = [k for k in ("item_id", "auction_id") if k in kept]
    return df.select(*keys, *[F.col(f"`{c}`") for c in sorted(kept - set(keys))])


def measured(df: DataFrame, other: DataFrame) -> DataFrame:
    """Texts and lists replaced by their lengths, flags and counts.

    Done on each side before the join, so the join moves a few integers per
    item and not the texts. Columns that ``other`` has too are left alone.
    """
    own = df.drop(*[c for c in other.columns if c in df.columns])
    features = text_length_columns(own) | presence_columns(own) | list_count_columns(own)
    sources = [c for c in [*TEXT_LENGTHS, *PRESENCE_FLAGS, *LIST_COUNTS] if c in own.columns]
    return df.withColumns(features).drop(*sources) if features else df


def engineer_item_features(
    items: DataFrame, enriched: DataFrame, encoder: Encoder | None = None, limit: int = WINDOW_LIMIT
) -> DataFrame:
    """Join items with their descriptions and build the final item table."""
    keys = ["item_id", "auction_id"]
    if encoder is None:
        encoder = fit_item_encoder(merge(items.select(*keys), enriched_in(enriched), keys, "inner"))
    df = merge(measured(items, enriched), measured(enriched, items), keys, "inner")
    expected = [*TEXT_LENGTHS.values(), *PRESENCE_FLAGS.values(), *[out for out, _ in LIST_COUNTS.values()]]
    df = df.withColumns({c: F.lit(0) for c in expected if c not in df.columns})
    # Every joined item is in ``items``, so its auctions are counted there, before the join.
    df = add_closing_order(encoder.transform(df), limit, items)
    return select_item_columns(add_item_prices(df))


def enriched_in(enriched: DataFrame) -> DataFrame:
    """Only the columns the encoder learns from, so that fitting reads nothing else."""
    wanted = ["item_id", "auction_id", "enriched_item_condition", "enriched_item_working"]
    return enriched.select(*[c for c in wanted if c in enriched.columns])


def with_sale_flags(df: DataFrame) -> DataFrame:
    """Flags stored with an item: any bid, and sold at a positive price."""
    return df.withColumns(
        {
            "has_bids": F.col("bid_count") > 0,
            "is_sold": F.col("winning_bid").isNotNull() & (F.col("winning_bid") > 0),
            "is_no_bid": (F.col("bid_count") == 0) | F.coalesce(F.col("winning_bid") == 0, F.lit(False)),
        }
    )


def prepare_target(df: DataFrame, target: str = "winning_price", zero_bids: str = "include") -> DataFrame:
    """Target column with items without bids included, excluded, or flagged apart."""
    if zero_bids == "exclude":
        return df.filter(F.col(target) > 0)
    if zero_bids == "separate":
        return df.withColumn("is_zero_bid", F.coalesce(F.col(target) == 0, F.lit(False)).cast("int"))
    if zero_bids != "include":
        raise ValueError(f"unknown handling {zero_bids!r}")
    return df
