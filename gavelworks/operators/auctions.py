"""Auction-grain features."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gavelworks.functions.pickup import add_pickup_windows
from gavelworks.functions.places import add_auction_area_ratios, add_fsa, add_area_ratios, add_location_features
from gavelworks.functions.text import add_partner_flag
from gavelworks.functions.times import add_auction_duration, add_auction_lengths, add_bid_timing, add_calendar
from gavelworks.operators.encode import Encoder, fit_auction_encoder
from gavelworks.operators.joins import merge

# Raw columns that do not belong in the final auction table.
DROPPED = {
    "auction_title",
    "auction_intro",
    "auction_removal_info",
    "auction_partner_url",
    "auction_pickup_time",
    "auction_fsa",
}
# Auction column by area-lookup column.
AREA_NAMES = {
    "Population, 2021": "auction_area_population",
    "Total private dwellings, 2021": "auction_area_total_dwellings",
    "Private dwellings occupied by usual residents, 2021": "auction_area_occupied_dwellings",
    "Number of Returns": "auction_area_tax_returns",
    "Total Income": "auction_area_total_income",
    "Average Total Income": "auction_area_avg_income",
    "Median Total Income": "auction_area_median_income",
}


def roll_up_items(items: DataFrame) -> DataFrame:
    """Totals per auction over its items; a missing value counts as 0."""
    total = lambda c: F.sum(F.coalesce(F.col(c), F.lit(0)))
    return items.groupBy("auction_id").agg(
        total("viewed").alias("total_viewed"),
        total("current_bid").alias("total_winning_price"),
        total("bid_count").alias("total_bid_count"),
        total("number_of_images").alias("total_images"),
        F.count("*").alias("catalog_lots"),
    )


def add_item_averages(df: DataFrame) -> DataFrame:
    """Auction totals per item; NULL for an auction without items."""
    if "auction_item_count" not in df.columns:
        return df
    names = {
        "auction_total_viewed": "auction_avg_views_per_item",
        "auction_total_winning_price": "auction_avg_price_per_item",
        "auction_total_bid_count": "auction_avg_bids_per_item",
        "auction_total_images": "auction_avg_images_per_item",
    }
    return df.withColumns(
        {
            out: F.try_divide(F.col(c).cast("double"), F.col("auction_item_count").cast("double"))
            for c, out in names.items()
            if c in df.columns
        }
    )


def join_area(df: DataFrame, areas: DataFrame, key: str = "auction_fsa") -> DataFrame:
    """Area statistics by postal area.

    There are at most 26 * 10 * 26 areas of the form letter-digit-letter, one
    row each, so the lookup is broadcast whatever the size of the auctions. An
    area that comes twice makes the run fail: which row is meant is unknown.
    """
    valid = areas.filter(F.col("FSA").rlike("^[A-Z][0-9][A-Z]$"))
    rest = [c for c in valid.columns if c != "FSA"]
    one = valid.groupBy("FSA").agg(F.count("*").alias("_rows"), *[F.first(c).alias(c) for c in rest])
    repeated = F.raise_error(F.concat(F.lit("area given more than once: "), F.col("FSA")))
    valid = one.withColumn("FSA", F.when(F.col("_rows") > 1, repeated).otherwise(F.col("FSA"))).drop("_rows")
    lookup = F.broadcast(valid.withColumnRenamed("FSA", "_area"))
    return df.join(lookup, F.col(key) == F.col("_area"), "left").drop("_area")


def add_area_features(df: DataFrame, areas: DataFrame | None) -> DataFrame:
    if areas is None or "auction_fsa" not in df.columns:
        return df
    return add_auction_area_ratios(join_area(df, areas).withColumnsRenamed(AREA_NAMES))


def enrich_by_postal_code(
    df: DataFrame, areas: DataFrame, postal_code: str = "postal_code", fsa: str | None = None, ratios: bool = True
) -> DataFrame:
    """Area columns under their own names, with the generic ratios."""
    if fsa is None:
        df, fsa = add_fsa(df, postal_code), "fsa"
    out = join_area(df, areas, fsa)
    return add_area_ratios(out) if ratios else out


def select_auction_columns(df: DataFrame) -> DataFrame:
    """Engineered and kept raw columns: the key first, the rest by name."""
    kept = {c for c in df.columns if c.startswith("auction_") and c not in DROPPED}
    keys = [k for k in ("auction_id",) if k in kept]
    return df.select(*keys, *[F.col(f"`{c}`") for c in sorted(kept - set(keys))])


def engineer_auction_features(
    auctions: DataFrame, enriched: DataFrame, areas: DataFrame | None = None, encoder: Encoder | None = None
) -> DataFrame:
    """The final auction table.

    The notes and links are read before the join, which then moves numbers
    instead of HTML.
    """
    encoder = encoder or fit_auction_encoder(enriched_for(auctions, enriched))
    df = add_pickup_windows(add_auction_lengths(auctions), prefix="auction_")
    df = add_item_averages(add_partner_flag(df)).drop(*DROPPED)
    df = merge(df, enriched, ["auction_id"], "left", limit=None)
    df = add_area_features(add_location_features(df), areas)
    return select_auction_columns(encoder.transform(df))


def enriched_for(auctions: DataFrame, enriched: DataFrame) -> DataFrame:
    """What the encoder learns from: the categories as the auctions see them."""
    return merge(auctions.select("auction_id"), enriched, ["auction_id"], "left", limit=None)


def engineer_auction_times(df: DataFrame) -> DataFrame:
    """Pickup windows, calendar features of start and end, and the duration."""
    df = add_pickup_windows(df)
    for name in ("start", "end"):
        if f"{name}_time" in df.columns:
            df = add_calendar(df, f"{name}_time", f"auction_{name}_")
    if {"start_time", "end_time"} <= set(df.columns):
        df = add_auction_duration(df)
    return df


def engineer_bid_times(df: DataFrame) -> DataFrame:
    """Calendar features of the bid time, and its place in the auction when that is known."""
    if "bid_time" in df.columns:
        df = add_calendar(df, "bid_time", "bid_")
    if {"bid_time", "auction_start_time", "auction_end_time"} <= set(df.columns):
        df = add_bid_timing(df)
    return df


def feature_bundle(auctions: DataFrame, items: DataFrame, bids: DataFrame) -> dict[str, DataFrame]:
    """The three tables with their calendar features, by grain."""
    return {"auctions": engineer_auction_times(auctions), "items": items, "bids": engineer_bid_times(bids)}


def is_completed(status) -> F.Column:
    return F.lower(status).isin("completed", "closed", "ended")
