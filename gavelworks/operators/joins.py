"""Merges with pandas-style column suffixes, safe for keys that hold much of the data."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gavelworks.operators.scans import split_by_size
from gavelworks.session import written

# Rows of one join key that one task should handle.
KEY_LIMIT = 2_000_000


def suffixed(left: DataFrame, right: DataFrame, on: Sequence[str], suffixes: tuple[str, str]):
    """Rename the columns both sides have, other than the keys."""
    shared = (set(left.columns) & set(right.columns)) - set(on)
    first, second = suffixes
    if shared and first == second:
        raise ValueError(f"columns overlap but no suffix tells them apart: {sorted(shared)}")
    return (
        left.withColumnsRenamed({c: c + first for c in shared}),
        right.withColumnsRenamed({c: c + second for c in shared}),
    )


def left_join(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[str],
    limit: int | None = KEY_LIMIT,
    sizes: DataFrame | None = None,
) -> DataFrame:
    """Left join whose heavy keys are spread over several tasks.

    AQE broadcasts a right side that turns out small, by its measured bytes.
    Otherwise rows of a heavy key get a salt on the left and its rows on the
    right are repeated once per salt; a key has one salt for each ``limit`` of
    its own rows. ``limit=None`` says that the keys are unique on the left, so
    there is nothing to look for. ``sizes`` may name a cheaper frame to count
    the keys in.
    """
    on = list(on)
    if limit is None:
        return left.join(right, on, "left")
    parts = split_by_size(left, on, limit, sizes)
    if parts.large is None:
        return left.join(right, on, "left")
    joined = parts.small.join(right, on, "left")
    heavy = parts.large.groupBy(*[F.col(k).alias(f"_heavy_{k}") for k in on]).agg(F.count("*").alias("_rows"))
    heavy = written(heavy.select(*[f"_heavy_{k}" for k in on], F.ceil(F.col("_rows") / limit).alias("_salts")), "heavy")
    same = lambda df: reduce(lambda a, b: a & b, [df[k].eqNullSafe(heavy[f"_heavy_{k}"]) for k in on])
    # Maps and variants cannot be hashed; the other columns tell the rows apart well enough.
    spreading = [F.col(f"`{c}`") for c, kind in left.dtypes if "map<" not in kind and "variant" not in kind]
    salted = parts.large.join(heavy, same(parts.large)).withColumn(
        "_salt", F.pmod(F.xxhash64(*spreading), F.col("_salts"))
    )
    copies = right.join(heavy, same(right)).withColumn(
        "_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_salts") - 1))
    )
    added = [f"_heavy_{k}" for k in on] + ["_salts"]
    salted = salted.drop(*added).join(copies.drop(*added), [*on, "_salt"], "left").drop("_salt")
    return joined.unionByName(salted)


def merge(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[str],
    how: str = "left",
    suffixes: tuple[str, str] = ("_x", "_y"),
    limit: int | None = KEY_LIMIT,
) -> DataFrame:
    """Equi-join with suffixes. ``how`` is inner, left or full.

    The full join is a left join plus the right rows nobody asked for, found
    against the distinct left keys: a heavy key costs one row there.
    """
    left, right = suffixed(left, right, on, suffixes)
    if how == "inner":
        both = left_join(left, right.withColumn("_met", F.lit(True)), on, limit)
        return both.filter("_met").drop("_met")
    joined = left_join(left, right, on, limit)
    if how == "left":
        return joined
    if how != "full":
        raise ValueError(f"unknown join {how!r}")
    alone = right.join(left.select(*on).distinct(), list(on), "left_anti")
    return joined.unionByName(alone, allowMissingColumns=True)


def merge_auctions_items(
    auctions: DataFrame,
    items: DataFrame,
    suffixes: tuple[str, str] = ("_auction", "_item"),
    limit: int = KEY_LIMIT,
) -> DataFrame:
    """Full outer merge on ``auction_id``; items unchanged when they have no such column."""
    if "auction_id" not in items.columns:
        return items
    first, second = suffixes
    merged = merge(items, auctions, ["auction_id"], "full", (second, first), limit)
    own_auctions, own_items = suffixed(auctions, items, ["auction_id"], suffixes)
    rest = [c for c in own_items.columns if c != "auction_id"]
    return merged.select(*own_auctions.columns, *rest)


def merge_bids(
    bids: DataFrame,
    auction_items: DataFrame,
    how: str = "left",
    suffixes: tuple[str, str] = ("_bid", ""),
    limit: int = KEY_LIMIT,
) -> DataFrame:
    """Join bids with the merged auctions and items on the keys both have."""
    keys = [k for k in ("auction_id", "item_id") if k in bids.columns and k in auction_items.columns]
    if not keys:
        raise ValueError("Cannot merge datasets: no common keys (auction_id, item_id)")
    return keys_first(merge(bids, auction_items, keys, how, suffixes, limit))


def with_auction_times(
    bids: DataFrame, auctions: DataFrame, start: str = "auction_starts", end: str = "auction_ends"
) -> DataFrame:
    """Scheduled start and end of the auction on every bid."""
    schedule = auctions.select(
        "auction_id", F.col(start).alias("auction_start_time"), F.col(end).alias("auction_end_time")
    )
    return left_join(bids, schedule, ["auction_id"])


def keys_first(df: DataFrame, keys: Sequence[str] = ("auction_id", "item_id")) -> DataFrame:
    first = [k for k in keys if k in df.columns]
    return df.select(*first, *[F.col(f"`{c}`") for c in df.columns if c not in first])


def not_done(pending: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose keys are not among the finished ones. A missing key equals a missing key."""
    finished = done.select(*[F.col(k).alias(f"_done_{k}") for k in keys]).distinct()
    same = reduce(lambda a, b: a & b, [pending[k].eqNullSafe(finished[f"_done_{k}"]) for k in keys])
    return pending.join(finished, same, "left_anti")


def latest_status(log: DataFrame, keys: Sequence[str], at: str = "at") -> DataFrame:
    """Last recorded status per key: finishing a key takes it off the failed ones."""
    return log.groupBy(*keys).agg(F.max_by("status", at).alias("status"))


def items_full(items: DataFrame, auctions: DataFrame, enriched: DataFrame, features: DataFrame) -> DataFrame:
    """Items with auction, estimate and category columns."""
    wanted: list[tuple[DataFrame, str, dict[str, str]]] = [
        (
            auctions,
            "auction_id",
            {
                "title": "auction_title",
                "location_city": "location_city",
                "auction_type": "auction_type",
                "actual_end_time": "auction_end_time",
            },
        ),
        (
            enriched,
            "item_id",
            {c: c for c in ("estimated_value_low", "estimated_value_high", "condition_score", "popularity_score")},
        ),
        (features, "item_id", {c: c for c in ("category_avg_price", "category_median_price")}),
    ]
    out = items
    for table, key, names in wanted:
        right = table.select(key, *[F.col(c).alias(n) for c, n in names.items()])
        out = left_join(out, right, [key]) if key == "auction_id" else out.join(right, key, "left")
    return out


def training_data(items: DataFrame, features: DataFrame, sequences: DataFrame) -> DataFrame:
    """Items with a known price, their features and bid-sequence statistics."""
    target = items.filter(F.col("winning_bid").isNotNull()).select(
        "item_id", F.col("winning_bid").alias("target"), "has_bids", "is_sold"
    )
    sequence = sequences.select(
        "item_id",
        F.col("bid_count").alias("seq_bid_count"),
        F.col("unique_bidders").alias("seq_unique_bidders"),
        "soft_close_extensions",
    )
    return target.join(features, "item_id").join(sequence, "item_id", "left")


def register_views(tables: dict[str, DataFrame]) -> None:
    """Temp views for the tables, and the two joined views over them."""
    for name, df in tables.items():
        df.createOrReplaceTempView(name)
    items_full(
        tables["items"], tables["auctions"], tables["item_enriched"], tables["features_tabular"]
    ).createOrReplaceTempView("v_items_full")
    training_data(
        tables["items"], tables["features_tabular"], tables["features_sequential"]
    ).createOrReplaceTempView("v_training_data")


def with_vectors(features: DataFrame, vectors: DataFrame, on: Sequence[str] = ("item_id",), limit: int = KEY_LIMIT) -> DataFrame:
    """Rows that have a vector, with it. Columns that both sides have keep their name in the features and get ``_vector``."""
    return merge(features, vectors, list(on), "inner", ("", "_vector"), limit)
