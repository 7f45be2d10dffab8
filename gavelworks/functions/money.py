"""Bid-increment rules and price expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Minimum increment by current bid, as (upper bound, increment).
INCREMENT_STEPS = [(10, 1), (40, 3), (100, 5), (1000, 10), (5000, 50), (10000, 100)]
TOP_INCREMENT = 250


def expected_increment(bid: Column) -> Column:
    """Minimum next increment. Amounts outside the table take the top step."""
    step = F.when(bid < 0, TOP_INCREMENT)
    for upper, increment in INCREMENT_STEPS:
        step = step.when(bid < upper, increment)
    return step.otherwise(TOP_INCREMENT)


def is_unusual_increment(previous: Column, current: Column) -> Column:
    """Below the minimum, or more than three times it. False when either bid is missing."""
    increment, expected = current - previous, expected_increment(previous)
    return F.coalesce((increment < expected) | (increment > 3 * expected), F.lit(False))


def increment_deviation(previous: Column, current: Column) -> Column:
    """Actual over expected increment; NULL without a positive previous bid."""
    return F.when(previous > 0, (current - previous) / expected_increment(previous))


def log_price(price: Column) -> Column:
    return F.log1p(F.greatest(F.coalesce(price.cast("double"), F.lit(0.0)), F.lit(0.0)))


def add_item_prices(df: DataFrame) -> DataFrame:
    """Raw winning price and its log; both 0 when no price column is present."""
    source = next((c for c in ("item_current_bid", "item_currentBid") if c in df.columns), None)
    if source is None:
        return df.withColumns({"item_winning_price_raw": F.lit(0), "item_winning_price_log1p": F.lit(0)})
    price = F.col(source)
    return df.withColumns({"item_winning_price_raw": price, "item_winning_price_log1p": log_price(price)})
