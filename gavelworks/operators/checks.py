"""Column and value checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

# Fields of the auction table that must be there, or be numbers.
AUCTION_OUTPUT_FIELDS = [
    "auction_id",
    "auction_title",
    "auction_item_count",
    "auction_total_viewed",
    "auction_total_winning_price",
    "auction_total_bid_count",
    "auction_total_images",
]
NUMERIC_FIELDS = ["item_count", "total_viewed", "total_winning_price", "total_bid_count", "total_images"]


def missing_columns(df: DataFrame, wanted: Sequence[str]) -> list[str]:
    return [c for c in wanted if c not in df.columns]


def require_columns(df: DataFrame, wanted: Sequence[str]) -> None:
    """Fail while the plan is built, before any data is read."""
    missing = missing_columns(df, wanted)
    if missing:
        raise ValueError(f"Missing required columns: {missing}")


def with_invalid_numbers(df: DataFrame, fields: Sequence[str] = NUMERIC_FIELDS, out: str = "invalid_fields") -> DataFrame:
    """Names of the fields whose value is there but is not a number."""
    bad = [
        F.when(F.col(c).isNotNull() & F.col(c).cast("string").try_cast("double").isNull(), F.lit(c))
        for c in fields
        if c in df.columns
    ]
    names = F.array(*bad) if bad else F.array().cast("array<string>")
    return df.withColumn(out, F.filter(names, lambda c: c.isNotNull()))


def item_rules() -> dict[str, Column]:
    """What is wrong with an item: no title, a negative price, bids announced but not recorded."""
    return {
        "Missing title": F.col("title").isNull() | (F.col("title") == ""),
        "Negative winning bid": F.col("winning_bid") < 0,
        "Bid count mismatch": (F.col("bid_count") > 0) & (F.coalesce(F.col("recorded_bids"), F.lit(0)) == 0),
    }


def with_item_errors(df: DataFrame, out: str = "errors") -> DataFrame:
    """Validation messages of an item, by :func:`item_rules`."""
    messages = F.array(*[F.when(rule, F.lit(text)) for text, rule in item_rules().items()])
    return df.withColumn(out, F.filter(messages, lambda m: m.isNotNull()))


def column_rules(df: DataFrame, wanted: Sequence[str], numbers: Sequence[str] = ()) -> dict[str, Column]:
    """A rule for each wanted column, that it is there and filled, and for each number, that it is one."""
    out = {f"Missing {c}": F.col(f"`{c}`").isNull() if c in df.columns else F.lit(True) for c in wanted}
    for c in numbers:
        if c in df.columns:
            text = F.col(f"`{c}`").cast("string")
            out[f"Not a number: {c}"] = text.isNotNull() & text.try_cast("double").isNull()
    return out


REPORT = "rule string, broken long, rows long"


def write_with_report(df: DataFrame, path: str, report: str, rules: dict[str, Column], mode: str = "overwrite") -> None:
    """Write the rows as they are, and beside them how many break each rule.

    The rules are counted as the rows pass on their way to the files, so the
    source is read once and nothing is computed twice. ``report`` gets one row a
    rule, in the order of the rules. A rule that is NULL for a row is not broken.
    """
    spark = df.sparkSession
    seen = Observation()
    counts = [F.count_if(F.coalesce(rule, F.lit(False))).alias(f"broken_{i}") for i, rule in enumerate(rules.values())]
    df.observe(seen, F.count(F.lit(1)).alias("rows"), *counts).write.mode(mode).parquet(path)
    found = seen.get
    rows = [(name, found[f"broken_{i}"], found["rows"]) for i, name in enumerate(rules)]
    spark.createDataFrame(rows, REPORT).coalesce(1).write.mode(mode).parquet(report)
