"""Categorical encoders: one small aggregate to fit, a projection or join to apply."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gavelworks.functions.text import clean_level
from gavelworks.operators.joins import KEY_LIMIT, left_join
from gavelworks.session import written

MAX_LEVELS = 20
# One-hot columns a plan can reasonably have.
MAX_COLUMNS = 5000

# Output prefix by source column.
AUCTION_CATEGORIES = {
    "enriched_auction_category": "auction_category",
    "enriched_auction_type": "auction_type",
    "enriched_auction_displayRegion": "auction_region",
    "enriched_auction_approxLocation_city": "auction_city",
    "enriched_auction_approxLocation_countryCode": "auction_country",
    "enriched_auction_approxLocation_regionCode": "auction_province",
}
ITEM_CATEGORIES = {"enriched_item_condition": "item_condition", "enriched_item_working": "item_working"}


def or_unknown(value: Column, placeholders: Sequence[str] = ()) -> Column:
    filled = F.coalesce(value, F.lit("Unknown"))
    return F.when(filled.isin(*placeholders), "Unknown").otherwise(filled) if placeholders else filled


def level_counts(df: DataFrame, columns: Sequence[str], placeholders: Sequence[str] = ()) -> DataFrame:
    """Rows per (column, level), for all columns in one pass.

    Levels are counted map-side first, so a level that holds most rows costs
    one shuffled row per map task. The counts are written once; fitting and
    the joins of the frequency encoding both read them.
    """
    pairs = F.array(
        *[F.struct(F.lit(c).alias("name"), or_unknown(F.col(c), placeholders).alias("level")) for c in columns]
    )
    counted = df.select(F.explode(pairs).alias("p")).groupBy("p.name", "p.level").agg(F.count("*").alias("n"))
    return written(counted, "levels")


@dataclass
class Encoder:
    """Fitted encoder. ``levels`` lists the one-hot columns; other columns use ``counts``."""

    prefixes: dict[str, str]
    levels: dict[str, list[str]]
    counts: DataFrame | None = None
    total: int = 0
    placeholders: tuple[str, ...] = ()
    lower: bool = False
    # Rows of the most frequent level of each column.
    largest: dict[str, int] = field(default_factory=dict)

    def transform(self, df: DataFrame) -> DataFrame:
        for column, prefix in self.prefixes.items():
            if column not in df.columns:
                continue
            df = df.withColumn(column, or_unknown(F.col(column), self.placeholders))
            if column in self.levels:
                df = df.withColumns(self._one_hot(column, prefix, df.columns))
            else:
                df = self._frequency(df, column, prefix)
        return df

    def _one_hot(self, column: str, prefix: str, taken: Sequence[str]) -> dict[str, Column]:
        out: dict[str, Column] = {}
        for level in sorted(self.levels[column]):
            name = f"{prefix}_{clean_level(level, self.lower)}"
            if self.lower:
                name = name.lower()
            if name in out or name in taken:
                raise ValueError(f"two levels give the column {name!r}")
            out[name] = (F.col(column) == level).cast("int")
        return out

    def _frequency(self, df: DataFrame, column: str, prefix: str) -> DataFrame:
        counts = self.counts.filter(F.col("name") == column).select(
            F.col("level").alias(column),
            (F.col("n") / F.lit(self.total)).alias(f"{prefix}_frequency"),
            F.col("n").alias(f"{prefix}_count"),
        )
        # The counts tell whether any level is too large for one task.
        limit = KEY_LIMIT if self.largest.get(column, 0) > KEY_LIMIT else None
        return left_join(df, counts, [column], limit)


def fit(
    df: DataFrame,
    prefixes: dict[str, str],
    max_levels: int | None = MAX_LEVELS,
    categories: dict[str, list[str]] | None = None,
    placeholders: tuple[str, ...] = (),
    lower: bool = False,
) -> Encoder:
    """Learn levels, or take them from ``categories`` so that the output schema is fixed.

    Columns with more than ``max_levels`` levels are frequency encoded; with
    ``None`` every column is one-hot encoded.
    """
    fixed = dict(categories or {})
    present = {c: p for c, p in prefixes.items() if c in df.columns}
    open_columns = [c for c in present if c not in fixed]
    if not open_columns:
        return Encoder(present, fixed, placeholders=placeholders, lower=lower)
    counts = level_counts(df, open_columns, placeholders)
    sizes = {
        row["name"]: (row["levels"], row["total"], row["largest"])
        for row in counts.groupBy("name")
        .agg(F.count("*").alias("levels"), F.sum("n").alias("total"), F.max("n").alias("largest"))
        .collect()
    }
    narrow = [c for c in open_columns if c in sizes and (max_levels is None or sizes[c][0] <= max_levels)]
    for column in open_columns:
        if column in narrow or column not in sizes:
            fixed[column] = []
    if sum(sizes[c][0] for c in narrow) > MAX_COLUMNS:
        raise ValueError("too many levels for one-hot columns: pass max_levels or categories")
    # One-hot levels become columns, so they are few.
    for row in counts.filter(F.col("name").isin(narrow)).select("name", "level").collect():
        fixed[row["name"]].append(row["level"])
    total = max((t for _, t, _ in sizes.values()), default=0)
    largest = {name: n for name, (_, _, n) in sizes.items()}
    return Encoder(present, fixed, counts, total, placeholders, lower, largest)


def fit_auction_encoder(df: DataFrame, categories: dict[str, list[str]] | None = None) -> Encoder:
    return fit(df, AUCTION_CATEGORIES, MAX_LEVELS, categories)


def fit_item_encoder(df: DataFrame, categories: dict[str, list[str]] | None = None) -> Encoder:
    return fit(df, ITEM_CATEGORIES, None, categories, ("", "unknown"), lower=True)


def add_label_codes(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """0-based code of each value in sorted order, as output name by source column.

    The codes are ranked over the distinct values and joined back; a value that
    most rows have is spread over several tasks.
    """
    from gavelworks.operators.scans import row_numbers

    for source, out in columns.items():
        levels = df.filter(F.col(source).isNotNull()).select(source).distinct()
        codes = row_numbers(levels.withColumn("_all", F.lit(0)), ["_all"], [F.col(source).asc()], out)
        df = left_join(df, codes.select(source, (F.col(out) - 1).alias(out)), [source])
    return df
