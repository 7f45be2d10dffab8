"""Train, validation and test splits decided by a hash of the key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gavelworks.operators.joins import left_join
from gavelworks.operators.scans import WINDOW_LIMIT, row_numbers

RATIOS = (0.7, 0.15, 0.15)
SEED = 42


def draw(key: str, seed: int = SEED) -> Column:
    """Uniform number in [0, 1) fixed by key and seed, on any engine and partitioning."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(float(2**32))


def _name(share: Column, ratios: tuple[float, float, float]) -> Column:
    train, validation, _ = ratios
    return F.when(share < train, "train").when(share < train + validation, "validation").otherwise("test")


def with_split(
    df: DataFrame,
    key: str,
    ratios: tuple[float, float, float] = RATIOS,
    stratify: str | None = None,
    seed: int = SEED,
    limit: int = WINDOW_LIMIT,
) -> DataFrame:
    """Adds ``split``. Rows with the same key stay together.

    Without strata this is a projection. With strata the rows of each stratum
    are ranked by their draw, which gives each its exact shares; strata are
    few and long, so the ranking is spread over tasks.
    """
    if abs(sum(ratios) - 1.0) >= 1e-6:
        raise ValueError("ratios must add up to 1")
    if stratify is None:
        return df.withColumn("split", _name(draw(key, seed), ratios))
    totals = df.groupBy(stratify).agg(F.count("*").alias("_total"))
    counted = left_join(df, totals, [stratify])
    order = [draw(key, seed).asc(), F.col(key).asc()]
    ranked = row_numbers(counted, [stratify], order, "_place", limit, sizes=df)
    share = (F.col("_place") - 1) / F.col("_total")
    return ranked.withColumn("split", _name(share, ratios)).drop("_place", "_total")


def split_frames(df: DataFrame, key: str, **options) -> tuple[DataFrame, DataFrame, DataFrame]:
    marked = with_split(df, key, **options)
    return tuple(marked.filter(F.col("split") == s).drop("split") for s in ("train", "validation", "test"))
