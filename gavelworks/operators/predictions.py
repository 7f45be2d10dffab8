"""Fusing model predictions, and measuring them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _mean(values: Column) -> Column:
    return F.try_divide(F.aggregate(values, F.lit(0.0), lambda s, x: s + x), F.size(values).cast("double"))


def add_fusion(df: DataFrame, models: Sequence[str]) -> DataFrame:
    """Mean of the predictions there are, with a 95 % interval from their spread.

    One prediction alone is given a deviation of a fifth of itself; none gives
    zeros. The lower end is not negative.
    """
    given = F.filter(F.array(*[F.col(m).cast("double") for m in models]), lambda x: x.isNotNull())
    df = df.withColumn("_given", given)
    values = F.col("_given")
    df = df.withColumn("predicted_price", F.coalesce(_mean(values), F.lit(0.0)))
    mean = F.col("predicted_price")
    spread = F.sqrt(_mean(F.transform(values, lambda x: (x - mean) * (x - mean))))
    deviation = F.when(F.size(values) > 1, spread).when(F.size(values) == 1, mean * 0.2).otherwise(0.0)
    margin = deviation * 1.96
    return df.withColumns(
        {
            "confidence_lower": F.greatest(mean - margin, F.lit(0.0)),
            "confidence_upper": mean + margin,
        }
    ).drop("_given")


def prediction_record(models: Sequence[str]) -> Column:
    """Prediction, interval and model values to two decimals, as one struct."""
    two = lambda c: F.round(F.col(c), 2)
    return F.struct(
        F.col("item_id").cast("string").alias("item_id"),
        two("predicted_price").alias("predicted_price"),
        F.struct(two("confidence_lower").alias("lower"), two("confidence_upper").alias("upper")).alias(
            "confidence_interval"
        ),
        F.struct(*[two(m).alias(m) for m in models]).alias("model_predictions"),
    )


def _metrics(actual: Column, predicted: Column, keep: Column) -> dict[str, Column]:
    y = F.when(keep, actual)
    error = y - F.when(keep, predicted)
    residual = F.sum(error * error)
    total = F.var_pop(y) * F.count(y)
    return {
        "mae": F.avg(F.abs(error)),
        "rmse": F.sqrt(F.avg(error * error)),
        "mape": F.avg(F.when(y != 0, F.abs(error) / F.abs(y))),
        "r2": 1 - F.try_divide(residual, total),
    }


def regression_metrics(
    df: DataFrame, actual: str, predicted: str, has_bids: Column, by: Sequence[str] = ()
) -> DataFrame:
    """MAE, RMSE, MAPE and R2 over all items, and over those with and without bids, in one pass."""
    known = F.col(actual).isNotNull() & F.col(predicted).isNotNull()
    bid_on = F.coalesce(has_bids, F.lit(False))
    scopes = {"all_items": known, "items_with_bids": known & bid_on, "items_no_bids": known & ~bid_on}
    out = [
        c.alias(f"{scope}_{name}")
        for scope, keep in scopes.items()
        for name, c in _metrics(F.col(actual).cast("double"), F.col(predicted).cast("double"), keep).items()
    ]
    return df.groupBy(*by).agg(*out) if by else df.agg(*out)


def pinball_loss(df: DataFrame, actual: str, quantiles: dict[str, float]) -> DataFrame:
    """Mean quantile loss per prediction column, and their sum."""
    losses = {}
    for column, q in quantiles.items():
        error = F.col(actual) - F.col(column)
        losses[column] = F.avg(F.greatest(error * q, error * (q - 1)))
    total = sum(losses.values(), F.lit(0.0))
    return df.agg(*[v.alias(f"loss_{c}") for c, v in losses.items()], total.alias("loss_total"))


def scored_predictions(predictions: DataFrame, items: DataFrame) -> DataFrame:
    """Metrics per model version and prediction type, against the items' final prices."""
    actual = items.select("item_id", F.col("winning_bid").alias("actual_winning_bid"), "bid_count")
    joined = predictions.join(actual, "item_id", "left")
    return regression_metrics(
        joined, "actual_winning_bid", "pred_fusion", F.col("bid_count") > 0, ["model_version", "prediction_type"]
    )
