"""Bid features: hand-computed values, causality, ties, and equality of the two paths."""

from __future__ import annotations

import math

import pandas as pd
import pytest
from rows import by
from pyspark.sql import functions as F

from gavelworks.operators.bids import GROUPS, engineer_bid_features
from gavelworks.sources.bindings import bids

COLUMNS = "auction_id long, item_id long, bid_time string, bid_number int, bid_amount double, is_proxy_bid boolean"


def at(minute, second=0, hour=10):
    return f"2024-01-01 {hour:02d}:{minute:02d}:{second:02d}"


def frame(spark, rows):
    return spark.createDataFrame(rows, COLUMNS)


@pytest.fixture(scope="module")
def two_items(spark):
    return frame(
        spark,
        [
            (1, 100, at(0), 1, 5.0, False),
            (1, 100, at(5), 2, 10.0, True),
            (1, 100, at(6), 3, 15.0, False),
            (1, 200, at(0), 1, 50.0, False),
            (1, 200, at(0, 20), 2, 48.0, False),
        ],
    )


def features(df, **options):
    return by(engineer_bid_features(df, **options).collect(), "item_id", "bid_number")


def column(rows, name, item=100):
    return [r[name] for r in rows if r["item_id"] == item]


def test_times(two_items):
    rows = features(two_items)
    assert column(rows, "time_since_first_bid_seconds") == [0, 300, 360]
    assert column(rows, "time_since_last_bid_seconds") == [0, 300, 60]
    assert column(rows, "time_since_first_bid_minutes") == [0, 5, 6]
    assert column(rows, "elapsed_time_fraction") == [0, 1, 1]


def test_counts(two_items):
    rows = features(two_items)
    assert column(rows, "number_of_bids_so_far") == [1, 2, 3]
    assert column(rows, "is_first_bid") == [1, 0, 0]
    # The window's left edge is closed: a bid exactly 60 or 300 s earlier counts.
    assert column(rows, "rolling_bid_count_1min") == [1, 1, 2]
    assert column(rows, "rolling_bid_count_5min") == [1, 2, 2]
    assert column(rows, "bid_acceleration") == pytest.approx([0.2, 0.4, 0.4 - 0.2])
    k = math.log(2) / 120
    assert column(rows, "time_weighted_bid_velocity") == pytest.approx(
        [1, 1 + math.exp(-k * 300), 1 + math.exp(-k * 60) + math.exp(-k * 360)]
    )


def test_amounts(two_items):
    rows = features(two_items)
    assert column(rows, "bid_increment") == [5, 5, 5]
    assert column(rows, "bid_increment_pct") == [None, 100, 50]
    assert column(rows, "is_unusual_increment") == [0, 1, 0]
    assert column(rows, "increment_deviation_ratio") == pytest.approx([None, 5, 5 / 3])
    assert column(rows, "proxy_bid_flag") == [0, 1, 0]
    assert column(rows, "bid_amount_percentile_so_far") == [100, 100, 100]
    assert column(rows, "bid_amount_percentile_so_far", 200) == [100, 50]
    assert column(rows, "bid_amount_relative_to_mean") == [0, 2.5, 5]
    assert column(rows, "bid_amount_relative_to_median") == [0, 2.5, 5]
    assert column(rows, "bid_amount_relative_to_max", 200) == [1, 0.96]
    assert column(rows, "cumulative_bid_increment_sum") == [5, 10, 15]
    assert column(rows, "rolling_avg_increment_5", 200) == [50, 24]


def test_progress(two_items):
    rows = features(two_items)
    assert column(rows, "current_to_starting_bid_ratio") == [1, 2, 3]
    assert column(rows, "is_new_high", 200) == [1, 0]
    assert column(rows, "bid_number_normalized") == [1, 1, 1]
    overall, recent = 10 / 3, 10 / 3
    assert column(rows, "bid_momentum") == pytest.approx([0, 0, (recent - overall) / overall])


def test_clusters(spark):
    seconds = [0, 10, 20, 30, 90, 95, 300, 330]
    rows = features(frame(spark, [(1, 7, at(s // 60, s % 60), i + 1, 5.0 + i, False) for i, s in enumerate(seconds)]))
    assert column(rows, "bid_cluster_size_so_far", 7) == [1, 2, 3, 4, 1, 2, 1, 2]
    assert column(rows, "time_since_cluster_start_seconds", 7) == [0, 10, 20, 30, 0, 5, 0, 30]
    assert column(rows, "is_in_bid_cluster", 7) == [0, 1, 1, 1, 0, 1, 0, 1]


def test_bad_time_comes_last_and_zero_amount_has_no_ratio(spark):
    rows = features(frame(spark, [(1, 1, "nonsense", 1, 3.0, False), (1, 1, at(1), 2, 0.0, False), (1, 1, at(2), 3, 4.0, False)]))
    assert column(rows, "number_of_bids_so_far", 1) == [3, 1, 2]
    assert column(rows, "current_to_starting_bid_ratio", 1) == [None, None, None]
    assert column(rows, "bid_increment_pct", 1)[2] is None


def test_starting_bid_column(spark, two_items):
    rows = features(two_items.withColumn("start", F.lit(2.5)), starting_bid="start")
    assert column(rows, "current_to_starting_bid_ratio") == [2, 4, 6]


def test_missing_columns_and_missing_order_raise(spark, two_items):
    with pytest.raises(ValueError, match="bid_amount"):
        engineer_bid_features(two_items.drop("bid_amount"))
    with pytest.raises(ValueError, match="tiebreak"):
        engineer_bid_features(two_items.drop("bid_number"))
    with pytest.raises(ValueError, match="unknown feature groups"):
        engineer_bid_features(two_items, groups=["nothing"])


def test_empty_input(two_items):
    assert engineer_bid_features(two_items.limit(0)).count() == 0


def test_groups_are_switchable(two_items):
    only = engineer_bid_features(two_items, groups=["temporal_activity"])
    assert "bid_cluster_size_so_far" in only.columns and "bid_increment" not in only.columns
    everything = engineer_bid_features(two_items)
    assert not [c for c in everything.columns if c.startswith("_")]


def test_scraped_column_names_are_accepted(two_items):
    renamed = two_items.withColumnRenamed("is_proxy_bid", "bid_is_proxy")
    assert column(features(renamed), "proxy_bid_flag") == [0, 1, 0]


def test_no_future_bid_matters(spark, data):
    """Features of the first bids are the first features of all bids."""
    everything = bids(spark, data)
    early = everything.filter(F.col("bid_id") < 500)
    whole = engineer_bid_features(everything, ["bid_id"]).filter(F.col("bid_id") < 500)
    left, right = engineer_bid_features(early, ["bid_id"]).collect(), whole.collect()
    assert by(left, "bid_id") == by(right, "bid_id")


def test_order_and_partitions_do_not_matter(spark, data):
    one = bids(spark, data, coarse=True)
    shuffled = one.repartition(7).orderBy(F.rand(3))
    left, right = (engineer_bid_features(d, ["bid_id"]).collect() for d in (one, shuffled))
    assert by(left, "bid_id") == by(right, "bid_id")


@pytest.mark.parametrize("coarse", [False, True])
def test_a_huge_item_gets_the_same_features(spark, data, coarse):
    """A third of the bids on one item, spread over many chunks, against plain windows."""
    skewed = bids(spark, data, coarse).withColumn(
        "item_id", F.when(F.col("bid_id") % 3 == 0, 7777).otherwise(F.col("item_id") % 5)
    )
    skewed = skewed.withColumn("bid_time", F.when(F.col("bid_id") % 97 != 0, F.col("bid_time")))
    plain = engineer_bid_features(skewed, ["bid_id"]).toPandas().sort_values("bid_id").reset_index(drop=True)
    chunked = engineer_bid_features(skewed, ["bid_id"], item_limit=12)
    chunked = chunked.toPandas().sort_values("bid_id").reset_index(drop=True)
    pd.testing.assert_frame_equal(plain, chunked, check_exact=False, rtol=1e-9, atol=1e-9, check_dtype=False)


def test_one_exchange_serves_all_windows(spark, data):
    plan = engineer_bid_features(bids(spark, data), ["bid_id"], groups=GROUPS)
    text = plan._sc._jvm.PythonSQLUtils.explainString(plan._jdf.queryExecution(), "simple")
    assert text.count("Exchange") == 1
    # One sort by time alone for the trailing windows, one shared by everything else.
    assert text.count("Sort [") == 2
    assert text.count("ArrowEvalPython") == 1
