"""Ordered values over oversized groups equal plain windows."""

from __future__ import annotations

import statistics
import time

import numpy as np
import pytest
from rows import by
from pyspark.sql import Window
from pyspark.sql import functions as F

from gavelworks.operators import joins, scans
from gavelworks.operators.encode import fit
from gavelworks.operators.items import add_closing_order
from gavelworks.operators.order_statistics import earlier_below, running_medians, standing_so_far
from gavelworks.operators.summaries import bid_sequence_arrays, bid_sequences, describe, padded_sequences, soft_close


@pytest.fixture(scope="module")
def skewed(spark):
    """Two thirds of the rows share one key; values repeat."""
    return spark.range(900).select(
        F.when(F.col("id") % 3 < 2, 1).otherwise(F.col("id")).alias("k"),
        "id",
        (F.col("id") * 37 % 50).cast("double").alias("v"),
    )


def test_order_statistics():
    rng = np.random.default_rng(5)
    for length in (1, 2, 7, 1500, 2100):
        values = rng.integers(0, 40, length)
        want = [int((values[:i] < values[i]).sum()) for i in range(length)]
        assert earlier_below(values).tolist() == want
    for length, known in ((1, 0), (2, 0), (9, 4), (50, 60), (3, 100)):
        earlier, own = rng.integers(0, 20, known).astype(float), rng.integers(0, 20, length).astype(float)
        want = [np.median(np.concatenate([earlier, own[: i + 1]])) for i in range(length)]
        assert running_medians(earlier, own, 0, known + 1).tolist() == want
        # The lowest and highest earlier values cannot be the median and may stay away.
        spare = max(0, (known - length) // 2 - 2)
        inner = np.sort(earlier)[spare : known - spare]
        assert running_medians(inner, own, spare, known + 1).tolist() == want


def test_split_finds_only_large_groups(skewed):
    parts = scans.split_by_size(skewed, ["k"], 100)
    assert parts.large_rows == 600 and parts.large.select("k").distinct().collect()[0][0] == 1
    assert parts.small.count() == 300
    assert scans.split_by_size(skewed, ["k"], 600).large is None


def test_chunks_are_long_enough_for_their_number():
    for rows in (1, 10**6, 10**11):
        size = scans.chunk_size(rows, 250_000)
        assert size >= 250_000 and rows / size <= size + 2


def test_row_numbers(skewed):
    order = [F.col("v").desc(), F.col("id").asc()]
    plain = skewed.withColumn("n", F.row_number().over(Window.partitionBy("k").orderBy(*order)))
    spread = scans.row_numbers(skewed, ["k"], order, "n", 10)
    assert by(plain.collect(), "id") == by(spread.collect(), "id")


def test_previous_row(skewed):
    order = [F.col("v").asc(), F.col("id").asc()]
    plain = skewed.withColumn("p", F.lag("v").over(Window.partitionBy("k").orderBy(*order)))
    spread = scans.with_previous(skewed, ["k"], order, {"v": "p"}, 10)
    assert by(plain.collect(), "id") == by(spread.collect(), "id")


def test_null_keys_are_a_group(spark):
    rows = spark.range(60).select(F.when(F.col("id") % 2 == 0, F.col("id") % 4).alias("k"), "id")
    spread = scans.row_numbers(rows, ["k"], [F.col("id").asc()], "n", 5).collect()
    assert sorted(r["n"] for r in spread if r["k"] is None) == list(range(1, 31))


def test_median(skewed):
    for limit in (5, 10_000):
        got = {r["k"]: r["m"] for r in scans.grouped_median(skewed, ["k"], "v", "m", limit).collect()}
        values = {}
        for r in skewed.collect():
            values.setdefault(r["k"], []).append(r["v"])
        assert got == {k: statistics.median(v) for k, v in values.items()}


def test_closing_order(skewed):
    items = skewed.select(
        F.col("k").alias("auction_id"),
        "id",
        F.when(F.col("id") % 7 != 0, F.timestamp_seconds(F.col("v"))).alias("item_closes"),
    )
    assert by(add_closing_order(items).collect(), "id") == by(add_closing_order(items, 10).collect(), "id")


def test_salted_join_keeps_every_row(skewed, spark):
    right = spark.createDataFrame([(1, "a"), (1, "b"), (5, "c")], "k long, t string")
    left = skewed.withColumn("k", F.col("k").cast("long"))
    plain = left.join(right, "k", "left")
    salted = joins.left_join(left, right, ["k"], 50)
    assert sorted(map(tuple, plain.collect()), key=str) == sorted(map(tuple, salted.collect()), key=str)


def test_sequences_of_a_huge_item(skewed):
    bids = skewed.select(
        F.lit(1).alias("item_id"), F.col("id").alias("bid_id"), F.timestamp_seconds("id").alias("bid_time"), F.col("v").alias("bid_amount")
    )
    rows = by(bid_sequences(bids, limit=50).collect(), "position")
    amounts, steps = [r["bid_amount"] for r in rows], [r["bid_increment"] for r in rows]
    assert [r["position"] for r in rows] == list(range(1, 901)) and amounts == [r["v"] for r in by(skewed.collect(), "id")]
    assert steps[1:] == [b - a for a, b in zip(amounts, amounts[1:])]
    assert bid_sequence_arrays(bids, 899).count() == 0
    assert bid_sequence_arrays(bids, 900, limit=50).first()["bid_amount_sequence"] == amounts
    front = padded_sequences(bids, 5, "pre", limit=50).collect()[0]
    assert front["sequence"] == amounts[-5:]


def fold(times, end):
    """The soft-close rule, bid by bid."""
    count = 0
    for t in times:
        if end - 120 <= t <= end:
            end, count = t + 120, count + 1
    return end, count


@pytest.mark.parametrize("limit", [3, 1000])
def test_soft_close_follows_the_rule(spark, limit):
    cases = {
        1: [100, 880, 1000, 1100, 1220, 1341],
        2: [1001, 1002],
        3: [879, 880],
        4: [],
        5: [1000, 1120, 1120, 1240, 1300, 1500],
        6: [900 + 7 * i for i in range(40)],
        7: [10, 20],
    }
    rows = [(item, i, t) for item, times in cases.items() for i, t in enumerate(times)]
    bids = spark.createDataFrame(rows, "item_id long, bid_id long, t long").select(
        "item_id", "bid_id", F.timestamp_seconds("t").alias("bid_time"), F.timestamp_seconds(F.lit(1000)).alias("close")
    )
    got = {
        r["item_id"]: (r["e"], r["soft_close_extensions"])
        for r in soft_close(bids, "close", limit).withColumn("e", F.unix_seconds("actual_end_time")).collect()
    }
    assert got == {item: fold(times, 1000) for item, times in cases.items() if times}


def test_describe(skewed):
    got = describe(skewed, "v").first().asDict()
    want = skewed.toPandas()["v"].describe()
    for ours, theirs in (("count", "count"), ("mean", "mean"), ("std", "std"), ("p25", "25%"), ("p50", "50%"), ("p75", "75%"), ("max", "max")):
        assert got[ours] == pytest.approx(want[theirs])


def test_encoder(spark):
    df = spark.createDataFrame([("a b",), ("a/c",), (None,), ("a b",)], "c string")
    one_hot = fit(df, {"c": "p"}).transform(df)
    assert one_hot.columns == ["c", "p_Unknown", "p_a_b", "p_a_c"]
    assert one_hot.agg(F.sum("p_a_b"), F.sum("p_Unknown")).first()[:] == (2, 1)
    counted = fit(df, {"c": "p"}, max_levels=2).transform(df)
    assert sorted(map(tuple, counted.select("c", "p_count", "p_frequency").collect())) == [
        ("Unknown", 1, 0.25),
        ("a b", 2, 0.5),
        ("a b", 2, 0.5),
        ("a/c", 1, 0.25),
    ]
    clash = spark.createDataFrame([("a b",), ("a-b",)], "c string")
    with pytest.raises(ValueError, match="two levels"):
        fit(clash, {"c": "p"}).transform(clash)
    frozen = fit(df, {"c": "p"}, categories={"c": ["z"]}).transform(df)
    assert frozen.columns == ["c", "p_z"] and frozen.agg(F.sum("p_z")).first()[0] == 0


def test_standing_so_far():
    """Ranks and medians among earlier values of the same group, with ties, against sorting each history."""
    draw = np.random.default_rng(5)
    for size, most in ((0, 3), (1, 3), (400, 4), (700, 10_000), (300, 1)):
        values = draw.integers(0, most, size).astype(float) / 4
        starts = np.maximum.accumulate(np.where(draw.random(size) < 0.05, np.arange(size), 0)) if size else np.zeros(0, int)
        ranks, medians = standing_so_far(values, starts)
        for i in range(size):
            history = values[starts[i] : i + 1]
            assert ranks[i] == (history <= values[i]).sum() and medians[i] == np.median(history)


def test_standing_of_a_long_item_is_fast():
    """A hundred thousand bids of one item, a batch at a time, beside inserting each into a sorted list."""
    from bisect import bisect_right

    values = np.random.default_rng(6).random(100_000)
    begin = time.perf_counter()
    seen: list[float] = []
    for a in values:
        seen.insert(bisect_right(seen, a), a)
        half = len(seen) >> 1
        seen[half] if len(seen) & 1 else (seen[half - 1] + seen[half]) / 2
    plain = time.perf_counter() - begin
    begin = time.perf_counter()
    standing_so_far(values, np.zeros(len(values), int))
    assert time.perf_counter() - begin < plain
