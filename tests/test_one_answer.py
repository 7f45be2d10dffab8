"""Operators that work otherwise on large groups give what they give on small ones, whatever is missing."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from gavelworks.operators.bids import engineer_bid_features
from gavelworks.operators.embeddings import document_vectors
from gavelworks.operators.items import add_closing_order
from gavelworks.operators.joins import not_done
from gavelworks.operators.summaries import category_statistics


@pytest.fixture(scope="module")
def bids(spark):
    """Two items and bids without one; a fifth of the amounts and a few times are missing, times repeat."""
    rng = random.Random(11)
    rows = []
    for i in range(260):
        item = rng.choice([1, 1, 1, None, None, 2])
        at = None if rng.random() < 0.05 else rng.randrange(0, 2500) // 5 * 5 + (86_400 if rng.random() < 0.2 else 0)
        amount = None if rng.random() < 0.2 else float(rng.randrange(1, 60))
        rows.append((item, i, at, amount, rng.random() < 0.3))
    frame = spark.createDataFrame(rows, "item_id long, bid_id long, t long, bid_amount double, is_proxy_bid boolean")
    return frame.withColumn("bid_time", F.timestamp_seconds("t")).drop("t")


def rows_of(df):
    return {r["bid_id"]: r.asDict() for r in df.collect()}


def test_bid_features_of_short_and_long_items(bids):
    plain = rows_of(engineer_bid_features(bids, tiebreak=["bid_id"]))
    long = rows_of(engineer_bid_features(bids, tiebreak=["bid_id"], item_limit=12))
    assert plain.keys() == long.keys()
    for bid, row in plain.items():
        for name, value in row.items():
            other = long[bid][name]
            if isinstance(value, float) and isinstance(other, float):
                assert abs(value - other) <= 1e-9 * max(1, abs(value)), (bid, name, value, other)
            else:
                assert value == other, (bid, name, value, other)


def test_missing_amounts_are_skipped(spark):
    rows = [(1, i, i * 10, a) for i, a in enumerate([5.0, None, 7.0, 6.0])]
    frame = spark.createDataFrame(rows, "item_id long, bid_id long, t long, bid_amount double")
    frame = frame.withColumn("bid_time", F.timestamp_seconds("t")).drop("t")
    for limit in (100, 2):
        got = rows_of(engineer_bid_features(frame, tiebreak=["bid_id"], item_limit=limit))
        assert [got[i]["bid_increment"] for i in range(4)] == [5.0, None, None, -1.0]
        assert [got[i]["bid_amount_relative_to_median"] for i in range(4)] == [0.0, None, 1.0, 0.0]
        assert [got[i]["bid_amount_relative_to_mean"] for i in range(4)] == [0.0, None, 1.0, 0.0]
        assert got[3]["bid_amount_percentile_so_far"] == pytest.approx(200 / 3)
        assert got[1]["bid_amount_percentile_so_far"] is None


def test_closing_order_without_an_auction(spark):
    rows = [(None, i, f"2024-01-0{1 + i % 4} 00:00:00") for i in range(8)] + [(1, 9, None)]
    items = spark.createDataFrame(rows, "auction_id long, item_id long, item_closes string")
    small = {r.item_id: r.item_closing_order for r in add_closing_order(items).collect()}
    large = {r.item_id: r.item_closing_order for r in add_closing_order(items, limit=2).collect()}
    assert small == large == {**{i: 1 + i % 4 for i in range(8)}, 9: 0}


@pytest.mark.parametrize("limit", [2, 1000])
def test_median_of_the_missing_category(spark, limit):
    rows = [(None, float(i)) for i in (1, 2, 3)] + [("a", 4.0), ("a", None)]
    out = category_statistics(spark.createDataFrame(rows, "c string, p double"), "c", "p", limit).collect()
    assert {r.c: (r.category_avg_price, r.category_median_price) for r in out} == {None: (2.0, 2.0), "a": (4.0, 4.0)}


def test_missing_keys_are_done_once(spark):
    frame = spark.createDataFrame([(None, 1), (None, 2), (3, 1)], "a long, b long")
    assert [tuple(r) for r in not_done(frame, frame.filter("b = 1"), ["a", "b"]).collect()] == [(None, 2)]


@pytest.mark.parametrize("broadcast_bytes", [0, 1 << 20])
def test_vectors_of_repeated_keys_and_missing_tokens(spark, broadcast_bytes):
    words = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0])], "word string, vector array<float>")
    rows = [(1, 1, ["a"]), (1, 1, ["b", "x"]), (None, 2, None), (3, 3, [])]
    tokens = spark.createDataFrame(rows, "auction_id long, item_id long, tokens array<string>")
    got = document_vectors(tokens, words, dimensions=2, broadcast_bytes=broadcast_bytes).collect()
    assert sorted((str(r.auction_id), r.embedding) for r in got) == [
        ("1", [0.0, 1.0]), ("1", [1.0, 0.0]), ("3", [0.0, 0.0]), ("None", [0.0, 0.0])]
