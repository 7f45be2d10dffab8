"""Column expressions against literal cases."""

from __future__ import annotations

import datetime as dt
import json

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gavelworks.functions import jsons, money, places, text, times
from gavelworks.functions.pickup import add_pickup_windows
from gavelworks.operators.checks import require_columns, with_invalid_numbers, with_item_errors


def values(spark, column, inputs, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(inputs)], f"i int, x {kind}")
    return [r[0] for r in df.select(column(F.col("x")).alias("y"), "i").orderBy("i").select("y").collect()]


# ------------------------------------------------------------------- money


def test_increment_steps(spark):
    amounts = [5.0, 10.0, 39.99, 40.0, 100.0, 1000.0, 5000.0, 10000.0, 1e6, -1.0]
    assert values(spark, money.expected_increment, amounts, "double") == [1, 3, 3, 5, 10, 50, 100, 250, 250, 250]


def test_increments_need_both_bids(spark):
    df = spark.createDataFrame([(None, 5.0), (5.0, 5.5), (5.0, 6.0), (5.0, 8.0), (5.0, 8.5), (0.0, 2.0)], "p double, c double")
    rows = df.select(money.is_unusual_increment(F.col("p"), F.col("c")), money.increment_deviation(F.col("p"), F.col("c"))).collect()
    assert [r[0] for r in rows] == [False, True, False, False, True, False]
    assert [r[1] for r in rows] == [None, 0.5, 1.0, 3.0, 3.5, None]


def test_prices(spark):
    df = spark.createDataFrame([(50.0,), (None,), (-3.0,)], "item_current_bid double")
    rows = money.add_item_prices(df).collect()
    assert rows[0]["item_winning_price_log1p"] == pytest.approx(3.9318256)
    assert [r["item_winning_price_log1p"] for r in rows[1:]] == [0, 0]
    assert money.add_item_prices(df.select(F.lit(1).alias("x"))).first()[1:] == (0, 0)


# ------------------------------------------------------------------ places


def test_postal_area(spark):
    codes = ["M5V 3A8", "K1A0B1", "m5v 3a8", None, "invalid", "123", "AB", "M 5 V3A8", ""]
    assert values(spark, places.fsa, codes) == ["M5V", "K1A", "M5V", None, None, None, None, "M5V", None]


def test_area_ratios(spark):
    names = [
        "Population, 2021",
        "Total private dwellings, 2021",
        "Private dwellings occupied by usual residents, 2021",
        "Number of Returns",
        "Median Total Income",
        "Average Total Income",
    ]
    row = places.add_area_ratios(spark.createDataFrame([(10000, 4000, 3500, 5000, 50000.0, 60000.0)], names)).first()
    assert row["persons_per_dwelling"] == pytest.approx(10000 / 3500)
    assert row["occupancy_rate"] == 0.875 and row["income_skew"] == 0.2
    assert row["returns_per_capita"] == 0.5 and row["economic_capacity"] == 0.5
    empty = places.add_area_ratios(spark.createDataFrame([(10, 0, 0, 5, 0.0, 1.0)], names)).first()
    assert empty["persons_per_dwelling"] is None and empty["income_skew"] is None


def test_income_tiers(spark):
    got = values(spark, lambda c: places.income_tier(c, "unknown"), [0.0, 30000.0, 30001.0, 75000.0, 1e6, None], "double")
    assert got == ["unknown", "low", "lower_mid", "mid", "high", "unknown"]


# ------------------------------------------------------------------- times


def test_holidays(spark):
    days = {
        "2024-01-01": (1, 1),
        "2024-03-15": (0, 0),
        "2024-05-27": (1, 0),
        "2024-05-20": (0, 0),
        "2024-07-01": (0, 1),
        "2024-07-04": (1, 0),
        "2024-09-02": (1, 1),
        "2024-09-09": (0, 0),
        "2024-10-14": (0, 1),
        "2024-11-28": (1, 0),
        "2024-12-25": (1, 1),
    }
    df = spark.createDataFrame([(d,) for d in [*days, None]], "t string")
    rows = times.add_calendar(df, "t").collect()
    assert [(r["t_is_us_holiday"], r["t_is_canadian_holiday"]) for r in rows] == [*days.values(), (0, 0)]
    assert all(r["t_is_holiday"] == (r["t_is_us_holiday"] | r["t_is_canadian_holiday"]) for r in rows)


def test_calendar_of_a_missing_time(spark):
    row = times.add_calendar(spark.createDataFrame([("bad",)], "t string"), "t").first().asDict()
    assert row["t"] is None and row["t_year"] is None and row["t_season"] is None and row["t_part_of_day"] is None
    assert all(v == 0 for k, v in row.items() if "_is_" in k)


def test_mixed_offsets_are_read_as_utc(spark):
    df = spark.createDataFrame([("2024-01-15T10:00:00-05:00",), ("2024-06-15 10:00:00-04:00",)], "t string")
    assert [r["t_hour"] for r in times.add_calendar(df, "t").collect()] == [15, 14]


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.datetimes(dt.datetime(1990, 1, 1), dt.datetime(2040, 1, 1)), min_size=50, max_size=200))
def test_calendar_agrees_with_the_standard_library(spark, moments):
    df = spark.createDataFrame([(i, m.isoformat(" ")) for i, m in enumerate(moments)], "i int, t string")
    rows = times.add_calendar(df, "t", include_cyclical=False).orderBy("i").collect()
    for m, r in zip(moments, rows):
        assert (r["t_year"], r["t_month"], r["t_day"], r["t_hour"]) == (m.year, m.month, m.day, m.hour)
        assert (r["t_day_of_week"], r["t_week_of_year"]) == (m.weekday(), m.isocalendar()[1])
        assert r["t_is_working_hours"] == int(9 <= m.hour < 17 and m.weekday() < 5)


def test_durations_and_bins(spark):
    rows = [("2024-01-01 00:00:00", e) for e in ("2024-01-01 00:00:00", "2024-01-02 00:00:00", "2024-01-04 00:00:01", "2024-02-01 00:00:00", "2023-12-31 00:00:00", None)]
    df = times.add_auction_duration(spark.createDataFrame(rows, "start_time string, end_time string"))
    got = [r["auction_duration_length_category"] for r in df.collect()]
    assert got == ["short", "short", "long", "very_long", None, None]


def test_bid_timing(spark):
    rows = [("2024-01-01 00:00:00", "2024-01-01 10:00:00", t) for t in ("2024-01-01 00:00:00", "2024-01-01 02:30:00", "2024-01-01 05:00:00", "2024-01-01 09:00:00", "2024-01-01 09:58:00", "2024-01-01 10:01:00")]
    df = spark.createDataFrame(rows, "auction_start_time string, auction_end_time string, bid_time string")
    got = times.add_bid_timing(df).collect()
    assert [r["bid_timing_position"] for r in got] == ["early", "early", "middle", "late", "last_minute", None]
    assert [r["bid_timing_is_last_minute"] for r in got] == [0, 0, 0, 0, 1, 1]


def test_lengths_with_extension(spark):
    df = spark.createDataFrame(
        [("2024-01-01T10:00:00-05:00", "2024-01-03T10:00:00-05:00", "2024-01-03T10:30:00-05:00")],
        "auction_starts string, auction_ends string, auction_last_item_closes string",
    )
    row = times.add_auction_lengths(df).first()
    assert (row["auction_length_hours"], row["auction_actual_length_hours"], row["auction_extension_hours"]) == (48, 48.5, 0.5)
    assert row["auction_length_length_category"] == "medium"


# ------------------------------------------------------------------- pickup


def test_pickup_windows(spark):
    line = "<div class='bold'><strong>Pickup: {}</strong></div>"
    cases = {
        line.format("Saturday at the barn, 8AM - 12 NOON"): (1, 4.0, 8.0, 12.0, 5, False),
        line.format("Friday <i>rain or shine</i> 3PM - 8PM"): (1, 5.0, 15.0, 20.0, 4, False),
        line.format("Sunday, gate two, 12:00 Noon - 05:30 PM"): (1, 5.5, 12.0, 17.5, 6, False),
        line.format("Monday, back door, 5:15PM - 7:00PM"): (1, 1.75, 17.25, 19.0, 0, False),
        line.format("Tuesday, 10AM - 2PM"): (1, 4.0, 10.0, 14.0, 1, False),
        line.format("Wednesday, 4PM - 7PM") + "<p>\nCat A: 4PM - 6PM\nCat B: 6PM - 7PM\nCat C: 6:30PM - 7PM</p>": (4, 6.5, 16.0, 19.0, 2, True),
        "no pickup": (0, 0.0, None, None, None, False),
        "": (0, 0.0, None, None, None, False),
        None: (0, 0.0, None, None, None, False),
        "11PM - 2AM": (1, 3.0, 23.0, 2.0, None, False),
        "9PM - 6:30PM": (1, 21.5, 21.0, 18.5, None, False),
        "9:30PM - 8PM": (0, 0.0, None, None, None, False),
        "9AM - 1AM": (1, 16.0, 9.0, 1.0, None, False),
        "9AM - 7AM": (0, 0.0, None, None, None, False),
        "13PM - 2PM and 1:75PM - 2PM and 5PM - 5PM": (0, 0.0, None, None, None, False),
        "12AM - 12PM": (1, 12.0, 0.0, 12.0, None, False),
        "9AM&nbsp;-&nbsp;10AM": (1, 1.0, 9.0, 10.0, None, False),
    }
    df = spark.createDataFrame([(i, html) for i, html in enumerate(cases)], "i int, auction_removal_info string")
    rows = add_pickup_windows(df).orderBy("i").collect()
    for (html, want), row in zip(cases.items(), rows):
        assert tuple(row[2:]) == want, html


# --------------------------------------------------------------------- text


def test_tokens(spark):
    cases = {
        "Heavy Iron Garden Gate?": ["heavy", "iron", "garden", "gate"],
        "It is the lamp of my aunt": ["lamp", "aunt"],
        "<p>Rusty</p><b>hinge</b>": ["rusty", "hinge"],
        "500 dollars, from the 1920s": ["dollars", "1920s"],
        "mid-century - modern - x": ["mid-century", "modern"],
        "see https://example.com/a?b=1 or mail me@x.org now": ["see", "mail"],
        "-edge-": ["edge"],
        "Café Éclair naïve": ["café", "éclair", "naïve"],
        "12-inch": ["-inch"],
        "   ": [],
        "": [],
        None: [],
    }
    assert values(spark, text.tokens, list(cases)) == list(cases.values())
    kept = values(spark, lambda c: text.tokens(c, remove_numbers=False), ["made in 1950"])
    assert kept == [["made", "1950"]]


def test_title_comes_first(spark):
    df = spark.createDataFrame([("Oak Chair", "A red one"), (None, "lamp"), (None, None)], "a string, b string")
    got = [r[0] for r in df.select(text.title_and_description_tokens(F.col("a"), F.col("b"))).collect()]
    assert got == [["oak", "chair", "red", "one"], ["lamp"], []]


def test_presence_and_lengths(spark):
    assert values(spark, text.is_populated, ["Ikea", "", "nan", "None", None]) == [1, 0, 0, 0, 0]
    df = spark.createDataFrame([("Vintage Chair",), (None,), ("",)], "item_title string")
    rows = text.add_text_lengths(df).collect()
    assert [r["item_title_length"] for r in rows] == [13, 0, 0]
    assert rows[0]["item_enriched_title_length"] == 0
    assert values(spark, text.normalise, ["  Big Lamp\n", None]) == ["big lamp", ""]
    assert text.clean_level("Good / Fair-ish", lower=True) == "good___fair_ish"


# -------------------------------------------------------------------- JSON


def entries(value, keys):
    """The counting rule, from the description."""
    if value is None or value in ("", "nan", "None"):
        return 0
    try:
        parsed = json.loads(value)
    except json.JSONDecodeError:
        return 1 if value.strip() else 0
    if isinstance(parsed, list):
        return len(parsed)
    if isinstance(parsed, dict):
        return len(parsed) if keys else 1
    return 1 if parsed else 0


def test_json_counts(spark):
    texts = ['["a","b"]', "[]", '{"a":1,"b":{"c":2}}', "{}", "0", "0.0", "false", "null", '""', '"x"', "5", "true", "not json", "  ", "", "nan", "None", None, "[1, 2", "{bad", ' ["a", ["b", "c"]] ', "-0", "1e3"]
    for keys in (False, True):
        got = values(spark, lambda c: jsons.json_count(c, keys), texts)
        assert got == [entries(t, keys) for t in texts]


def test_list_and_map_columns(spark):
    df = spark.createDataFrame([(["a", "b"], {"x": 1}), (None, None)], "enriched_item_brands array<string>, enriched_item_attributes map<string,int>")
    rows = jsons.add_list_counts(df).collect()
    assert [(r["item_brands_count"], r["item_attributes_count"], r["item_items_count"]) for r in rows] == [(2, 1, 0), (0, 0, 0)]


# ------------------------------------------------------------------- checks


def test_checks(spark):
    with pytest.raises(ValueError, match="b"):
        require_columns(spark.createDataFrame([(1,)], "a int"), ["a", "b"])
    df = spark.createDataFrame([("12", "x"), (None, "1e3")], "item_count string, total_viewed string")
    assert [r["invalid_fields"] for r in with_invalid_numbers(df).collect()] == [["total_viewed"], []]
    items = spark.createDataFrame([("", -1.0, 2, 0), ("ok", 5.0, 0, None)], "title string, winning_bid double, bid_count int, recorded_bids int")
    assert [len(r["errors"]) for r in with_item_errors(items).collect()] == [3, 0]
