"""Pickup windows read out of an auction's removal notes (HTML)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values, all four: weekday names from Monday, and the patterns of a day, a category and a time range.
WEEKDAYS = ["monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday"]
DAY_PATTERN = r"(?iU)Pickup:\s*(Monday|Tuesday|Wednesday|Thursday|Friday|Saturday|Sunday)"
CATEGORY_PATTERN = r"(?iU)Cat(egory)?\s+[A-Z]:"
RANGE_PATTERN = r"(?iU)(\d{1,2}):?(\d{2})?\s*(AM|PM|NOON)\s*-\s*(\d{1,2}):?(\d{2})?\s*(AM|PM|NOON)"




# The rule is kept as SQL text, with raw literals: the columns below and the table function of ``sql.py`` are both made
# of it.


def html_text_sql(html: str) -> str:
    """Text of an HTML fragment: tags go without a space, common entities are decoded."""
    text = f"regexp_replace(regexp_replace({html}, r'(?s)<!--.*?-->', ''), r'<[^>]*>', '')"
    for entity, plain in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&")):
        text = f"replace({text}, '{entity}', '{plain}')"
    return text


def html_text(html: str) -> Column:
    return F.expr(html_text_sql(html))


def _clock_sql(parts: str, first: int) -> str:
    """24-hour time of one side of a range: whole hour, decimal hours, and whether it is a time at all."""
    hour = f"cast({parts}[{first}] as int)"
    minute = f"coalesce(cast(nullif({parts}[{first + 1}], '') as int), 0)"
    period = f"upper({parts}[{first + 2}])"
    whole = (
        f"case when {period} = 'NOON' then 12 when {period} = 'PM' and {hour} <> 12 then {hour} + 12 "
        f"when {period} = 'AM' and {hour} = 12 then 0 else {hour} end"
    )
    return (
        f"named_struct('whole', {whole}, 'at', {whole} + {minute} / 60.0D, "
        f"'valid', {hour} between 1 and 12 and {minute} < 60)"
    )


def ranges_sql(text: str) -> str:
    """Valid (start, end) pairs; an end past midnight is 24 or more."""
    # One regex pass per match gives all six groups.
    groups = (
        f"transform(regexp_extract_all({text}, r'{RANGE_PATTERN}', 0), "
        f"m -> split(regexp_replace(m, r'{RANGE_PATTERN}', r'$1|$2|$3|$4|$5|$6'), r'\\|'))"
    )
    sides = f"transform({groups}, g -> named_struct('a', {_clock_sql('g', 0)}, 'b', {_clock_sql('g', 3)}))"
    past_midnight = "if(s.a.whole >= 20, s.b.whole <= 18, s.b.whole <= 6)"
    kept = (
        f"filter({sides}, s -> s.a.valid and s.b.valid and "
        f"(s.b.at > s.a.at or (s.b.at < s.a.at and {past_midnight})))"
    )
    return (
        f"transform({kept}, s -> named_struct('start', s.a.at, "
        "'end', s.b.at + if(s.b.at < s.a.at, 24.0D, 0.0D)))"
    )


def pickup_sql(text: str, ranges: str) -> dict[str, str]:
    """The six features of a note's text and its ranges."""
    days = ", ".join(f"'{d}'" for d in WEEKDAYS)
    day = f"lower(regexp_extract({text}, r'{DAY_PATTERN}', 1))"
    any_range = f"size({ranges}) > 0"
    return {
        "num_pickup_windows": f"size({ranges})",
        "total_pickup_hours": f"round(aggregate({ranges}, 0.0D, (acc, r) -> acc + (r.end - r.start)), 2)",
        "first_pickup_start_hour": f"if({any_range}, round(array_min(transform({ranges}, r -> r.start)), 2), null)",
        "last_pickup_end_hour": f"if({any_range}, round(array_max(transform({ranges}, r -> r.end % 24.0D)), 2), null)",
        "pickup_day_of_week": f"nullif(cast(array_position(array({days}), {day}) as int), 0) - 1",
        "has_category_windows": f"{text} rlike r'{CATEGORY_PATTERN}'",
    }


def add_pickup_windows(df: DataFrame, source: str = "auction_removal_info", prefix: str = "") -> DataFrame:
    """Six pickup features. With ``prefix='auction_'`` the auction-table names are used."""
    if source not in df.columns:
        return df
    names = {name: f"{prefix}{name}" for name in pickup_sql("", "")}
    if prefix:
        names["has_category_windows"] = f"{prefix}has_category_pickup_windows"
    out = df.withColumn("_text", F.coalesce(html_text(f"`{source}`"), F.lit("")))
    out = out.withColumn("_ranges", F.expr(ranges_sql("_text")))
    features = {names[k]: F.expr(v) for k, v in pickup_sql("_text", "_ranges").items()}
    return out.withColumns(features).drop("_text", "_ranges")
