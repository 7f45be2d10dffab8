"""Calendar, duration and timing expressions."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DAY = 86400
HOUR = 3600


def as_timestamp(df: DataFrame, name: str) -> Column:
    """Column ``name`` as a timestamp; text that does not parse becomes NULL."""
    if dict(df.dtypes)[name] == "string":
        return F.try_to_timestamp(F.col(name))
    return F.col(name).cast("timestamp")


def micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def seconds_between(later: Column, earlier: Column) -> Column:
    """Exact difference in seconds, as a double."""
    return (micros(later) - micros(earlier)) / F.lit(1e6)


def flag(condition: Column) -> Column:
    """0/1 integer; an unknown condition counts as 0."""
    return F.coalesce(condition.cast("int"), F.lit(0))


def cut(value: Column, edges: Sequence[float], labels: Sequence[str], include_lowest: bool = True) -> Column:
    """Right-closed bins, NULL outside them. The last edge may be infinite."""
    low = value >= edges[0] if include_lowest else value > edges[0]
    binned = None
    for edge, label in zip(edges[1:], labels):
        inside = low if math.isinf(edge) else low & (value <= edge)
        binned = F.when(inside, label) if binned is None else binned.when(inside, label)
    return binned


# ---------------------------------------------------------------- calendar


def part_of_day(hour: Column) -> Column:
    return (
        F.when(hour < 6, "night")
        .when(hour < 12, "morning")
        .when(hour < 18, "afternoon")
        .when(hour < 24, "evening")
    )


def season(month: Column, hemisphere: str = "north") -> Column:
    if hemisphere == "south":
        month = F.pmod(month + 5, F.lit(12)) + 1
    return (
        F.when(month.isin(12, 1, 2), "winter")
        .when(month.isin(3, 4, 5), "spring")
        .when(month.isin(6, 7, 8), "summer")
        .when(month.isin(9, 10, 11), "fall")
    )


def _on(ts: Column, month: int, day: int) -> Column:
    return (F.month(ts) == month) & (F.dayofmonth(ts) == day)


def _weekday_between(ts: Column, month: int, weekday: int, first: int, last: int) -> Column:
    return (
        (F.month(ts) == month)
        & (F.weekday(ts) == weekday)
        & F.dayofmonth(ts).between(first, last)
    )


def is_us_holiday(ts: Column) -> Column:
    """New Year, Memorial, Independence, Labor, Thanksgiving and Christmas Day."""
    return (
        _on(ts, 1, 1)
        | _on(ts, 7, 4)
        | _on(ts, 12, 25)
        | _weekday_between(ts, 5, 0, 25, 31)
        | _weekday_between(ts, 9, 0, 1, 7)
        | _weekday_between(ts, 11, 3, 22, 28)
    )


def is_canadian_holiday(ts: Column) -> Column:
    """New Year, Canada, Labour, Thanksgiving and Christmas Day."""
    return (
        _on(ts, 1, 1)
        | _on(ts, 7, 1)
        | _on(ts, 12, 25)
        | _weekday_between(ts, 9, 0, 1, 7)
        | _weekday_between(ts, 10, 0, 8, 14)
    )


def calendar_columns(
    ts: Column,
    prefix: str,
    include_cyclical: bool = True,
    include_holidays: bool = True,
    region: str = "both",
    hemisphere: str = "north",
) -> dict[str, Column]:
    """All calendar features of one timestamp, by output name."""
    hour, weekday, month = F.hour(ts), F.weekday(ts), F.month(ts)
    day_of_year = F.dayofyear(ts)
    part, time_of_year = part_of_day(hour), season(month, hemisphere)
    out = {
        "year": F.year(ts),
        "month": month,
        "day": F.dayofmonth(ts),
        "hour": hour,
        "minute": F.minute(ts),
        "day_of_week": weekday,
        "day_of_year": day_of_year,
        "week_of_year": F.weekofyear(ts),
        "quarter": F.quarter(ts),
        "is_weekend": flag(weekday >= 5),
        "is_weekday": flag(weekday < 5),
        "part_of_day": part,
    }
    for name in ("morning", "afternoon", "evening", "night"):
        out[f"is_{name}"] = flag(part == name)
    out["is_working_hours"] = flag((hour >= 9) & (hour < 17) & (weekday < 5))
    out["is_business_day"] = flag(weekday < 5)
    out["season"] = time_of_year
    for name in ("winter", "spring", "summer", "fall"):
        out[f"is_{name}"] = flag(time_of_year == name)
    if include_holidays:
        if region in ("us", "both"):
            out["is_us_holiday"] = flag(is_us_holiday(ts))
        if region in ("canada", "both"):
            out["is_canadian_holiday"] = flag(is_canadian_holiday(ts))
        if region == "both":
            out["is_holiday"] = flag(is_us_holiday(ts) | is_canadian_holiday(ts))
    if include_cyclical:
        cycles = {"hour": (hour, 24), "day_of_week": (weekday, 7), "month": (month, 12), "day_of_year": (day_of_year, 365)}
        for name, (value, period) in cycles.items():
            angle = value * F.lit(2 * math.pi) / F.lit(period)
            out[f"{name}_sin"] = F.sin(angle)
            out[f"{name}_cos"] = F.cos(angle)
    return {prefix + name: column for name, column in out.items()}


def add_calendar(
    df: DataFrame, column: str, prefix: str | None = None, drop_original: bool = False, **options
) -> DataFrame:
    prefix = f"{column}_" if prefix is None else prefix
    out = df.withColumn(column, as_timestamp(df, column))
    out = out.withColumns(calendar_columns(F.col(column), prefix, **options))
    return out.drop(column) if drop_original else out


def add_calendars(
    df: DataFrame,
    columns: Sequence[str],
    include_cyclical: bool = True,
    include_holidays: bool = True,
    region: str = "both",
) -> DataFrame:
    """Calendar features of several columns in one projection; absent columns are skipped."""
    present = [c for c in columns if c in df.columns]
    df = df.withColumns({c: as_timestamp(df, c) for c in present})
    out: dict[str, Column] = {}
    for c in present:
        out |= calendar_columns(F.col(c), f"{c}_", include_cyclical, include_holidays, region)
    return df.withColumns(out) if out else df


# ---------------------------------------------------------------- durations


def _spans(seconds: Column, prefix: str, units: Sequence[str]) -> dict[str, Column]:
    scale = {"total_seconds": 1, "days": DAY, "hours": HOUR, "minutes": 60}
    return {prefix + unit: seconds / F.lit(float(scale[unit])) for unit in units}


def add_time_since(df: DataFrame, column: str, reference: str, prefix: str | None = None) -> DataFrame:
    prefix = f"{column}_since_{reference}_" if prefix is None else prefix
    seconds = seconds_between(as_timestamp(df, column), as_timestamp(df, reference))
    return df.withColumns(_spans(seconds, prefix, ("total_seconds", "days", "hours", "minutes")))


def add_time_until(df: DataFrame, column: str, reference: Column | None = None, prefix: str | None = None) -> DataFrame:
    """Time left until ``column`` as seen at ``reference`` (the query's start if not given)."""
    prefix = f"time_until_{column}_" if prefix is None else prefix
    now = F.current_timestamp() if reference is None else reference
    seconds = seconds_between(as_timestamp(df, column), now)
    out = _spans(seconds, prefix, ("total_seconds", "days", "hours", "minutes"))
    out[f"{prefix}has_passed"] = flag(seconds < 0)
    return df.withColumns(out)


def add_auction_duration(
    df: DataFrame, start: str = "start_time", end: str = "end_time", prefix: str = "auction_duration_"
) -> DataFrame:
    seconds = seconds_between(as_timestamp(df, end), as_timestamp(df, start))
    out = _spans(seconds, prefix, ("total_seconds", "days", "hours"))
    out[f"{prefix}length_category"] = cut(
        seconds / F.lit(float(HOUR)), [0, 24, 72, 168, math.inf], ["short", "medium", "long", "very_long"]
    )
    return df.withColumns(out)


def add_bid_timing(
    df: DataFrame,
    bid_time: str = "bid_time",
    auction_start: str = "auction_start_time",
    auction_end: str = "auction_end_time",
    prefix: str = "bid_timing_",
) -> DataFrame:
    """Where each bid falls in its auction's scheduled life."""
    out: dict[str, Column] = {}
    has_start, has_end = auction_start in df.columns, auction_end in df.columns
    bid = as_timestamp(df, bid_time)
    if has_start:
        elapsed = seconds_between(bid, as_timestamp(df, auction_start))
        out[f"{prefix}seconds_since_start"] = elapsed
        out[f"{prefix}hours_since_start"] = elapsed / F.lit(float(HOUR))
    if has_end:
        left = seconds_between(as_timestamp(df, auction_end), bid)
        out[f"{prefix}seconds_until_end"] = left
        out[f"{prefix}hours_until_end"] = left / F.lit(float(HOUR))
        out[f"{prefix}minutes_until_end"] = left / F.lit(60.0)
        out[f"{prefix}is_last_minute"] = flag(left <= 120)
    if has_start and has_end:
        length = seconds_between(as_timestamp(df, auction_end), as_timestamp(df, auction_start))
        share = F.try_divide(elapsed, length)
        out[f"{prefix}pct_through_auction"] = share
        out[f"{prefix}position"] = cut(
            share, [0, 0.25, 0.75, 0.95, 1.0], ["early", "middle", "late", "last_minute"]
        )
    return df.withColumns(out)


def add_auction_lengths(df: DataFrame) -> DataFrame:
    """Scheduled and actual auction length and the soft-close extension, in hours."""
    for name in ("auction_starts", "auction_ends", "auction_last_item_closes"):
        if name in df.columns:
            df = df.withColumn(name, as_timestamp(df, name))
    starts, ends, closes = (F.col(c) for c in ("auction_starts", "auction_ends", "auction_last_item_closes"))
    has_ends = {"auction_starts", "auction_ends"} <= set(df.columns)
    if has_ends:
        df = add_auction_duration(df, "auction_starts", "auction_ends", "auction_length_")
        df = df.withColumn("auction_length_hours", seconds_between(ends, starts) / F.lit(float(HOUR)))
    if {"auction_starts", "auction_last_item_closes"} <= set(df.columns):
        actual = seconds_between(closes, starts) / F.lit(float(HOUR))
        df = df.withColumn("auction_actual_length_hours", actual)
        if has_ends:
            df = df.withColumn(
                "auction_extension_hours", F.col("auction_actual_length_hours") - F.col("auction_length_hours")
            )
    return df
