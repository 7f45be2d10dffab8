"""Postal-area and location expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gavelworks.functions.times import cut, flag

# The reference point for distances, and the flag borders, in degrees.
TORONTO_LAT, TORONTO_LNG = 43.6532, -79.3832
NORTH_OF_LAT, WEST_OF_LNG, EAST_OF_LNG = 49, -120, -65


def fsa(postal_code: Column) -> Column:
    """Three-character postal area (letter, digit, letter), or NULL."""
    head = F.upper(F.substring(F.replace(postal_code, F.lit(" "), F.lit("")), 1, 3))
    return F.when(head.rlike("^[A-Z][0-9][A-Z]$"), head)


def add_fsa(df: DataFrame, postal_code: str = "postal_code") -> DataFrame:
    return df.withColumn("fsa", fsa(F.col(postal_code)))


def add_location_features(df: DataFrame) -> DataFrame:
    """Postal area and zone, coordinates, distance and border flags of each auction."""
    base = "enriched_auction_approxLocation_"
    postal, lat, lng = base + "postalCode", base + "lat", base + "lng"
    out: dict[str, Column] = {}
    if postal in df.columns:
        area = fsa(F.col(postal))
        out["auction_fsa"] = area
        out["auction_postal_zone"] = F.coalesce(F.substring(area, 1, 1), F.lit("Unknown"))
    if lat in df.columns and lng in df.columns:
        y, x = F.col(lat), F.col(lng)
        out["auction_latitude"] = y
        out["auction_longitude"] = x
        out["auction_distance_from_toronto"] = F.sqrt(
            (y - TORONTO_LAT) * (y - TORONTO_LAT) + (x - TORONTO_LNG) * (x - TORONTO_LNG)
        )
        out["auction_is_northern"] = flag(y > NORTH_OF_LAT)
        out["auction_is_west_coast"] = flag(x < WEST_OF_LNG)
        out["auction_is_east_coast"] = flag(x > EAST_OF_LNG)
    return df.withColumns(out) if out else df


def _ratios(df: DataFrame, rules: dict[str, tuple[str, str]]) -> dict[str, Column]:
    return {
        name: F.try_divide(F.col(f"`{top}`").cast("double"), F.col(f"`{bottom}`").cast("double"))
        for name, (top, bottom) in rules.items()
        if top in df.columns and bottom in df.columns
    }


def add_auction_area_ratios(df: DataFrame) -> DataFrame:
    """Area ratios under the auction column names. Division by zero gives NULL."""
    out = _ratios(
        df,
        {
            "auction_area_persons_per_dwelling": ("auction_area_population", "auction_area_occupied_dwellings"),
            "auction_area_occupancy_rate": ("auction_area_occupied_dwellings", "auction_area_total_dwellings"),
            "auction_area_tax_filing_rate": ("auction_area_tax_returns", "auction_area_population"),
        },
    )
    return df.withColumns(out) if out else df


def add_area_ratios(df: DataFrame) -> DataFrame:
    """Area ratios under the census and tax column names."""
    population, occupied = "Population, 2021", "Private dwellings occupied by usual residents, 2021"
    average, median = "Average Total Income", "Median Total Income"
    out = _ratios(
        df,
        {
            "persons_per_dwelling": (population, occupied),
            "occupancy_rate": (occupied, "Total private dwellings, 2021"),
            "returns_per_capita": ("Number of Returns", population),
        },
    )
    if average in df.columns and median in df.columns:
        out["income_skew"] = F.try_divide(F.col(average) - F.col(median), F.col(median))
    if median in df.columns and population in df.columns:
        out["economic_capacity"] = F.col(median) * F.col(f"`{population}`") / F.lit(1e9)
    return df.withColumns(out) if out else df


def income_tier(income: Column, missing: str | None = None) -> Column:
    """Income band; ``missing`` replaces an unknown or non-positive income."""
    band = cut(
        income,
        [0, 30000, 50000, 75000, 100000, math.inf],
        ["low", "lower_mid", "mid", "upper_mid", "high"],
        include_lowest=False,
    )
    return band if missing is None else F.coalesce(band, F.lit(missing))


def urbanisation(persons_per_dwelling: Column, population: Column) -> Column:
    return persons_per_dwelling * F.log1p(population)
