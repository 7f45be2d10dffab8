"""Auction-grain queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from gavelworks.functions.pickup import add_pickup_windows
from gavelworks.functions.places import add_area_ratios, add_location_features, income_tier, urbanisation
from gavelworks.functions.text import add_partner_flag
from gavelworks.functions.times import (
    add_auction_lengths,
    add_bid_timing,
    add_calendar,
    add_calendars,
    add_time_since,
    add_time_until,
    season,
)
from gavelworks.operators import auctions as ops
from gavelworks.operators.encode import fit_auction_encoder
from gavelworks.operators.joins import merge
from gavelworks.sources import bindings
from gavelworks.sources.areas import area_lookup, clean_population, clean_tax
from registry.common import AUCTIONS, BIDS, ENRICHED_AUCTIONS, POSTAL, query, r, rounded, with_

KEY = "auction_id"

# ------------------------------------------------------------------ lengths

HOURS = "epoch_us(auction_ends) - epoch_us(auction_starts)"
ACTUAL = "epoch_us(auction_last_item_closes) - epoch_us(auction_starts)"
LENGTH_COLUMNS = f"""
  {r(f"({HOURS}) / 1e6", "auction_length_total_seconds")},
  {r(f"({HOURS}) / 1e6 / 86400", "auction_length_days")},
  CASE WHEN ({HOURS}) / 3.6e9 BETWEEN 0 AND 24 THEN 'short' WHEN ({HOURS}) / 3.6e9 BETWEEN 24 AND 72 THEN 'medium'
    WHEN ({HOURS}) / 3.6e9 BETWEEN 72 AND 168 THEN 'long' WHEN ({HOURS}) / 3.6e9 > 168 THEN 'very_long' END
    AS auction_length_length_category,
  {r(f"({HOURS}) / 3.6e9", "auction_length_hours")},
  {r(f"({ACTUAL}) / 3.6e9", "auction_actual_length_hours")},
  {r(f"({ACTUAL}) / 3.6e9 - ({HOURS}) / 3.6e9", "auction_extension_hours")}"""


@query("auction_lengths", with_(AUCTIONS) + f"SELECT auction_id, {LENGTH_COLUMNS} FROM auctions")
def auction_lengths(spark, folder):
    df = bindings.auctions(spark, folder).select(KEY, "auction_starts", "auction_ends", "auction_last_item_closes")
    out = add_auction_lengths(df).drop("auction_starts", "auction_ends", "auction_last_item_closes")
    return rounded(out, KEY)


# ------------------------------------------------------------------- pickup

# Worked out by hand from the eight notes: windows, hours, first start, last end, weekday, categories.
PICKUPS = {
    0: (1, 4, 8, 12, 5, 0),
    1: (1, 5, 15, 20, 4, 0),
    2: (3, 6.75, 9, 13.25, 6, 1),
    3: (1, 3, 23, 2, 0, 0),
    4: (0, 0, None, None, None, 0),
    5: (0, 0, None, None, None, 0),
    6: (0, 0, None, None, 1, 0),
    7: (2, 14.25, 0, 20.75, 3, 0),
}
_PICKUP_ROWS = ", ".join(
    "(" + ", ".join("NULL" if v is None else str(v) for v in (k, *row)) + ")" for k, row in PICKUPS.items()
)
PICKUP_NAMES = [
    "auction_num_pickup_windows",
    "auction_total_pickup_hours",
    "auction_first_pickup_start_hour",
    "auction_last_pickup_end_hour",
    "auction_pickup_day_of_week",
    "auction_has_category_pickup_windows",
]
PICKUP_COLUMNS = f"""
  CAST(p1 AS BIGINT) AS {PICKUP_NAMES[0]}, {r("p2", PICKUP_NAMES[1])}, {r("p3", PICKUP_NAMES[2])},
  {r("p4", PICKUP_NAMES[3])}, CAST(p5 AS BIGINT) AS {PICKUP_NAMES[4]}, CAST(p6 AS BIGINT) AS {PICKUP_NAMES[5]}"""
PICKUP_TABLE = f"pickups(k, p1, p2, p3, p4, p5, p6) AS (VALUES {_PICKUP_ROWS})"


@query(
    "auction_pickup_windows",
    with_(AUCTIONS, PICKUP_TABLE)
    + f"SELECT auction_id, {PICKUP_COLUMNS} FROM auctions JOIN pickups ON auction_id % 8 = k",
)
def auction_pickup_windows(spark, folder):
    df = bindings.auctions(spark, folder).select(KEY, "auction_removal_info")
    return rounded(add_pickup_windows(df, prefix="auction_").drop("auction_removal_info"), KEY)


# --------------------------------------------------------- partner, averages

PARTNER = """CAST(coalesce(auction_partner_url NOT IN ('', 'nan'), FALSE) AS BIGINT) AS auction_has_partner"""
AVERAGES = ",\n".join(
    r(f"auction_total_{c} / nullif(auction_item_count, 0)", f"auction_avg_{out}_per_item")
    for c, out in (("viewed", "views"), ("winning_price", "price"), ("bid_count", "bids"), ("images", "images"))
)


@query("auction_partner_and_averages", with_(AUCTIONS) + f"SELECT auction_id, {PARTNER}, {AVERAGES} FROM auctions")
def auction_partner_and_averages(spark, folder):
    out = ops.add_item_averages(add_partner_flag(bindings.auctions(spark, folder)))
    return rounded(out.select(KEY, "auction_has_partner", *[c for c in out.columns if "_avg_" in c]), KEY)


# ----------------------------------------------------------------- location

FSA = """CASE WHEN regexp_matches(upper(substr(replace(postal, ' ', ''), 1, 3)), '^[A-Z][0-9][A-Z]$')
 THEN upper(substr(replace(postal, ' ', ''), 1, 3)) END"""
LOCATION_COLUMNS = f"""
  coalesce(substr({FSA}, 1, 1), 'Unknown') AS auction_postal_zone,
  {r("lat", "auction_latitude")}, {r("lng", "auction_longitude")},
  {r("sqrt((lat - 43.6532) * (lat - 43.6532) + (lng + 79.3832) * (lng + 79.3832))", "auction_distance_from_toronto")},
  CAST(coalesce(lat > 49, FALSE) AS BIGINT) AS auction_is_northern,
  CAST(coalesce(lng < -120, FALSE) AS BIGINT) AS auction_is_west_coast,
  CAST(coalesce(lng > -65, FALSE) AS BIGINT) AS auction_is_east_coast"""


@query(
    "auction_location",
    with_(ENRICHED_AUCTIONS) + f"SELECT auction_id, {FSA} AS auction_fsa, {LOCATION_COLUMNS} FROM enriched_auctions",
)
def auction_location(spark, folder):
    out = add_location_features(bindings.enriched_auctions(spark, folder))
    return rounded(out.select(KEY, *[c for c in out.columns if c.startswith("auction_") and c != KEY]), KEY)


# --------------------------------------------------------------------- areas

AREAS = """
area_of AS (SELECT *, substr(replace(postal, ' ', ''), 1, 3) AS area FROM places),
population AS (
  SELECT upper(area) AS geo, population, dwellings, occupied FROM (
    SELECT area, count(*) AS population, sum(c_nationkey) AS dwellings, sum(c_nationkey % 5) AS occupied
    FROM (SELECT * REPLACE (CASE WHEN c_custkey % 4 = 1 THEN 'Y' || substr(area, 2) ELSE area END AS area) FROM area_of) moved GROUP BY area) p WHERE length(area) = 3),
tax AS (
  SELECT upper(area) AS fsa, returns, income, net, taxable,
    CASE WHEN returns <> 0 THEN income * 1000 / returns END AS average FROM (
    SELECT area, sum(c_custkey % 3) AS returns, sum(c_custkey % 1000) AS income, sum(c_custkey % 900) AS net,
      sum(c_custkey % 800) AS taxable FROM (SELECT * REPLACE (CASE WHEN c_custkey % 4 = 2 THEN 'X' || substr(area, 2) ELSE area END AS area) FROM area_of) moved GROUP BY area) t WHERE length(area) = 3),
areas AS (SELECT coalesce(geo, fsa) AS area, population, dwellings, occupied, returns, income, net, taxable, average
  FROM population FULL JOIN tax ON geo = fsa),
lookup AS (SELECT * FROM areas WHERE regexp_matches(area, '^[A-Z][0-9][A-Z]$')
  QUALIFY row_number() OVER (PARTITION BY area) = 1)
"""
AREA_SHORT = {
    "FSA": "area",
    "Population, 2021": "population",
    "Total private dwellings, 2021": "dwellings",
    "Private dwellings occupied by usual residents, 2021": "occupied",
    "Number of Returns": "returns",
    "Total Income": "income",
    "Net Income": "net",
    "Taxable Income": "taxable",
    "Average Total Income": "average",
}
AREA_COLUMNS = f"""CAST(population AS BIGINT) AS population, CAST(dwellings AS BIGINT) AS dwellings,
  CAST(occupied AS BIGINT) AS occupied, CAST(returns AS BIGINT) AS returns, CAST(income AS BIGINT) AS income,
  CAST(net AS BIGINT) AS net, CAST(taxable AS BIGINT) AS taxable, {r("average", "average")}"""


@query("area_lookup", with_(POSTAL, AREAS) + f"SELECT area, {AREA_COLUMNS} FROM areas")
def area_lookup_query(spark, folder):
    population, tax = bindings.areas(spark, folder)
    merged = area_lookup(clean_population(population), clean_tax(tax))
    return rounded(merged.drop("Median Total Income").withColumnsRenamed(AREA_SHORT), "area")


# Each area key occurs once per case; the grouped variant keeps one row per area.
GROUPED_AREAS = """
customers AS (SELECT *, upper(substr(replace(postal, ' ', ''), 1, 3)) AS area FROM places),
population AS (SELECT area, count(*) AS population, sum(c_nationkey) AS dwellings, sum(c_nationkey % 5) AS occupied
  FROM (SELECT * REPLACE (CASE WHEN c_custkey % 4 = 1 THEN 'Y' || substr(area, 2) ELSE area END AS area) FROM customers) moved WHERE length(area) = 3 GROUP BY area),
tax AS (SELECT area, sum(c_custkey % 3) AS returns, sum(c_custkey % 1000) AS income,
  CASE WHEN sum(c_custkey % 3) <> 0 THEN sum(c_custkey % 1000) * 1000 / sum(c_custkey % 3) END AS average
  FROM (SELECT * REPLACE (CASE WHEN c_custkey % 4 = 2 THEN 'X' || substr(area, 2) ELSE area END AS area) FROM customers) moved WHERE length(area) = 3 GROUP BY area),
areas AS (SELECT coalesce(p.area, t.area) AS area, population, dwellings, occupied, returns, income, average
  FROM population p FULL JOIN tax t ON p.area = t.area)
"""


def grouped_lookup(spark, folder):
    """One row per area: the raw rows of both cases added up before the merge."""
    population, tax = bindings.areas(spark, folder)

    def summed(df, key):
        numbers = [c for c in df.columns if c != key]
        return df.groupBy(key).agg(*[F.sum(F.col(f"`{c}`")).alias(c) for c in numbers])

    population = summed(clean_population(population), "GEO")
    tax = tax.withColumn("FSA", F.upper("FSA"))
    return area_lookup(population, clean_tax(summed(tax, "FSA")))


AREA_FEATURES = f"""
  CAST(population AS BIGINT) AS auction_area_population, CAST(dwellings AS BIGINT) AS auction_area_total_dwellings,
  CAST(occupied AS BIGINT) AS auction_area_occupied_dwellings, CAST(returns AS BIGINT) AS auction_area_tax_returns,
  CAST(income AS BIGINT) AS auction_area_total_income, {r("average", "auction_area_avg_income")},
  {r("average", "auction_area_median_income")},
  {r("population / nullif(occupied, 0)", "auction_area_persons_per_dwelling")},
  {r("occupied / nullif(dwellings, 0)", "auction_area_occupancy_rate")},
  {r("returns / nullif(population, 0)", "auction_area_tax_filing_rate")}"""
AREA_JOIN = f"(SELECT *, {FSA} AS fsa FROM enriched_auctions) e LEFT JOIN areas ON fsa = area"


@query(
    "auction_area_features",
    with_(ENRICHED_AUCTIONS, GROUPED_AREAS) + f"SELECT auction_id, {AREA_FEATURES} FROM {AREA_JOIN}",
)
def auction_area_features(spark, folder):
    located = add_location_features(bindings.enriched_auctions(spark, folder)).select(KEY, "auction_fsa")
    out = ops.add_area_features(located, grouped_lookup(spark, folder))
    return rounded(out.select(KEY, *[c for c in out.columns if c.startswith("auction_area_")]), KEY)


@query(
    "area_ratios",
    with_(POSTAL, GROUPED_AREAS)
    + f"""SELECT c_custkey, {r("population / nullif(occupied, 0)", "persons_per_dwelling")},
      {r("occupied / nullif(dwellings, 0)", "occupancy_rate")},
      {r("returns / nullif(population, 0)", "returns_per_capita")},
      {r("CASE WHEN average <> 0 THEN 0 END", "income_skew")},
      {r("average * population / 1e9", "economic_capacity")},
      {r("population / nullif(occupied, 0) * ln(1 + population)", "urbanisation")},
      coalesce(CASE WHEN average > 0 AND average <= 30000 THEN 'low' WHEN average > 30000 AND average <= 50000
        THEN 'lower_mid' WHEN average > 50000 AND average <= 75000 THEN 'mid' WHEN average > 75000 AND
        average <= 100000 THEN 'upper_mid' WHEN average > 100000 THEN 'high' END, 'unknown') AS income_tier,
      CAST(CASE WHEN regexp_matches(c.area, '^[A-Z][0-9][A-Z]$') AND a.area IS NOT NULL THEN 1 ELSE 0 END AS BIGINT)
        AS has_enriched_data
    FROM customers c LEFT JOIN areas a ON c.area = a.area AND regexp_matches(c.area, '^[A-Z][0-9][A-Z]$')""",
)
def area_ratios(spark, folder):
    people = bindings.table(spark, folder, "customer").select("c_custkey", bindings.postal_code().alias("postal_code"))
    known = grouped_lookup(spark, folder).withColumn("known", F.lit(1))
    out = ops.enrich_by_postal_code(people, known, "postal_code")
    out = out.withColumns(
        {
            "urbanisation": urbanisation(F.col("persons_per_dwelling"), F.col("`Population, 2021`")),
            "income_tier": income_tier(F.col("Median Total Income"), "unknown"),
            "has_enriched_data": F.coalesce("known", F.lit(0)),
        }
    )
    names = [
        "persons_per_dwelling",
        "occupancy_rate",
        "returns_per_capita",
        "income_skew",
        "economic_capacity",
        "urbanisation",
        "income_tier",
        "has_enriched_data",
    ]
    return rounded(out.select("c_custkey", *names), "c_custkey")


# ---------------------------------------------------------------- categories


def _levels(column, prefix, levels):
    return ",\n".join(
        f"CAST(coalesce({column}, 'Unknown') = '{level}' AS BIGINT) AS \"{prefix}_{name}\"" for level, name in levels
    )


ONE_HOT = ",\n".join(
    [
        _levels(
            "category",
            "auction_category",
            [
                ("1-URGENT", "1_URGENT"),
                ("2-HIGH", "2_HIGH"),
                ("3-MEDIUM", "3_MEDIUM"),
                ("4-NOT SPECIFIED", "4_NOT_SPECIFIED"),
                ("5-LOW", "5_LOW"),
                ("Unknown", "Unknown"),
            ],
        ),
        _levels("type", "auction_type", [("F", "F"), ("O", "O"), ("P", "P")]),
        _levels(
            "region",
            "auction_region",
            [
                ("AFRICA", "AFRICA"),
                ("AMERICA", "AMERICA"),
                ("ASIA", "ASIA"),
                ("EUROPE", "EUROPE"),
                ("MIDDLE EAST", "MIDDLE_EAST"),
                ("Unknown", "Unknown"),
            ],
        ),
        _levels("country", "auction_country", [("CA", "CA"), ("US", "US")]),
    ]
)
FREQUENCY = ",\n".join(
    f"{r(f'count(*) OVER (PARTITION BY {c}) / (SELECT count(*) FROM orders)', f'auction_{c}_frequency')}, "
    f"count(*) OVER (PARTITION BY {c}) AS auction_{c}_count"
    for c in ("city", "province")
)


@query(
    "auction_categories",
    with_(ENRICHED_AUCTIONS) + f"SELECT auction_id, {ONE_HOT}, {FREQUENCY} FROM enriched_auctions",
)
def auction_categories(spark, folder):
    df = bindings.enriched_auctions(spark, folder)
    out = fit_auction_encoder(df).transform(df)
    return rounded(out.select(*[c for c in out.columns if c.startswith("auction_")]), KEY)


@query(
    "auction_categories_fixed_levels",
    with_(ENRICHED_AUCTIONS)
    + "SELECT auction_id, "
    + _levels("type", "auction_type", [("F", "F"), ("O", "O"), ("X", "X")])
    + " FROM enriched_auctions",
)
def auction_categories_fixed_levels(spark, folder):
    df = bindings.enriched_auctions(spark, folder).select(KEY, "enriched_auction_type")
    encoder = fit_auction_encoder(df, {"enriched_auction_type": ["F", "O", "X"]})
    return rounded(encoder.transform(df).drop("enriched_auction_type"), KEY)


# ------------------------------------------------------------ the whole table

WHOLE = (
    with_(AUCTIONS, ENRICHED_AUCTIONS, GROUPED_AREAS, PICKUP_TABLE)
    + f"""SELECT a.auction_id, epoch_us(auction_starts) AS auction_starts, epoch_us(auction_ends) AS auction_ends,
  epoch_us(auction_last_item_closes) AS auction_last_item_closes, auction_status, auction_item_count,
  auction_total_viewed, {r("auction_total_winning_price", "auction_total_winning_price")},
  auction_total_bid_count, auction_total_images,
  {LENGTH_COLUMNS}, {PICKUP_COLUMNS}, {PARTNER}, {AVERAGES}, {LOCATION_COLUMNS}, {AREA_FEATURES}, {ONE_HOT}, {FREQUENCY}
FROM auctions a JOIN pickups ON a.auction_id % 8 = k JOIN {AREA_JOIN} ON a.auction_id = e.auction_id"""
)


@query("auction_features", WHOLE)
def auction_features(spark, folder):
    out = ops.engineer_auction_features(
        bindings.auctions(spark, folder), bindings.enriched_auctions(spark, folder), grouped_lookup(spark, folder)
    )
    return rounded(out, KEY)


@query(
    "auctions_with_enrichment",
    with_(AUCTIONS, ENRICHED_AUCTIONS)
    + """SELECT a.auction_id, auction_status, category AS enriched_auction_category, city AS
      "enriched_auction_approxLocation_city" FROM auctions a LEFT JOIN enriched_auctions e
      ON a.auction_id = e.auction_id AND a.auction_id % 3 <> 0""",
)
def auctions_with_enrichment(spark, folder):
    # Some under a number that no auction has.
    moved = F.when(F.col(KEY) % 3 == 0, -1 - F.col(KEY)).otherwise(F.col(KEY))
    enriched = bindings.enriched_auctions(spark, folder).withColumn(KEY, moved)
    out = merge(bindings.auctions(spark, folder), enriched, [KEY], "left")
    return out.select(KEY, "auction_status", "enriched_auction_category", "enriched_auction_approxLocation_city")


# ------------------------------------------------------------------ calendar


def calendar_sql(ts: str, prefix: str, cyclical: bool = True) -> str:
    day, dow, month = f"day({ts})", f"(isodow({ts}) - 1)", f"month({ts})"
    monday = lambda m, a, b: f"({month} = {m} AND {dow} = 0 AND {day} BETWEEN {a} AND {b})"
    us = (
        f"(({month} = 1 AND {day} = 1) OR ({month} = 7 AND {day} = 4) OR ({month} = 12 AND {day} = 25) OR "
        f"{monday(5, 25, 31)} OR {monday(9, 1, 7)} OR ({month} = 11 AND {dow} = 3 AND {day} BETWEEN 22 AND 28))"
    )
    ca = (
        f"(({month} = 1 AND {day} = 1) OR ({month} = 7 AND {day} = 1) OR ({month} = 12 AND {day} = 25) OR "
        f"{monday(9, 1, 7)} OR {monday(10, 8, 14)})"
    )
    hour = f"hour({ts})"
    part = f"CASE WHEN {hour} < 6 THEN 'night' WHEN {hour} < 12 THEN 'morning' WHEN {hour} < 18 THEN 'afternoon' WHEN {hour} < 24 THEN 'evening' END"
    time_of_year = f"CASE WHEN {month} IN (12, 1, 2) THEN 'winter' WHEN {month} IN (3, 4, 5) THEN 'spring' WHEN {month} IN (6, 7, 8) THEN 'summer' WHEN {month} > 8 THEN 'fall' END"
    flag = lambda c: f"CAST(coalesce({c}, FALSE) AS BIGINT)"
    out = {
        "year": f"year({ts})",
        "month": month,
        "day": day,
        "hour": hour,
        "minute": f"minute({ts})",
        "day_of_week": dow,
        "day_of_year": f"dayofyear({ts})",
        "week_of_year": f"weekofyear({ts})",
        "quarter": f"quarter({ts})",
        "is_weekend": flag(f"{dow} >= 5"),
        "is_weekday": flag(f"{dow} < 5"),
        "part_of_day": part,
        "is_working_hours": flag(f"{hour} >= 9 AND {hour} < 17 AND {dow} < 5"),
        "is_business_day": flag(f"{dow} < 5"),
        "season": time_of_year,
        "is_us_holiday": flag(us),
        "is_canadian_holiday": flag(ca),
        "is_holiday": flag(f"{us} OR {ca}"),
    }
    out |= {f"is_{p}": flag(f"({part}) = '{p}'") for p in ("morning", "afternoon", "evening", "night")}
    out |= {f"is_{p}": flag(f"({time_of_year}) = '{p}'") for p in ("winter", "spring", "summer", "fall")}
    columns = [f'{c} AS "{prefix}{n}"' for n, c in out.items()]
    if cyclical:
        cycles = {"hour": (hour, 24), "day_of_week": (dow, 7), "month": (month, 12), "day_of_year": (f"dayofyear({ts})", 365)}
        for n, (value, period) in cycles.items():
            for f in ("sin", "cos"):
                columns.append(r(f"{f}(2 * pi() * {value} / {period})", f"{prefix}{n}_{f}"))
    return ",\n".join(columns)


@query("auction_calendar", with_(AUCTIONS) + f"SELECT auction_id, {calendar_sql('auction_last_item_closes', 'closes_')} FROM auctions")
def auction_calendar(spark, folder):
    df = bindings.auctions(spark, folder).select(KEY, "auction_last_item_closes")
    return rounded(add_calendar(df, "auction_last_item_closes", "closes_", drop_original=True), KEY)


@query("bid_calendar", with_(BIDS) + f"SELECT bid_id, {calendar_sql('make_timestamp(u)', 'bid_')} FROM bids")
def bid_calendar(spark, folder):
    out = ops.engineer_bid_times(bindings.bids(spark, folder).select("bid_id", "bid_time"))
    return rounded(out.drop("bid_time"), "bid_id")


@query(
    "auction_times",
    with_(AUCTIONS, PICKUP_TABLE)
    + f"""SELECT auction_id, CAST(p1 AS BIGINT) AS num_pickup_windows, {r("p2", "total_pickup_hours")},
      {calendar_sql("auction_starts", "auction_start_")}, {calendar_sql("auction_ends", "auction_end_")},
      {r(f"({HOURS}) / 3.6e9", "auction_duration_hours")} FROM auctions JOIN pickups ON auction_id % 8 = k""",
)
def auction_times(spark, folder):
    """The feature bundle's auction table: pickup windows, both calendars and the duration."""
    auctions = bindings.auctions(spark, folder).select(
        KEY, "auction_removal_info", F.col("auction_starts").alias("start_time"), F.col("auction_ends").alias("end_time")
    )
    bundle = ops.feature_bundle(auctions, bindings.items(spark, folder), bindings.bids(spark, folder))
    out = bundle["auctions"]
    names = [c for c in out.columns if c.startswith(("auction_start_", "auction_end_"))]
    return rounded(out.select(KEY, "num_pickup_windows", "total_pickup_hours", *names, "auction_duration_hours"), KEY)


@query(
    "calendars_of_two_columns",
    with_(AUCTIONS)
    + f"""SELECT auction_id, {calendar_sql("auction_starts", "auction_starts_", False)},
      {calendar_sql("auction_ends", "auction_ends_", False)} FROM auctions""",
)
def calendars_of_two_columns(spark, folder):
    df = bindings.auctions(spark, folder).select(KEY, "auction_starts", "auction_ends")
    out = add_calendars(df, ["auction_starts", "auction_ends", "no_such_column"], include_cyclical=False)
    return rounded(out.drop("auction_starts", "auction_ends"), KEY)


@query(
    "southern_seasons",
    with_(AUCTIONS)
    + """SELECT auction_id, CASE WHEN month(auction_starts) IN (6, 7, 8) THEN 'winter' WHEN month(auction_starts) IN (9, 10, 11)
    THEN 'spring' WHEN month(auction_starts) IN (12, 1, 2) THEN 'summer' ELSE 'fall' END AS season FROM auctions""",
)
def southern_seasons(spark, folder):
    df = bindings.auctions(spark, folder)
    return df.select(KEY, season(F.month("auction_starts"), "south").alias("season"))


REFERENCE = "1998-01-01 06:30:00"


@query(
    "time_since_and_until",
    with_(AUCTIONS)
    + "SELECT auction_id, "
    + ",\n".join(
        r(f"(epoch_us(auction_ends) - epoch_us(auction_starts)) / 1e6 / {s}", f"since_{n}")
        + ", "
        + r(f"(epoch_us(auction_ends) - epoch_us(TIMESTAMP '{REFERENCE}')) / 1e6 / {s}", f"until_{n}")
        for n, s in (("total_seconds", 1), ("days", 86400), ("hours", 3600), ("minutes", 60))
    )
    + f", CAST(auction_ends < TIMESTAMP '{REFERENCE}' AS BIGINT) AS until_has_passed FROM auctions",
)
def time_since_and_until(spark, folder):
    df = bindings.auctions(spark, folder).select(KEY, "auction_starts", "auction_ends")
    df = add_time_since(df, "auction_ends", "auction_starts", "since_")
    df = add_time_until(df, "auction_ends", F.lit(REFERENCE).cast("timestamp"), "until_")
    return rounded(df.drop("auction_starts", "auction_ends"), KEY)


# ---------------------------------------------------------------- bid timing

START_US = "(2840112 + auction_id * 60) * 1000000"
END_US = "(2842000 + auction_id * 200) * 1000000"


def bids_with_schedule(spark, folder):
    """Bids with the start and end of their auction, ten of which share all bids."""
    return bindings.bids(spark, folder).withColumns(
        {
            "auction_start_time": F.timestamp_micros(F.expr(START_US)),
            "auction_end_time": F.timestamp_micros(F.expr(END_US)),
        }
    )


@query(
    "bid_timing",
    with_(BIDS)
    + f"""SELECT bid_id, {r("e / 1e6", "bid_timing_seconds_since_start")}, {r("e / 1e6 / 3600", "bid_timing_hours_since_start")},
  {r("l / 1e6", "bid_timing_seconds_until_end")}, {r("l / 1e6 / 3600", "bid_timing_hours_until_end")},
  {r("l / 1e6 / 60", "bid_timing_minutes_until_end")}, CAST(l <= 120000000 AS BIGINT) AS bid_timing_is_last_minute,
  {r("e / d", "bid_timing_pct_through_auction")},
  CASE WHEN e / d >= 0 AND e / d <= 0.25 THEN 'early' WHEN e / d > 0.25 AND e / d <= 0.75 THEN 'middle'
    WHEN e / d > 0.75 AND e / d <= 0.95 THEN 'late' WHEN e / d > 0.95 AND e / d <= 1 THEN 'last_minute' END
    AS bid_timing_position
FROM (SELECT bid_id, (u - {START_US})::DOUBLE AS e, ({END_US} - u)::DOUBLE AS l, ({END_US} - {START_US})::DOUBLE AS d FROM bids) t""",
)
def bid_timing(spark, folder):
    out = add_bid_timing(bids_with_schedule(spark, folder))
    return rounded(out.select("bid_id", *[c for c in out.columns if c.startswith("bid_timing_")]), "bid_id")
