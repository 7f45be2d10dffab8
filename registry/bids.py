"""Bid-grain queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from gavelworks.operators.bids import GROUPS, engineer_bid_features
from gavelworks.sources.bindings import bids
from registry.common import BIDS, COARSE_BIDS, query, r, rounded, with_

STEP = """CASE WHEN {0} < 0 THEN 250 WHEN {0} < 10 THEN 1 WHEN {0} < 40 THEN 3 WHEN {0} < 100 THEN 5
 WHEN {0} < 1000 THEN 10 WHEN {0} < 5000 THEN 50 WHEN {0} < 10000 THEN 100 ELSE 250 END"""

W = "PARTITION BY item_id ORDER BY u, bid_id"
FAR = f"({W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"

BASE = f"""
base AS (
  SELECT *, row_number() OVER ({W}) AS n, lag(u) OVER ({W}) AS pu, lag(bid_amount) OVER ({W}) AS pa,
    lag(bid_amount, 2) OVER ({W}) AS pa2, first_value(u) OVER {FAR} AS fu, max(u) OVER {FAR} AS mu,
    first_value(bid_amount) OVER {FAR} AS fa, max(bid_amount) OVER {FAR} AS ma,
    avg(bid_amount) OVER {FAR} AS aa, median(bid_amount) OVER {FAR} AS da
  FROM bids)
"""


def spark_bids(spark, folder, groups, coarse=False, data=None, **options):
    data = bids(spark, folder, coarse) if data is None else data
    out = engineer_bid_features(data, tiebreak=["bid_id"], groups=groups, **options)
    out = out.drop("bid_time", "bid_amount", "is_proxy_bid", "auction_id")
    return rounded(out, "item_id", "bid_id")


ELAPSED_SQL = f"""
SELECT item_id, bid_id,
  {r("(u - fu) / 1e6", "time_since_first_bid_seconds")},
  {r("coalesce((u - pu) / 1e6, 0)", "time_since_last_bid_seconds")},
  {r("CASE WHEN mu > fu THEN (u - fu) / (mu - fu) ELSE 0 END", "elapsed_time_fraction")},
  {r("(u - fu) / 1e6 / 60", "time_since_first_bid_minutes")},
  {r("(u - fu) / 1e6 / 3600", "time_since_first_bid_hours")},
  {r("coalesce((u - pu) / 1e6, 0) / 60", "time_since_last_bid_minutes")}
FROM base"""

COUNT_SQL = f"""
SELECT item_id, bid_id, n AS number_of_bids_so_far, CASE WHEN n = 1 THEN 1 ELSE 0 END AS is_first_bid,
  n1 AS rolling_bid_count_1min, n5 AS rolling_bid_count_5min,
  {r("n5 / 5.0", "bid_velocity_5min")},
  {r("n5 / 5.0 - p5 / 5.0", "bid_acceleration")},
  {r("tw", "time_weighted_bid_velocity")}
FROM (SELECT base.item_id, bid_id, n, u,
    (SELECT count(*) FROM base b WHERE b.item_id = base.item_id AND b.n <= base.n AND b.u >= base.u - 60000000) AS n1,
    (SELECT count(*) FROM base b WHERE b.item_id = base.item_id AND b.n <= base.n AND b.u >= base.u - 300000000) AS n5,
    (SELECT count(*) FROM base b WHERE b.item_id = base.item_id AND b.n <= base.n
       AND b.u >= base.u - 600000000 AND b.u < base.u - 300000000) AS p5,
    (SELECT sum(exp(-ln(2) / 120 * (base.u - b.u) / 1e6)) FROM base b
       WHERE b.item_id = base.item_id AND b.n <= base.n) AS tw
  FROM base) t"""

AMOUNT_SQL = f"""
SELECT item_id, bid_id, {r("inc", "bid_increment")},
  {r("CASE WHEN pa > 0 THEN inc / pa * 100 END", "bid_increment_pct")},
  CASE WHEN pa IS NOT NULL AND (bid_amount - pa < step OR bid_amount - pa > 3 * step) THEN 1 ELSE 0 END
    AS is_unusual_increment,
  {r("CASE WHEN pa > 0 THEN (bid_amount - pa) / step END", "increment_deviation_ratio")},
  is_proxy_bid AS proxy_bid_flag,
  {r("(SELECT count(*) FROM base b WHERE b.item_id = t.item_id AND b.n <= t.n AND b.bid_amount <= t.bid_amount) / n * 100.0", "bid_amount_percentile_so_far")},
  {r("bid_amount - aa", "bid_amount_relative_to_mean")},
  {r("bid_amount - da", "bid_amount_relative_to_median")},
  {r("CASE WHEN ma > 0 THEN bid_amount / ma ELSE 1 END", "bid_amount_relative_to_max")},
  {r(f"sum(inc) OVER {FAR}", "cumulative_bid_increment_sum")},
  {r(f"avg(inc) OVER ({W} ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)", "rolling_avg_increment_5")}
FROM (SELECT *, coalesce(bid_amount - pa, bid_amount) AS inc, {STEP.format("pa")} AS step FROM base) t"""

PROGRESS_SQL = f"""
SELECT item_id, bid_id, n AS bid_number, {r("1", "bid_number_normalized")},
  {r("CASE WHEN fa > 0 THEN bid_amount / fa END", "current_to_starting_bid_ratio")},
  {r("CASE WHEN ma > 0 THEN bid_amount / ma ELSE 1 END", "current_to_highest_ratio")},
  CASE WHEN bid_amount = ma THEN 1 ELSE 0 END AS is_new_high,
  {r("CASE WHEN n > 2 AND (bid_amount - fa) / n > 0 THEN ((bid_amount - pa2) / 3.0 - (bid_amount - fa) / n) / ((bid_amount - fa) / n) ELSE 0 END", "bid_momentum")}
FROM base"""

CLUSTER_SQL = f"""
SELECT item_id, bid_id, k AS bid_cluster_size_so_far, CASE WHEN k > 1 THEN 1 ELSE 0 END AS is_in_bid_cluster,
  {r("(u - first_value(u) OVER (PARTITION BY item_id, c ORDER BY u, bid_id)) / 1e6", "time_since_cluster_start_seconds")},
  {r("coalesce((u - pu) / 1e6, 0)", "time_since_last_bid_seconds")}
FROM (SELECT *, row_number() OVER (PARTITION BY item_id, c ORDER BY u, bid_id) AS k
  FROM (SELECT *, sum(CASE WHEN u - pu > 30000000 THEN 1 ELSE 0 END) OVER {FAR} AS c FROM base) a) b"""

PARTS = {
    "time_series": ELAPSED_SQL,
    "bid_counts": COUNT_SQL,
    "bid_amounts": AMOUNT_SQL,
    "auction_progress": PROGRESS_SQL,
    "temporal_activity": CLUSTER_SQL,
}
LABELS = {
    "time_series": "bid_elapsed_times",
    "bid_counts": "bid_counts_and_velocity",
    "bid_amounts": "bid_amounts_so_far",
    "auction_progress": "bid_progress",
    "temporal_activity": "bid_clusters",
}

for _group, _sql in PARTS.items():
    query(LABELS[_group], with_(BIDS, BASE) + _sql)(
        lambda spark, folder, g=_group: spark_bids(spark, folder, [g])
    )
    query(LABELS[_group] + "_with_ties", with_(COARSE_BIDS, BASE) + _sql)(
        lambda spark, folder, g=_group: spark_bids(spark, folder, [g], coarse=True)
    )


ALL_SQL = f"""SELECT * FROM ({ELAPSED_SQL}) a JOIN ({COUNT_SQL}) b USING (item_id, bid_id) JOIN ({AMOUNT_SQL}) c USING (item_id, bid_id)
  JOIN ({PROGRESS_SQL}) d USING (item_id, bid_id)
  JOIN (SELECT * EXCLUDE (time_since_last_bid_seconds) FROM ({CLUSTER_SQL}) x) e USING (item_id, bid_id)"""


@query("bid_features", with_(BIDS, BASE) + ALL_SQL)
def bid_features(spark, folder):
    """Every feature group in one plan with one exchange."""
    return spark_bids(spark, folder, GROUPS)


# A third of all bids go to one item; a small limit spreads it over many chunks.
HUGE_BIDS = BIDS.replace("user_id AS item_id", "CASE WHEN event_id % 3 = 0 THEN 999999 ELSE user_id END AS item_id")


@query("bid_features_of_a_huge_item", with_(HUGE_BIDS, BASE) + ALL_SQL)
def bid_features_of_a_huge_item(spark, folder):
    """The chunked path: every feature when one item holds a third of the bids."""
    data = bids(spark, folder).withColumn(
        "item_id", F.when(F.col("bid_id") % 3 == 0, 999999).otherwise(F.col("item_id"))
    )
    limit = max(100, data.count() // 20)
    return spark_bids(spark, folder, GROUPS, data=data, item_limit=limit)


# Some bids without an amount, and all bids of some items without their item.
GAPPED_BIDS = BIDS.replace("value AS bid_amount", "CASE WHEN event_id % 9 <> 0 THEN value END AS bid_amount").replace(
    "user_id AS item_id", "CASE WHEN user_id % 13 <> 0 THEN user_id END AS item_id"
)


def gapped(sql: str) -> str:
    """The SQL of a feature group where amounts and items may be missing."""
    for old, new in (
        ("b.item_id = base.item_id", "b.item_id IS NOT DISTINCT FROM base.item_id"),
        ("b.item_id = t.item_id", "b.item_id IS NOT DISTINCT FROM t.item_id"),
        ("coalesce(bid_amount - pa, bid_amount) AS inc", "CASE WHEN n = 1 THEN bid_amount ELSE bid_amount - pa END AS inc"),
        (
            "(SELECT count(*) FROM base b WHERE b.item_id IS NOT DISTINCT FROM t.item_id AND b.n <= t.n AND b.bid_amount <= t.bid_amount) / n",
            "CASE WHEN bid_amount IS NOT NULL THEN (SELECT count(*) FROM base b WHERE b.item_id IS NOT DISTINCT FROM t.item_id"
            " AND b.n <= t.n AND b.bid_amount <= t.bid_amount) END / (SELECT count(bid_amount) FROM base b"
            " WHERE b.item_id IS NOT DISTINCT FROM t.item_id AND b.n <= t.n)",
        ),
        ("CASE WHEN bid_amount = ma THEN 1 ELSE 0 END", "CASE WHEN bid_amount IS NOT NULL THEN CAST(bid_amount = ma AS INTEGER) END"),
    ):
        sql = sql.replace(old, new)
    return sql


def joined_groups(groups: list[str]) -> str:
    """Feature groups side by side; a column that two of them have is taken once."""
    first, *rest = groups
    again = {CLUSTER_SQL: "item_id, time_since_last_bid_seconds"}
    parts = [f"({gapped(first)}) g0"]
    for i, sql in enumerate(rest, 1):
        parts.append(f"(SELECT * EXCLUDE ({again.get(sql, 'item_id')}) FROM ({gapped(sql)}) x) g{i}")
    return "SELECT * FROM " + " JOIN ".join(parts[:1]) + "".join(f" JOIN {p} USING (bid_id)" for p in parts[1:])


GROUP_SQL = [ELAPSED_SQL, COUNT_SQL, AMOUNT_SQL, PROGRESS_SQL, CLUSTER_SQL]


def with_gaps(bids):
    """Amounts and items taken away from some bids."""
    return bids.withColumns(
        {
            "bid_amount": F.when(F.col("bid_id") % 9 != 0, F.col("bid_amount")),
            "item_id": F.when(F.col("item_id") % 13 != 0, F.col("item_id")),
        }
    )


@query("bid_features_with_gaps", with_(GAPPED_BIDS, BASE) + joined_groups(GROUP_SQL))
def bid_features_with_gaps(spark, folder):
    """Every feature where amounts and items are missing."""
    return spark_bids(spark, folder, GROUPS, data=with_gaps(bids(spark, folder)))


@query(
    "bid_progress_with_own_numbers",
    with_(BIDS, BASE)
    + f"""SELECT item_id, bid_id, number AS bid_number, {r(f"number / max(number) OVER {FAR}", "bid_number_normalized")}
      FROM (SELECT *, CASE WHEN bid_id % 7 <> 0 THEN bid_id % 50 + 1 END AS number FROM base) t""",
)
def bid_progress_with_own_numbers(spark, folder):
    """The caller's own numbers, out of order and with gaps, as a share of the highest so far."""
    number = F.when(F.col("bid_id") % 7 != 0, F.col("bid_id") % 50 + 1)
    data = bids(spark, folder).withColumn("bid_number", number)
    out = spark_bids(spark, folder, ["auction_progress"], data=data)
    return out.select("item_id", "bid_id", "bid_number", "bid_number_normalized")
