"""Registration helpers and the SQL twins of the table bindings."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gavelworks.sources.bindings import REMOVAL_NOTES

# Engines round exact halves differently; both sides move off the half first.
OFF_THE_HALF = 1.3e-9

QUERIES: dict[str, Callable] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query under ``name``, with its SQL when there is one."""

    def add(run: Callable) -> Callable:
        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = sql
        return run

    return add


def rounded(df: DataFrame, *keep: str, digits: int = 6) -> DataFrame:
    """Doubles to ``digits`` decimals, integers to 64 bits, flags to 0/1, times to micros."""
    names = [*keep, *[c for c in df.columns if c not in keep]]
    out = []
    for name in names:
        kind, c = dict(df.dtypes)[name], F.col(f"`{name}`")
        if kind in ("double", "float"):
            c = F.round(c.cast("double") + F.lit(OFF_THE_HALF), digits)
        elif kind.startswith("timestamp"):
            c = F.unix_micros(c.cast("timestamp"))
        elif kind in ("int", "smallint", "tinyint", "boolean"):
            c = c.cast("int").cast("long")
        out.append(c.alias(name))
    return df.select(*out)


def r(expression: str, name: str, digits: int = 6) -> str:
    """SQL twin of the rounding."""
    return f"round(cast({expression} as double) + {OFF_THE_HALF}, {digits}) AS \"{name}\""


BIDS = """
bids AS (
  SELECT user_id AS item_id, user_id % 10 AS auction_id, event_id AS bid_id,
         epoch_us(ts) // 600 AS u, value AS bid_amount,
         CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END AS is_proxy_bid
  FROM events)
"""

COARSE_BIDS = """
bids AS (
  SELECT user_id AS item_id, user_id % 10 AS auction_id, event_id AS bid_id,
         epoch_us(ts) // 600 // 60000000 * 60000000 AS u, value AS bid_amount,
         CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END AS is_proxy_bid
  FROM events)
"""

_NOTES = "\n".join(f"    WHEN {i} THEN '{note}'" for i, note in enumerate(REMOVAL_NOTES))

AUCTIONS = f"""
totals AS (
  SELECT l_orderkey, count(*) AS auction_item_count,
         CAST(sum(l_quantity) AS BIGINT) AS auction_total_viewed,
         round(sum(l_extendedprice), 2) AS auction_total_winning_price,
         CAST(sum(l_linenumber) AS BIGINT) AS auction_total_bid_count,
         CAST(sum(l_linenumber % 4) AS BIGINT) AS auction_total_images
  FROM lineitem GROUP BY l_orderkey),
auctions AS (
  SELECT o_orderkey AS auction_id, 'Auction ' || o_orderkey AS auction_title,
    CAST(o_orderdate AS TIMESTAMP) AS auction_starts,
    CAST(o_orderdate AS TIMESTAMP) + to_days(CAST(o_orderkey % 10 AS INTEGER)) AS auction_ends,
    CAST(o_orderdate AS TIMESTAMP) + to_days(CAST(o_orderkey % 10 AS INTEGER))
      + to_minutes(o_orderkey % 7 * 5) AS auction_last_item_closes,
    CASE WHEN o_orderkey % 24 = 5 THEN NULL ELSE CASE o_orderkey % 8
{_NOTES}
    END END AS auction_removal_info,
    CASE o_orderkey % 5 WHEN 0 THEN 'https://partner.example/' || o_orderkey
      WHEN 1 THEN '' WHEN 2 THEN 'nan' WHEN 3 THEN 'None' END AS auction_partner_url,
    CASE WHEN o_orderstatus = 'F' THEN 'completed' ELSE 'open' END AS auction_status,
    coalesce(auction_item_count, 0) AS auction_item_count,
    auction_total_viewed, auction_total_winning_price, auction_total_bid_count, auction_total_images
  FROM orders LEFT JOIN totals ON o_orderkey = l_orderkey)
"""

POSTAL = """
places AS (
  SELECT c.*, CASE WHEN c_custkey % 11 = 0 THEN NULL
      WHEN c_custkey % 13 = 0 THEN '9' || code
      WHEN c_custkey % 3 = 0 THEN lower(code || ' 3a8')
      WHEN c_custkey % 3 = 1 THEN code || '3A8'
      ELSE code || ' 3A8' END AS postal
  FROM (SELECT *, substr('ABCEGHJKLM', CAST(c_custkey % 10 AS INTEGER) + 1, 1) || (c_custkey % 7)
          || substr('ABCEGHJKLM', CAST(c_custkey % 3 AS INTEGER) + 1, 1) AS code FROM customer) c)
"""

ENRICHED_AUCTIONS = POSTAL + """,
enriched_auctions AS (
  SELECT o_orderkey AS auction_id,
    CASE WHEN o_orderkey % 17 <> 0 THEN o_orderpriority END AS category,
    o_orderstatus AS type,
    CASE WHEN o_orderkey % 19 <> 0 THEN r_name END AS region,
    c_name AS city, CASE WHEN c_nationkey < 10 THEN 'CA' ELSE 'US' END AS country, n_name AS province,
    postal, CASE WHEN c_custkey % 9 <> 0 THEN 40.0 + c_custkey % 20 END::DOUBLE AS lat,
    CASE WHEN c_custkey % 9 <> 0 THEN -135.0 + c_custkey % 80 END::DOUBLE AS lng
  FROM orders LEFT JOIN places ON o_custkey = c_custkey
  LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey)
"""

ITEMS = """
lots AS (
  SELECT *, row_number() OVER (PARTITION BY l_orderkey
      ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS lot FROM lineitem),
items AS (
  SELECT l_orderkey * 100 + lot AS item_id, l_orderkey AS auction_id, lot AS item_lot_number,
    CASE WHEN (l_orderkey * 100 + lot) % 23 <> 0 THEN p_name END AS item_title,
    CASE (l_orderkey * 100 + lot) % 7 WHEN 0 THEN NULL WHEN 1 THEN ''
      ELSE p_name || ' ' || p_type || ' ' || p_brand END AS item_description,
    CASE WHEN (l_orderkey * 100 + lot) % 29 <> 0 THEN l_extendedprice END AS item_current_bid,
    CASE WHEN (l_orderkey * 100 + lot) % 31 <> 0 THEN CAST(l_shipdate AS TIMESTAMP) END AS item_closes,
    (l_orderkey * 100 + lot) % 6 AS item_number_of_images,
    (l_orderkey * 100 + lot) % 4 = 0 AS item_bidding_extended,
    (l_orderkey * 100 + lot) % 5 AS item_bid_count,
    l_suppkey AS item_seller_id
  FROM lots LEFT JOIN part ON l_partkey = p_partkey)
"""

ENRICHED_ITEMS = ITEMS + """,
enriched_items AS (
  SELECT item_id, auction_id, 'The ' || item_title AS enriched_item_title,
    item_description AS enriched_item_description,
    CASE WHEN item_id % 8 < 4 THEN 'used, works' END AS enriched_item_qualitativeDescription,
    CASE item_id % 8 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN 'nan' WHEN 3 THEN 'None'
      ELSE 'Brand ' || (item_id % 8) END AS enriched_item_brand,
    CASE WHEN item_id % 3 = 0 THEN 'Series 1' END AS enriched_item_seriesLine,
    CASE item_id % 8 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN 'unknown' WHEN 3 THEN 'Like New'
      WHEN 4 THEN 'Good/Fair' ELSE 'Excellent' END AS enriched_item_condition,
    CASE WHEN item_id % 8 < 3 THEN 'Yes' WHEN item_id % 8 < 6 THEN 'Not-Tested' END AS enriched_item_working
  FROM items)
"""


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(c.strip().rstrip(",") for c in ctes) + "\n"
