"""Item-grain queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from gavelworks.functions import jsons, money, text
from gavelworks.operators import items as ops
from gavelworks.operators.checks import with_invalid_numbers, with_item_errors
from gavelworks.operators.encode import add_label_codes, fit_item_encoder
from gavelworks.operators.joins import merge
from gavelworks.sources import bindings
from registry.common import ENRICHED_ITEMS, ITEMS, query, r, rounded, with_

KEY = "item_id"


def joined(spark, folder):
    return merge(bindings.items(spark, folder), bindings.enriched_items(spark, folder), [KEY, "auction_id"], "inner")


# -------------------------------------------------------------- text lengths

LENGTHS = """
  length(coalesce(item_title, '')) AS item_title_length,
  length(coalesce(item_description, '')) AS item_description_length,
  length(coalesce(enriched_item_title, '')) AS item_enriched_title_length,
  length(coalesce(enriched_item_description, '')) AS item_enriched_description_length,
  length(coalesce(enriched_item_qualitativeDescription, '')) AS item_enriched_qualitative_description_length"""
PRESENT = """
  CAST(coalesce(enriched_item_brand NOT IN ('', 'nan', 'None'), FALSE) AS BIGINT) AS item_has_brand,
  CAST(enriched_item_seriesLine IS NOT NULL AS BIGINT) AS item_has_series_line"""
BOTH = "items JOIN enriched_items e USING (item_id, auction_id)"


@query("item_text_lengths_and_flags", with_(ENRICHED_ITEMS) + f"SELECT item_id, {LENGTHS}, {PRESENT} FROM {BOTH}")
def item_text_lengths_and_flags(spark, folder):
    out = text.add_presence_flags(text.add_text_lengths(joined(spark, folder)))
    names = [*text.TEXT_LENGTHS.values(), *text.PRESENCE_FLAGS.values()]
    return rounded(out.select(KEY, *names), KEY)


# --------------------------------------------------------------- list counts

# Worked out by hand from the eight states the JSON texts come in.
COUNTS = """
  CAST(CASE item_id % 8 WHEN 0 THEN 0 WHEN 1 THEN 2 WHEN 2 THEN 1 WHEN 3 THEN 1 WHEN 4 THEN 0 WHEN 5 THEN 0
    WHEN 6 THEN 1 ELSE 0 END AS BIGINT) AS item_brands_count,
  CAST(CASE WHEN item_id % 8 < 5 THEN 3 ELSE 1 END AS BIGINT) AS item_categories_count,
  CAST(CASE WHEN item_id % 8 < 4 THEN 0 ELSE 2 END AS BIGINT) AS item_items_count,
  CAST(CASE item_id % 8 WHEN 3 THEN 0 WHEN 4 THEN 0 WHEN 5 THEN 4 WHEN 6 THEN 1 WHEN 7 THEN 0 ELSE 3 END AS BIGINT)
    AS item_attributes_count"""


@query("item_list_counts", with_(ENRICHED_ITEMS) + f"SELECT item_id, {COUNTS} FROM enriched_items")
def item_list_counts(spark, folder):
    out = jsons.add_list_counts(bindings.enriched_items(spark, folder))
    return rounded(out.select(KEY, *[name for name, _ in jsons.LIST_COUNTS.values()]), KEY)


# ----------------------------------------------------- closing order, prices

CLOSING = """CAST(CASE WHEN item_closes IS NULL THEN 0 ELSE dense_rank() OVER
  (PARTITION BY auction_id ORDER BY item_closes NULLS LAST) END AS BIGINT) AS item_closing_order"""


@query("item_closing_order", with_(ITEMS) + f"SELECT item_id, {CLOSING} FROM items")
def item_closing_order(spark, folder):
    df = bindings.items(spark, folder).select(KEY, "auction_id", "item_closes")
    return rounded(ops.add_closing_order(df).select(KEY, "item_closing_order"), KEY)


SUPPLIER_CLOSING = """SELECT item_id, CAST(CASE WHEN item_closes IS NULL THEN 0 ELSE dense_rank() OVER
  (PARTITION BY item_seller_id % 3 ORDER BY item_closes NULLS LAST) END AS BIGINT) AS item_closing_order FROM items"""


@query("item_closing_order_in_huge_auctions", with_(ITEMS) + SUPPLIER_CLOSING)
def item_closing_order_in_huge_auctions(spark, folder):
    """Three auctions hold everything; a small limit sends them through the distributed ranking."""
    df = bindings.items(spark, folder).select(KEY, (F.col("item_seller_id") % 3).alias("auction_id"), "item_closes")
    return rounded(ops.add_closing_order(df, limit=5000).select(KEY, "item_closing_order"), KEY)


PRICES = f"""{r("item_current_bid", "item_winning_price_raw")},
  {r("ln(1 + greatest(coalesce(item_current_bid, 0), 0))", "item_winning_price_log1p")}"""


@query("item_prices", with_(ITEMS) + f"SELECT item_id, {PRICES} FROM items")
def item_prices(spark, folder):
    out = money.add_item_prices(bindings.items(spark, folder))
    return rounded(out.select(KEY, "item_winning_price_raw", "item_winning_price_log1p"), KEY)


# ---------------------------------------------------------------- categories

_CONDITION = "CASE WHEN coalesce(enriched_item_condition, '') IN ('', 'unknown') THEN 'Unknown' ELSE enriched_item_condition END"
_WORKING = "coalesce(enriched_item_working, 'Unknown')"
ONE_HOT = ",\n".join(
    f"CAST({c} = '{level}' AS BIGINT) AS {name}"
    for c, level, name in (
        (_CONDITION, "Excellent", "item_condition_excellent"),
        (_CONDITION, "Good/Fair", "item_condition_good_fair"),
        (_CONDITION, "Like New", "item_condition_like_new"),
        (_CONDITION, "Unknown", "item_condition_unknown"),
        (_WORKING, "Not-Tested", "item_working_not_tested"),
        (_WORKING, "Unknown", "item_working_unknown"),
        (_WORKING, "Yes", "item_working_yes"),
    )
)


@query("item_categories", with_(ENRICHED_ITEMS) + f"SELECT item_id, {ONE_HOT} FROM enriched_items")
def item_categories(spark, folder):
    df = bindings.enriched_items(spark, folder).select(KEY, "enriched_item_condition", "enriched_item_working")
    out = fit_item_encoder(df).transform(df)
    return rounded(out.select(*[c for c in out.columns if c.startswith("item_")]), KEY)


@query(
    "item_features",
    with_(ENRICHED_ITEMS)
    + f"""SELECT item_id, auction_id, item_lot_number, CAST(item_number_of_images AS BIGINT) AS item_number_of_images,
  CAST(item_bidding_extended AS BIGINT) AS item_bidding_extended, item_bid_count, item_seller_id,
  epoch_us(item_closes) AS item_end_time, {LENGTHS}, {PRESENT}, {COUNTS}, {CLOSING}, {PRICES}, {ONE_HOT} FROM {BOTH}""",
)
def item_features(spark, folder):
    out = ops.engineer_item_features(bindings.items(spark, folder), bindings.enriched_items(spark, folder))
    return rounded(out, KEY, "auction_id")


# ------------------------------------------------------------ smaller pieces


@query(
    "item_lot_share",
    with_(ITEMS)
    + f"SELECT item_id, {r('item_lot_number / max(item_lot_number) OVER (PARTITION BY auction_id)', 'lot_number_normalized')} FROM items",
)
def item_lot_share(spark, folder):
    df = bindings.items(spark, folder).select(KEY, "auction_id", F.col("item_lot_number").alias("lot_number"))
    return rounded(ops.add_lot_share(df).select(KEY, "lot_number_normalized"), KEY)


@query(
    "item_label_codes",
    """SELECT p_partkey, CAST(dense_rank() OVER (ORDER BY p_type) - 1 AS BIGINT) AS category_encoded,
       CAST(dense_rank() OVER (ORDER BY p_brand) - 1 AS BIGINT) AS subcategory_encoded FROM part""",
)
def item_label_codes(spark, folder):
    part = bindings.table(spark, folder, "part").select("p_partkey", "p_type", "p_brand")
    out = add_label_codes(part, {"p_type": "category_encoded", "p_brand": "subcategory_encoded"})
    return out.select("p_partkey", "category_encoded", "subcategory_encoded")


def sale_rows(spark, folder):
    """Items under the names of the stored item table."""
    return bindings.items(spark, folder).select(
        KEY,
        "auction_id",
        F.col("item_title").alias("title"),
        F.when(F.col(KEY) % 6 == 0, 0.0).when(F.col(KEY) % 37 == 0, -1.0).otherwise(F.col("item_current_bid")).alias("winning_bid"),
        F.col("item_bid_count").alias("bid_count"),
        (F.col(KEY) % 3).alias("recorded_bids"),
    )


SALES = """sales AS (SELECT item_id, auction_id, item_title AS title,
  CASE WHEN item_id % 6 = 0 THEN 0.0 WHEN item_id % 37 = 0 THEN -1.0 ELSE item_current_bid END AS winning_bid,
  item_bid_count AS bid_count, item_id % 3 AS recorded_bids FROM items)"""


@query(
    "item_sale_flags",
    with_(ITEMS, SALES)
    + """SELECT item_id, CAST(bid_count > 0 AS BIGINT) AS has_bids, CAST(coalesce(winning_bid > 0, FALSE) AS BIGINT) AS is_sold,
       CAST(bid_count = 0 OR coalesce(winning_bid = 0, FALSE) AS BIGINT) AS is_no_bid FROM sales""",
)
def item_sale_flags(spark, folder):
    return rounded(ops.with_sale_flags(sale_rows(spark, folder)).select(KEY, "has_bids", "is_sold", "is_no_bid"), KEY)


@query(
    "item_targets",
    with_(ITEMS, SALES)
    + f"""SELECT 'include' AS handling, item_id, {r("winning_bid", "target")}, NULL::BIGINT AS is_zero_bid FROM sales UNION ALL
      SELECT 'exclude', item_id, {r("winning_bid", "target")}, NULL FROM sales WHERE winning_bid > 0 UNION ALL
      SELECT 'separate', item_id, {r("winning_bid", "target")}, CAST(coalesce(winning_bid = 0, FALSE) AS BIGINT) FROM sales""",
)
def item_targets(spark, folder):
    sales = sale_rows(spark, folder).select(KEY, F.col("winning_bid").alias("target"))
    parts = []
    for handling in ("include", "exclude", "separate"):
        out = ops.prepare_target(sales, "target", handling)
        marked = F.col("is_zero_bid") if handling == "separate" else F.lit(None)
        parts.append(out.select(F.lit(handling).alias("handling"), KEY, "target", marked.cast("int").alias("is_zero_bid")))
    return rounded(parts[0].unionByName(parts[1]).unionByName(parts[2]), "handling", KEY)


@query(
    "item_errors",
    with_(ITEMS, SALES)
    + """SELECT item_id, concat_ws('|', CASE WHEN coalesce(title, '') = '' THEN 'Missing title' END,
      CASE WHEN winning_bid < 0 THEN 'Negative winning bid' END,
      CASE WHEN bid_count > 0 AND recorded_bids = 0 THEN 'Bid count mismatch' END) AS errors FROM sales""",
)
def item_errors(spark, folder):
    out = with_item_errors(sale_rows(spark, folder))
    return out.select(KEY, F.concat_ws("|", "errors").alias("errors"))


@query(
    "invalid_numbers",
    """SELECT event_id, concat_ws('|', CASE WHEN event_id % 5 = 1 THEN 'item_count' END,
      CASE WHEN event_id % 3 = 1 THEN 'total_viewed' END) AS invalid_fields FROM events""",
)
def invalid_numbers(spark, folder):
    k = F.col("event_id")
    events = bindings.table(spark, folder, "events").select(
        k,
        F.when(k % 5 == 0, "12").when(k % 5 == 1, "twelve").when(k % 5 == 2, "1.5e3").alias("item_count"),
        F.when(k % 3 == 0, F.col("value").cast("string")).when(k % 3 == 1, "n/a").alias("total_viewed"),
        F.col("value").alias("total_images"),
    )
    return with_invalid_numbers(events).select("event_id", F.concat_ws("|", "invalid_fields").alias("invalid_fields"))


@query(
    "excellent_items",
    with_(ENRICHED_ITEMS)
    + """SELECT item_id, enriched_item_brand FROM enriched_items
      WHERE enriched_item_brand IS NOT NULL AND enriched_item_condition LIKE '%Excellent%'""",
)
def excellent_items(spark, folder):
    df = bindings.enriched_items(spark, folder)
    known = df.filter(F.col("enriched_item_brand").isNotNull() & F.col("enriched_item_condition").contains("Excellent"))
    return known.select(KEY, "enriched_item_brand")


@query(
    "item_word_counts",
    with_(ITEMS)
    + f"""SELECT item_id, len(list_filter(regexp_split_to_array(coalesce(item_description, ''), '\\s+'), lambda x: x <> ''))
      AS description_word_count, CAST(item_description IS NOT NULL AS BIGINT) AS has_dimensions,
      {r("(item_current_bid + item_current_bid * 2) / 2", "estimated_value_mid")},
      coalesce(item_title, '') || ' [SEP] ' || coalesce(item_description, '') AS combined_text FROM items""",
)
def item_word_counts(spark, folder):
    items = bindings.items(spark, folder)
    low, high = F.col("item_current_bid"), F.col("item_current_bid") * 2
    return rounded(
        items.select(
            KEY,
            text.word_count(F.col("item_description")).alias("description_word_count"),
            F.col("item_description").isNotNull().alias("has_dimensions"),
            ((low + high) / 2).alias("estimated_value_mid"),
            text.combined_text(F.col("item_title"), F.col("item_description")).alias("combined_text"),
        ),
        KEY,
    )
