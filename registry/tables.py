"""Reads, joins, aggregates, limits and unions."""

from __future__ import annotations

from pyspark.sql import functions as F


from gavelworks.operators import joins, summaries
from gavelworks.operators.auctions import is_completed, roll_up_items
from gavelworks.operators.bids import engineer_bid_features
from gavelworks.plans.pipelines import combine_pipeline, combined_table, resume_combine
from gavelworks.schemas import AUCTIONS as AUCTION_NAMES
from gavelworks.schemas import BIDS as BID_NAMES
from gavelworks.schemas import ENRICHED_AUCTIONS as ENRICHED_AUCTION_NAMES
from gavelworks.schemas import ENRICHED_ITEMS as ENRICHED_ITEM_NAMES
from gavelworks.schemas import ITEMS as ITEM_NAMES
from gavelworks.session import shared_dir
from gavelworks.sources import bindings, tables
from registry.auctions import END_US, START_US, bids_with_schedule
from registry.common import AUCTIONS, BIDS, ENRICHED_ITEMS, ITEMS, query, r, rounded, with_
from registry.items import SALES, sale_rows

# ------------------------------------------------------------------- readers


@query("table_row_counts", " UNION ALL ".join(
    f"SELECT '{t}' AS name, count(*) AS rows FROM {t}" for t in ("orders", "lineitem", "events", "part")
))
def table_row_counts(spark, folder):
    counted = [
        tables.row_count(spark, f"{folder}/{t}.parquet").select(F.lit(t).alias("name"), "rows")
        for t in ("orders", "lineitem", "events", "part")
    ]
    return tables.union_all(counted)


@query(
    "read_completed_auctions",
    with_(AUCTIONS) + "SELECT auction_id, auction_title FROM auctions WHERE auction_status = 'completed'",
)
def read_completed_auctions(spark, folder):
    df = bindings.auctions(spark, folder).withColumnRenamed("auction_status", "status")
    return tables.read_auctions(df).select("auction_id", "auction_title")


@query(
    "read_first_auctions",
    with_(AUCTIONS) + "SELECT auction_id, auction_status AS status FROM auctions ORDER BY auction_id LIMIT 25",
)
def read_first_auctions(spark, folder):
    df = bindings.auctions(spark, folder).select("auction_id", F.col("auction_status").alias("status"))
    return tables.read_auctions(df, completed_only=False, limit=25)


@query("read_items_of_auction", with_(ITEMS) + f"SELECT item_id, {r('item_current_bid', 'price')} FROM items WHERE auction_id = 0")
def read_items_of_auction(spark, folder):
    out = tables.read_items(bindings.items(spark, folder), auction_id=0)
    return rounded(out.select("item_id", F.col("item_current_bid").alias("price")), "item_id")


@query(
    "read_bids_of_item",
    with_(BIDS) + f"SELECT bid_id, {r('bid_amount', 'bid_amount')} FROM bids WHERE item_id = 0 ORDER BY u, bid_id LIMIT 20",
)
def read_bids_of_item(spark, folder):
    out = tables.read_bids(bindings.bids(spark, folder), item_id=0, limit=20)
    return rounded(out.select("bid_id", "bid_amount"), "bid_id")


@query(
    "read_earliest_bids",
    with_(BIDS) + "SELECT bid_id, u AS bid_us FROM bids ORDER BY u, bid_id LIMIT 50",
)
def read_earliest_bids(spark, folder):
    out = tables.read_bids(bindings.bids(spark, folder), limit=50)
    return out.select("bid_id", F.unix_micros("bid_time").alias("bid_us"))


@query(
    "bids_second_page",
    with_(BIDS) + "SELECT bid_id, u AS bid_us FROM bids ORDER BY u, bid_id LIMIT 50 OFFSET 50",
)
def bids_second_page(spark, folder):
    out = tables.read_bids(bindings.bids(spark, folder)).offset(50).limit(50)
    return out.select("bid_id", F.unix_micros("bid_time").alias("bid_us"))


@query("distinct_auction_ids", "SELECT DISTINCT l_orderkey AS auction_id FROM lineitem")
def distinct_auction_ids(spark, folder):
    source = bindings.table(spark, folder, "lineitem").withColumnRenamed("l_orderkey", "amAuctionId")
    return tables.read_ids(source)


@query("first_item_ids", "SELECT DISTINCT user_id AS item_id FROM events ORDER BY 1 LIMIT 30")
def first_item_ids(spark, folder):
    source = bindings.table(spark, folder, "events").withColumnRenamed("user_id", "id")
    return tables.read_ids(source, ("item_id", "amLotId", "id"), limit=30)


@query("distinct_pairs", "SELECT DISTINCT user_id % 10 AS auction_id, user_id AS item_id FROM events")
def distinct_pairs(spark, folder):
    return tables.read_pairs(bindings.bids(spark, folder))


@query(
    "parameterised_sql",
    f"SELECT l_returnflag, count(*) AS n, {r('sum(l_quantity)', 'quantity')} FROM lineitem WHERE l_quantity >= 30 GROUP BY 1",
)
def parameterised_sql(spark, folder):
    bindings.use_utc(spark)
    known = tables.Tables(spark, {"lineitem": f"{folder}/lineitem.parquet"})
    known.register()
    out = known.sql(
        "SELECT l_returnflag, count(*) AS n, sum(l_quantity) AS quantity FROM lineitem "
        "WHERE l_quantity >= :least GROUP BY l_returnflag",
        {"least": 30},
    )
    return rounded(out, "l_returnflag")


# ------------------------------------------------------------------- writers


def fresh(spark, name):
    import uuid

    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query(
    "append_then_compact",
    f"""SELECT CAST(month(o_orderdate) AS BIGINT) AS month, count(*) * 2 AS n, {r('sum(o_totalprice) * 2', 'price', 2)}
        FROM orders GROUP BY 1""",
)
def append_then_compact(spark, folder):
    """Two appends make many files; compaction rewrites them as few."""
    small, large = fresh(spark, "batches"), fresh(spark, "compacted")
    orders = bindings.table(spark, folder, "orders").withColumn("month", F.month("o_orderdate"))
    tables.write_parquet(orders, small)
    tables.append_parquet(orders, small)
    tables.compact(spark, small, large)
    out = tables.read_parquet(spark, large).groupBy("month")
    return rounded(out.agg(F.count("*").alias("n"), F.sum("o_totalprice").alias("price")), "month", digits=2)


@query("write_query_result", "SELECT o_orderstatus AS status, count(*) AS n FROM orders WHERE o_totalprice > 100000 GROUP BY 1")
def write_query_result(spark, folder):
    path = fresh(spark, "query")
    bindings.table(spark, folder, "orders").createOrReplaceTempView("orders")
    tables.write_query(spark, "SELECT * FROM orders WHERE o_totalprice > :floor", path, {"floor": 100000})
    return tables.read_parquet(spark, path, files="part-*").groupBy(F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("n"))


@query(
    "dataset_description",
    "SELECT 'part' AS name, count(*) AS rows, 'p_partkey,p_name,p_brand,p_type,p_size,p_retailprice' AS columns, "
    "'auction,items' AS tags, '2026-01-01' AS created_at FROM part",
)
def dataset_description(spark, folder):
    out = tables.describe_dataset(bindings.table(spark, folder, "part"), "part", "2026-01-01", ["auction", "items"])
    return out.withColumns({c: F.concat_ws(",", c) for c in ("columns", "tags")})


@query(
    "csv_roundtrip",
    "SELECT upper(substr(c_mktsegment, 1, 3)) AS FSA, count(*) AS returns, sum(c_custkey) AS income FROM customer GROUP BY 1",
)
def csv_roundtrip(spark, folder):
    """Tax-shaped CSV with padded headers, written and read under the fixed schema."""
    from gavelworks.sources.areas import TAX_SCHEMA, clean_tax, read_csv

    path = fresh(spark, "tax")
    people = bindings.table(spark, folder, "customer")
    rows = people.groupBy(F.lower(F.substring("c_mktsegment", 1, 3)).alias("FSA ")).agg(
        F.count("*").alias("Total"),
        F.sum("c_custkey").alias("Total income"),
        F.lit(1).alias("Net income"),
        F.lit(1).alias("Taxable income"),
    )
    total = people.agg(
        F.lit("TOTAL").alias("FSA "),
        F.count("*").alias("Total"),
        F.sum("c_custkey").alias("Total income"),
        F.lit(1).alias("Net income"),
        F.lit(1).alias("Taxable income"),
    )
    rows.unionByName(total).write.csv(path, header=True)
    out = clean_tax(read_csv(spark, path, TAX_SCHEMA))
    return out.select("FSA", F.col("Number of Returns").alias("returns"), F.col("Total Income").alias("income"))


# ----------------------------------------------------------- renames, unions


@query(
    "column_names",
    """SELECT * FROM (VALUES
  ('auctions', 'auction_id,auction_title,auction_item_count,auction_winning_price'),
  ('items', 'item_id,auction_id,item_title'),
  ('bids', 'auction_id,item_id,bid_time,bid_amount,bid_is_proxy,bid_id,bid_count'),
  ('enriched_auctions', 'auction_id,enriched_auction_type,enriched_auction_approxLocation_city'),
  ('enriched_items', 'item_id,auction_id,enriched_item_title')) t(table_name, columns)
  WHERE (SELECT count(*) FROM orders) > 0""",
)
def column_names(spark, folder):
    """Rename-then-prefix of every landed table, applied to projections of the orders."""
    orders = bindings.table(spark, folder, "orders")
    landed = {
        "auctions": (AUCTION_NAMES, ["id", "title", "catalog_lots", "current_bid"]),
        "items": (ITEM_NAMES, ["id", "auction_id", "title"]),
        "bids": (BID_NAMES, ["auction_id", "item_id", "time_of_bid", "amount", "isproxy", "id", "count"]),
        "enriched_auctions": (ENRICHED_AUCTION_NAMES, ["amAuctionId", "type", "approxLocation_city"]),
        "enriched_items": (ENRICHED_ITEM_NAMES, ["amLotId", "amAuctionId", "title"]),
    }
    out = []
    for name, (naming, fields) in landed.items():
        renamed = naming.apply(orders.select(*[F.col("o_orderkey").alias(f) for f in fields]))
        out.append(
            renamed.agg(F.count("*").alias("n"))
            .filter("n > 0")
            .select(F.lit(name).alias("table_name"), F.lit(",".join(renamed.columns)).alias("columns"))
        )
    return tables.union_all(out)


@query(
    "union_with_missing_columns",
    """SELECT o_orderkey AS id, o_orderstatus AS status, NULL AS segment FROM orders UNION ALL
       SELECT c_custkey, NULL, c_mktsegment FROM customer""",
)
def union_with_missing_columns(spark, folder):
    orders = bindings.table(spark, folder, "orders")
    people = bindings.table(spark, folder, "customer")
    return tables.union_all(
        [
            orders.select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status")),
            people.select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("segment")),
        ]
    )


# --------------------------------------------------------------------- joins


def moved(key: str, modulus: int, rest: int):
    """``key``, negative where it leaves ``rest``: rows that find no match, without dropping any."""
    return F.when(F.col(key) % modulus == rest, -1 - F.col(key)).otherwise(F.col(key)).alias(key)


AUCTION_ITEMS = """
merged AS (SELECT coalesce(a.auction_id, i.auction_id) AS auction_id, auction_title, auction_item_count, a.price AS price_auction,
    item_id, item_title, i.price AS price_item
  FROM (SELECT CASE WHEN auction_id % 7 = 3 THEN -1 - auction_id ELSE auction_id END AS auction_id, auction_title,
          auction_item_count, auction_total_winning_price AS price FROM auctions) a
  FULL JOIN (SELECT item_id, auction_id, item_title, item_current_bid AS price FROM items) i ON a.auction_id = i.auction_id)
"""


def auction_side(spark, folder):
    """All auctions, some under a number that no item has."""
    return bindings.auctions(spark, folder).select(
        moved("auction_id", 7, 3), "auction_title", "auction_item_count", F.col("auction_total_winning_price").alias("price")
    )


def item_side(spark, folder):
    return bindings.items(spark, folder).select(
        "item_id", "auction_id", "item_title", F.col("item_current_bid").alias("price")
    )


@query(
    "auctions_full_outer_items",
    with_(AUCTIONS, ITEMS, AUCTION_ITEMS)
    + f"SELECT auction_id, item_id, auction_title, item_title, {r('price_auction', 'price_auction')}, {r('price_item', 'price_item')} FROM merged",
)
def auctions_full_outer_items(spark, folder):
    out = joins.merge_auctions_items(auction_side(spark, folder), item_side(spark, folder))
    return rounded(out.drop("auction_item_count"), "auction_id", "item_id")


@query(
    "auctions_full_outer_items_salted",
    with_(AUCTIONS, ITEMS, AUCTION_ITEMS)
    + f"SELECT auction_id, item_id, auction_title, {r('price_auction', 'price_auction')}, {r('price_item', 'price_item')} FROM merged",
)
def auctions_full_outer_items_salted(spark, folder):
    """The same merge with a limit so low that the longer auctions are salted."""
    out = joins.merge_auctions_items(auction_side(spark, folder), item_side(spark, folder), limit=6)
    return rounded(out.drop("auction_item_count", "item_title"), "auction_id", "item_id")


# Bids on the first three items of the order with the bidder's number.
PLACED = "placed AS (SELECT bid_id, item_id AS auction_id, item_id * 100 + 1 + bid_id % 3 AS item_id, u, bid_amount AS price FROM bids)"


def placed_bids(spark, folder):
    return bindings.bids(spark, folder).select(
        "bid_id",
        F.col("item_id").alias("auction_id"),
        (F.col("item_id") * 100 + 1 + F.col("bid_id") % 3).alias("item_id"),
        "bid_time",
        F.col("bid_amount").alias("price_item"),
    )


COMBINED = f"""SELECT coalesce(p.auction_id, m.auction_id) AS auction_id, coalesce(p.item_id, m.item_id) AS item_id, bid_id, u AS bid_time,
  auction_title, auction_item_count, item_title, {r("p.price", "price_item_bid")}, {r("price_auction", "price_auction")},
  {r("m.price_item", "price_item")}
FROM placed p %s JOIN merged m ON p.auction_id = m.auction_id AND p.item_id = m.item_id"""


@query("combined_training_table", with_(BIDS, PLACED, AUCTIONS, ITEMS, AUCTION_ITEMS) + COMBINED % "LEFT")
def combined_training_table(spark, folder):
    out = combined_table(auction_side(spark, folder), item_side(spark, folder), placed_bids(spark, folder))
    return rounded(out, "auction_id", "item_id")


@query("resume_combined_table", with_(BIDS, PLACED, AUCTIONS, ITEMS, AUCTION_ITEMS) + COMBINED % "LEFT")
def resume_combined_table(spark, folder):
    """The table written with half of every item's bids, then resumed with all of them."""
    bids = placed_bids(spark, folder)
    parts = {
        "auctions": auction_side(spark, folder),
        "items": item_side(spark, folder),
        "bids": bids,
        "some": bids.filter("bid_id % 2 = 0"),
    }
    paths = {name: fresh(spark, name) for name in [*parts, "out"]}
    for name, part in parts.items():
        part.write.parquet(paths[name])
    combine_pipeline(spark, paths["auctions"], paths["items"], paths["some"], paths["out"])
    resume_combine(spark, paths["auctions"], paths["items"], paths["bids"], paths["out"])
    return rounded(tables.read_parquet(spark, paths["out"]), "auction_id", "item_id")


@query("combined_training_table_full", with_(BIDS, PLACED, AUCTIONS, ITEMS, AUCTION_ITEMS) + COMBINED % "FULL")
def combined_training_table_full(spark, folder):
    out = combined_table(auction_side(spark, folder), item_side(spark, folder), placed_bids(spark, folder), "full")
    return rounded(out, "auction_id", "item_id")


@query(
    "combined_training_table_resume_suffixes",
    with_(BIDS, PLACED, AUCTIONS, ITEMS)
    + f"""SELECT p.auction_id, p.item_id, bid_id, u AS bid_time, {r("p.price", "price")}, {r("i.item_current_bid", "price_item")}
      FROM placed p LEFT JOIN items i ON p.auction_id = i.auction_id AND p.item_id = i.item_id""",
)
def combined_training_table_resume_suffixes(spark, folder):
    bids = placed_bids(spark, folder).withColumnRenamed("price_item", "price")
    items = item_side(spark, folder).drop("item_title")
    return rounded(joins.merge_bids(bids, items, suffixes=("", "_item")), "auction_id", "item_id")


@query(
    "items_left_enriched",
    with_(ENRICHED_ITEMS)
    + """SELECT i.item_id, i.item_title, e.enriched_item_title, e.note AS note_enriched, i.note FROM
      (SELECT *, item_id % 2 AS note FROM items) i LEFT JOIN (SELECT *, item_id % 5 AS note FROM enriched_items) e
      ON i.item_id = e.item_id AND e.item_id % 4 <> 0 AND i.auction_id = e.auction_id""",
)
def items_left_enriched(spark, folder):
    items = bindings.items(spark, folder).withColumn("note", F.col("item_id") % 2)
    enriched = bindings.enriched_items(spark, folder).withColumn("note", F.col("item_id") % 5)
    enriched = enriched.withColumn("item_id", moved("item_id", 4, 0))
    out = joins.merge(items, enriched, ["item_id", "auction_id"], "left", ("", "_enriched"))
    return out.select("item_id", "item_title", "enriched_item_title", "note_enriched", "note")


@query(
    "pending_pairs",
    """SELECT DISTINCT user_id % 10 AS auction_id, user_id AS item_id FROM events e
       WHERE NOT EXISTS (SELECT 1 FROM events d WHERE d.user_id = e.user_id AND d.value > 150)""",
)
def pending_pairs(spark, folder):
    bids = bindings.bids(spark, folder)
    done = bids.filter("bid_amount > 150")
    return joins.not_done(tables.read_pairs(bids), done, ["auction_id", "item_id"])


@query(
    "failed_auctions",
    "SELECT o_orderkey AS auction_id FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)",
)
def failed_auctions(spark, folder):
    """Requested but not fetched."""
    requested = bindings.table(spark, folder, "orders").select(F.col("o_orderkey").alias("auction_id"))
    fetched = bindings.table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("auction_id"))
    return joins.not_done(requested, fetched, ["auction_id"])


@query(
    "bids_of_open_auctions",
    with_(BIDS, AUCTIONS)
    + "SELECT bid_id, auction_id FROM bids WHERE auction_id IN (SELECT auction_id FROM auctions WHERE auction_status = 'open')",
)
def bids_of_open_auctions(spark, folder):
    """The bids of a batch of auctions: a semi-join, whatever the size of the batch."""
    batch = bindings.auctions(spark, folder).filter("auction_status = 'open'").select("auction_id")
    return bindings.bids(spark, folder).join(batch, "auction_id", "left_semi").select("bid_id", "auction_id")


@query(
    "bid_timing_from_auctions",
    with_(BIDS, AUCTIONS, "moved AS (SELECT bid_id, user_id AS auction_id, ts + INTERVAL '-10000 days' AS t FROM bids JOIN events ON bid_id = event_id)")
    + f"""SELECT bid_id, {r("(epoch_us(t) - epoch_us(auction_starts)) / 1e6", "bid_timing_seconds_since_start")},
      {r("(epoch_us(auction_ends) - epoch_us(t)) / 1e6", "bid_timing_seconds_until_end")},
      {r("(epoch_us(t) - epoch_us(auction_starts)) / nullif(epoch_us(auction_ends) - epoch_us(auction_starts), 0)", "bid_timing_pct_through_auction", 4)}
      FROM moved LEFT JOIN auctions USING (auction_id)""",
)
def bid_timing_from_auctions(spark, folder):
    from gavelworks.functions.times import add_bid_timing

    events = bindings.table(spark, folder, "events").select(
        F.col("event_id").alias("bid_id"),
        F.col("user_id").alias("auction_id"),
        (F.col("ts").cast("timestamp") - F.expr("interval 10000 days")).alias("bid_time"),
    )
    out = add_bid_timing(joins.with_auction_times(events, bindings.auctions(spark, folder)))
    share = "bid_timing_pct_through_auction"
    out = out.select("bid_id", "bid_timing_seconds_since_start", "bid_timing_seconds_until_end", share)
    return rounded(out.drop(share), "bid_id").join(rounded(out.select("bid_id", share), "bid_id", digits=4), "bid_id")


@query(
    "prices_filled_with_median",
    with_(ITEMS)
    + f"SELECT item_id, {r('coalesce(item_current_bid, (SELECT median(item_current_bid) FROM items))', 'price')} FROM items",
)
def prices_filled_with_median(spark, folder):
    prices = bindings.items(spark, folder).select("item_id", F.col("item_current_bid").alias("price"))
    return rounded(summaries.fill_with_medians(prices, ["price"]), "item_id")


@query(
    "latest_statuses",
    "SELECT user_id AS item_id, arg_max(event_type, event_id) AS status FROM events GROUP BY 1",
)
def latest_statuses(spark, folder):
    log = bindings.table(spark, folder, "events").select(
        F.col("user_id").alias("item_id"), F.col("event_id").alias("at"), F.col("event_type").alias("status")
    )
    return joins.latest_status(log, ["item_id"])


VIEW_TABLES = """
base_auctions AS (SELECT auction_id, auction_title AS title, 'Ottawa' AS location_city, auction_status AS auction_type,
  auction_last_item_closes AS actual_end_time FROM auctions WHERE auction_id % 5 <> 4),
item_enriched AS (SELECT item_id, item_current_bid AS estimated_value_low, item_current_bid * 2 AS estimated_value_high,
  item_bid_count AS condition_score, item_seller_id AS popularity_score FROM items WHERE item_id % 3 <> 0),
features_tabular AS (SELECT item_id, item_lot_number AS category_avg_price, item_bid_count AS category_median_price
  FROM items WHERE item_id % 4 <> 0),
features_sequential AS (SELECT item_id, item_bid_count AS bid_count, item_bid_count % 3 AS unique_bidders,
  item_bid_count % 2 AS soft_close_extensions FROM items WHERE item_id % 5 <> 0),
stored AS (SELECT item_id, auction_id, title, winning_bid, CAST(bid_count > 0 AS BIGINT) AS has_bids,
  CAST(coalesce(winning_bid > 0, FALSE) AS BIGINT) AS is_sold FROM sales)
"""


def views(spark, folder):
    from gavelworks.operators.items import with_sale_flags

    auctions = bindings.auctions(spark, folder).withColumn("auction_id", moved("auction_id", 5, 4))
    items = bindings.items(spark, folder)
    joins.register_views(
        {
            "items": with_sale_flags(sale_rows(spark, folder)).select(
                "item_id", "auction_id", "title", "winning_bid", "has_bids", "is_sold"
            ),
            "auctions": auctions.select(
                "auction_id",
                F.col("auction_title").alias("title"),
                F.lit("Ottawa").alias("location_city"),
                F.col("auction_status").alias("auction_type"),
                F.col("auction_last_item_closes").alias("actual_end_time"),
            ),
            "item_enriched": items.select(
                moved("item_id", 3, 0),
                F.col("item_current_bid").alias("estimated_value_low"),
                (F.col("item_current_bid") * 2).alias("estimated_value_high"),
                F.col("item_bid_count").alias("condition_score"),
                F.col("item_seller_id").alias("popularity_score"),
            ),
            "features_tabular": items.select(
                moved("item_id", 4, 0),
                F.col("item_lot_number").alias("category_avg_price"),
                F.col("item_bid_count").alias("category_median_price"),
            ),
            "features_sequential": items.select(
                moved("item_id", 5, 0),
                F.col("item_bid_count").alias("bid_count"),
                (F.col("item_bid_count") % 3).alias("unique_bidders"),
                (F.col("item_bid_count") % 2).alias("soft_close_extensions"),
            ),
        }
    )


@query(
    "view_items_full",
    with_(AUCTIONS, ITEMS, SALES, VIEW_TABLES)
    + f"""SELECT i.item_id, i.auction_id, i.title, {r("winning_bid", "winning_bid")}, has_bids, is_sold, a.title AS auction_title,
  location_city, auction_type, epoch_us(actual_end_time) AS auction_end_time, {r("estimated_value_low", "estimated_value_low")},
  {r("estimated_value_high", "estimated_value_high")}, condition_score, popularity_score, category_avg_price, category_median_price
  FROM stored i LEFT JOIN base_auctions a USING (auction_id) LEFT JOIN item_enriched USING (item_id)
  LEFT JOIN features_tabular USING (item_id)""",
)
def view_items_full(spark, folder):
    views(spark, folder)
    return rounded(spark.table("v_items_full"), "item_id")


@query(
    "view_training_data",
    with_(ITEMS, SALES, VIEW_TABLES.replace("FROM auctions WHERE", "FROM (SELECT NULL::BIGINT AS auction_id, '' AS auction_title, '' AS auction_status, NULL AS auction_last_item_closes) x WHERE"))
    + f"""SELECT i.item_id, {r("winning_bid", "target")}, has_bids, is_sold, category_avg_price, category_median_price,
  s.bid_count AS seq_bid_count, s.unique_bidders AS seq_unique_bidders, s.soft_close_extensions
  FROM stored i JOIN features_tabular f ON i.item_id = f.item_id LEFT JOIN features_sequential s ON i.item_id = s.item_id
  WHERE winning_bid IS NOT NULL""",
)
def view_training_data(spark, folder):
    views(spark, folder)
    return rounded(spark.table("v_training_data"), "item_id")


# ---------------------------------------------------------------- aggregates


@query(
    "auction_rollup",
    with_(ITEMS)
    + f"""SELECT auction_id, CAST(sum(item_lot_number) AS BIGINT) AS total_viewed,
      {r("sum(coalesce(item_current_bid, 0))", "total_winning_price", 2)}, CAST(sum(item_bid_count) AS BIGINT) AS total_bid_count,
      CAST(sum(item_number_of_images) AS BIGINT) AS total_images, count(*) AS catalog_lots FROM items GROUP BY 1""",
)
def auction_rollup(spark, folder):
    items = bindings.items(spark, folder).select(
        "auction_id",
        F.col("item_lot_number").alias("viewed"),
        F.col("item_current_bid").alias("current_bid"),
        F.col("item_bid_count").alias("bid_count"),
        F.col("item_number_of_images").alias("number_of_images"),
    )
    return rounded(roll_up_items(items), "auction_id", digits=2)


@query("value_counts", "SELECT p_brand, count(*) AS count FROM part GROUP BY 1")
def value_counts(spark, folder):
    return summaries.value_counts(bindings.table(spark, folder, "part"), "p_brand")


@query("top_brands", "SELECT p_brand, count(*) AS count FROM part GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def top_brands(spark, folder):
    return summaries.top_values(bindings.table(spark, folder, "part"), "p_brand", 10)


@query(
    "distinct_counts",
    "SELECT 'l_orderkey' AS \"column\", count(DISTINCT l_orderkey) AS \"distinct\" FROM lineitem UNION ALL "
    "SELECT 'l_partkey', count(DISTINCT l_partkey) FROM lineitem UNION ALL "
    "SELECT 'l_returnflag', count(DISTINCT l_returnflag) FROM lineitem",
)
def distinct_counts(spark, folder):
    return summaries.distinct_counts(
        bindings.table(spark, folder, "lineitem"), ["l_orderkey", "l_partkey", "l_returnflag"]
    )


@query(
    "mean_price_by_condition",
    with_(ENRICHED_ITEMS)
    + f"SELECT enriched_item_condition, {r('avg(item_current_bid)', 'mean_price')} FROM items JOIN enriched_items USING (item_id, auction_id) GROUP BY 1",
)
def mean_price_by_condition(spark, folder):
    df = joins.merge(
        bindings.items(spark, folder), bindings.enriched_items(spark, folder), ["item_id", "auction_id"], "inner"
    )
    return rounded(summaries.mean_by(df, "enriched_item_condition", "item_current_bid", "mean_price"))


@query(
    "column_coverage",
    with_(ITEMS)
    + " UNION ALL ".join(
        f"SELECT '{c}' AS field, {r(f'avg(CASE WHEN {c} IS NOT NULL THEN 1 ELSE 0 END)', 'share')}, {r(str(t), 'target')}, "
        f"CAST(avg(CASE WHEN {c} IS NOT NULL THEN 1 ELSE 0 END) >= {t} AS BIGINT) AS reached FROM items"
        for c, t in (("item_title", 1.0), ("item_description", 0.8), ("item_closes", 0.9))
    ),
)
def column_coverage(spark, folder):
    targets = {"item_title": 1.0, "item_description": 0.8, "item_closes": 0.9}
    return rounded(summaries.coverage(bindings.items(spark, folder), list(targets), targets), "field")


@query("pickup_day_distribution", with_(AUCTIONS) + "SELECT CAST(CASE auction_id % 8 WHEN 0 THEN 5 WHEN 1 THEN 4 WHEN 2 THEN 6 WHEN 3 THEN 0 WHEN 6 THEN 1 WHEN 7 THEN 3 END AS BIGINT) AS pickup_day_of_week, count(*) AS count FROM auctions GROUP BY 1")
def pickup_day_distribution(spark, folder):
    from gavelworks.functions.pickup import add_pickup_windows

    df = add_pickup_windows(bindings.auctions(spark, folder).select("auction_removal_info"))
    return rounded(summaries.distribution(df, "pickup_day_of_week"))


@query(
    "describe_prices",
    f"""SELECT count(l_extendedprice) AS count, {r("avg(l_extendedprice)", "mean")}, {r("stddev_samp(l_extendedprice)", "std")},
      {r("min(l_extendedprice)", "min")}, {r("quantile_cont(l_extendedprice, 0.25)", "p25")},
      {r("quantile_cont(l_extendedprice, 0.5)", "p50")}, {r("quantile_cont(l_extendedprice, 0.75)", "p75")},
      {r("max(l_extendedprice)", "max")} FROM lineitem""",
)
def describe_prices(spark, folder):
    return rounded(summaries.describe(bindings.table(spark, folder, "lineitem"), "l_extendedprice"))


@query(
    "bid_counts_down",
    with_(BIDS)
    + """SELECT item_id, bid_id, count(*) OVER (PARTITION BY item_id) AS bid_count,
      count(*) OVER (PARTITION BY item_id) - row_number() OVER (PARTITION BY item_id ORDER BY u, bid_id) + 1 AS bid_down_id FROM bids""",
)
def bid_counts_down(spark, folder):
    return summaries.with_bid_count(bindings.bids(spark, folder)).select("item_id", "bid_id", "bid_count", "bid_down_id")


@query(
    "auction_grand_totals",
    with_(AUCTIONS)
    + f"""SELECT count(*) AS auctions, CAST(sum(auction_item_count) AS BIGINT) AS sum_item_count,
      {r("avg(auction_item_count)", "avg_item_count")}, {r("sum(auction_total_winning_price)", "sum_winning_price", 2)},
      {r("avg(auction_total_winning_price)", "avg_winning_price", 2)}, CAST(sum(auction_total_bid_count) AS BIGINT) AS sum_bid_count,
      {r("avg(auction_total_bid_count)", "avg_bid_count", 2)}, CAST(sum(auction_total_images) AS BIGINT) AS sum_images,
      {r("avg(auction_total_images)", "avg_images", 2)} FROM auctions""".replace(
        r("avg(auction_item_count)", "avg_item_count"), r("avg(auction_item_count)", "avg_item_count", 2)
    ),
)
def auction_grand_totals(spark, folder):
    return rounded(summaries.auction_totals(bindings.auctions(spark, folder)), digits=2)


@query(
    "category_statistics",
    f"""SELECT p_type, {r("avg(l_extendedprice)", "category_avg_price")}, {r("median(l_extendedprice)", "category_median_price")},
      {r("avg(CASE WHEN l_extendedprice > 0 THEN 1 ELSE 0 END)", "category_sell_rate")}
      FROM (SELECT p_type, CASE WHEN l_linenumber <> 3 THEN l_extendedprice END AS l_extendedprice
            FROM lineitem JOIN part ON l_partkey = p_partkey) t GROUP BY 1""",
)
def category_statistics(spark, folder):
    return rounded(summaries.category_statistics(priced_lines(spark, folder), "p_type", "l_extendedprice"), "p_type")


@query(
    "category_medians_in_huge_groups",
    f"""SELECT p_type, {r("median(l_extendedprice)", "median_price")}
      FROM (SELECT p_type, CASE WHEN l_linenumber <> 3 THEN l_extendedprice END AS l_extendedprice
            FROM lineitem JOIN part ON l_partkey = p_partkey) t GROUP BY 1""",
)
def category_medians_in_huge_groups(spark, folder):
    """Six categories hold everything; a small limit ranks them across tasks."""
    from gavelworks.operators.scans import grouped_median

    lines = priced_lines(spark, folder)
    return rounded(grouped_median(lines, ["p_type"], "l_extendedprice", "median_price", limit=1500), "p_type")


def priced_lines(spark, folder):
    lines = bindings.table(spark, folder, "lineitem")
    part = bindings.table(spark, folder, "part").select("p_partkey", "p_type")
    return lines.join(part, F.col("l_partkey") == F.col("p_partkey")).select(
        "p_type", F.when(F.col("l_linenumber") != 3, F.col("l_extendedprice")).alias("l_extendedprice")
    )


@query(
    "auction_results",
    with_(ITEMS, SALES)
    + f"""SELECT auction_id, CAST(sum(bid_count) AS BIGINT) AS total_bids,
      {r("sum(CASE WHEN winning_bid > 0 THEN winning_bid ELSE 0 END)", "total_revenue", 2)},
      count(*) FILTER (winning_bid > 0) AS items_sold, count(*) - count(*) FILTER (winning_bid > 0) AS items_unsold
      FROM sales GROUP BY 1""",
)
def auction_results(spark, folder):
    return rounded(summaries.auction_results(sale_rows(spark, folder)), "auction_id", digits=2)


@query(
    "no_bid_rates",
    with_(ITEMS, SALES) + f"SELECT auction_id, {r('avg(CASE WHEN bid_count = 0 THEN 1 ELSE 0 END)', 'no_bid_rate')} FROM sales GROUP BY 1",
)
def no_bid_rates(spark, folder):
    return rounded(summaries.no_bid_rate(sale_rows(spark, folder), "auction_id"), "auction_id")


@query(
    "seller_average_price",
    with_(ITEMS) + f"SELECT item_seller_id, {r('avg(item_current_bid)', 'seller_avg_price')} FROM items GROUP BY 1",
)
def seller_average_price(spark, folder):
    return rounded(
        summaries.mean_by(bindings.items(spark, folder), "item_seller_id", "item_current_bid", "seller_avg_price"),
        "item_seller_id",
    )


@query(
    "completed_auctions",
    "SELECT o_orderstatus, CAST(o_orderstatus IN ('F') AS BIGINT) AS is_completed, count(*) AS n FROM orders GROUP BY 1",
)
def completed_auctions(spark, folder):
    status = F.when(F.col("o_orderstatus") == "F", "Closed").otherwise("open")
    orders = bindings.table(spark, folder, "orders").withColumn("is_completed", is_completed(status))
    return rounded(orders.groupBy("o_orderstatus", "is_completed").agg(F.count("*").alias("n")), "o_orderstatus")


# ----------------------------------------------------------- bid sequences


@query(
    "bid_sequence_statistics",
    with_(BIDS)
    + f"""SELECT item_id, count(*) AS bid_count, count(DISTINCT bid_id % 4) AS unique_bidders,
      {r(f"min((u - {START_US}) / 1e6)", "time_to_first_bid_seconds")},
      {r("(max(u) - min(u)) / 1e6 / nullif(count(*) - 1, 0)", "avg_time_between_bids_seconds")},
      {r(f"count(*) FILTER ({END_US} - u BETWEEN 0 AND 3600000000) / 60.0", "bid_velocity_last_hour")},
      count(*) FILTER ({END_US} - u BETWEEN 0 AND 120000000) AS soft_close_bid_count FROM bids GROUP BY item_id""",
)
def bid_sequence_statistics(spark, folder):
    bids = bids_with_schedule(spark, folder).withColumn("bidder_id", F.col("bid_id") % 4)
    out = summaries.bid_sequence_statistics(bids, "auction_start_time", "auction_end_time")
    return rounded(out, "item_id")


@query(
    "bid_positions",
    with_(BIDS)
    + f"""SELECT bid_id, row_number() OVER (PARTITION BY item_id ORDER BY u, bid_id) AS bid_sequence,
      {r(f"({END_US} - u) / 1e6", "time_to_close_seconds")},
      CAST({END_US} - u BETWEEN 0 AND 120000000 AS BIGINT) AS is_soft_close_trigger FROM bids""",
)
def bid_positions(spark, folder):
    out = summaries.with_bid_position(bids_with_schedule(spark, folder), "auction_end_time")
    return rounded(out.select("bid_id", "bid_sequence", "time_to_close_seconds", "is_soft_close_trigger"), "bid_id")


@query(
    "bid_sequences",
    with_(BIDS)
    + f"""SELECT item_id, row_number() OVER w AS position, {r("bid_amount", "bid_amount")},
      {r("CASE WHEN row_number() OVER w = 1 THEN bid_amount ELSE bid_amount - lag(bid_amount) OVER w END", "bid_increment")}
      FROM bids WINDOW w AS (PARTITION BY item_id ORDER BY u, bid_id)""",
)
def bid_sequences(spark, folder):
    return rounded(summaries.bid_sequences(bindings.bids(spark, folder)), "item_id")


SEQUENCE = """
steps AS (SELECT item_id, bid_amount, row_number() OVER (PARTITION BY item_id ORDER BY u, bid_id) AS n FROM bids)
"""


@query(
    "padded_bid_sequences",
    with_(BIDS, SEQUENCE)
    + """SELECT item_id, least(max(n), 40) AS length, string_agg(printf('%.2f', bid_amount), ',' ORDER BY n)
      FILTER (n <= 40) || repeat(',0.00', 40 - CAST(least(max(n), 40) AS INTEGER)) AS sequence FROM steps GROUP BY 1""",
)
def padded_bid_sequences(spark, folder):
    out = summaries.padded_sequences(bindings.bids(spark, folder), 40)
    text = F.array_join(F.transform("sequence", lambda x: F.format_string("%.2f", x)), ",")
    return out.select("item_id", "length", text.alias("sequence"))


@query(
    "padded_bid_sequences_front",
    with_(BIDS, SEQUENCE, "counted AS (SELECT *, max(n) OVER (PARTITION BY item_id) AS m FROM steps)")
    + """SELECT item_id, least(max(m), 40) AS length, repeat('0.00,', 40 - CAST(least(max(m), 40) AS INTEGER)) ||
      string_agg(printf('%.2f', bid_amount), ',' ORDER BY n) FILTER (n > m - 40) AS sequence FROM counted GROUP BY 1""",
)
def padded_bid_sequences_front(spark, folder):
    out = summaries.padded_sequences(bindings.bids(spark, folder), 40, "pre")
    text = F.array_join(F.transform("sequence", lambda x: F.format_string("%.2f", x)), ",")
    return out.select("item_id", "length", text.alias("sequence"))


# ------------------------------------------------------------ whole bid table


@query(
    "bid_features_at_close",
    with_(BIDS)
    + f"""SELECT item_id, count(*) AS bids, {r("max(bid_amount)", "top_bid")}, {r("(max(u) - min(u)) / 1e6", "active_seconds")}
      FROM bids GROUP BY item_id""",
)
def bid_features_at_close(spark, folder):
    """The features of each item's last bid, and of the last that was a new high, describe the whole item."""
    features = engineer_bid_features(bindings.bids(spark, folder), ["bid_id"], groups=["time_series", "bid_counts", "auction_progress"])
    # An amount of zero has no ratio to divide by; the last bid that was a new high needs none.
    new_high = F.when(F.col("is_new_high") == 1, F.col("number_of_bids_so_far"))
    out = features.groupBy("item_id").agg(
        F.max("number_of_bids_so_far").alias("bids"),
        F.max_by("bid_amount", new_high).alias("top_bid"),
        F.max("time_since_first_bid_seconds").alias("active_seconds"),
    )
    return rounded(out, "item_id")




# ------------------------------------------------------------- SQL functions


@query(
    "sql_functions",
    f"""SELECT o_orderkey, CAST(CASE WHEN o_totalprice < 0 THEN 250 WHEN o_totalprice < 10 THEN 1 WHEN o_totalprice < 40 THEN 3
      WHEN o_totalprice < 100 THEN 5 WHEN o_totalprice < 1000 THEN 10 WHEN o_totalprice < 5000 THEN 50
      WHEN o_totalprice < 10000 THEN 100 ELSE 250 END AS BIGINT) AS step,
      CASE WHEN month(o_orderdate) IN (12, 1, 2) THEN 'winter' WHEN month(o_orderdate) IN (3, 4, 5) THEN 'spring'
        WHEN month(o_orderdate) IN (6, 7, 8) THEN 'summer' ELSE 'fall' END AS season, 'night' AS part,
      CAST(month(o_orderdate) = 7 AND day(o_orderdate) = 4 AS BIGINT) AS fourth_of_july,
      {r("o_totalprice", "price")} FROM orders""",
)
def sql_functions(spark, folder):
    """The scalar rules called from SQL text."""
    from gavelworks.functions.sql import register_functions

    register_functions(spark)
    bindings.table(spark, folder, "orders").createOrReplaceTempView("orders")
    out = spark.sql(
        "SELECT o_orderkey, expected_increment(o_totalprice) AS step, season_of(month(o_orderdate)) AS season, "
        "part_of_day(hour(o_orderdate)) AS part, month(o_orderdate) = 7 AND is_us_holiday(o_orderdate) AS fourth_of_july, "
        "o_totalprice AS price FROM orders"
    )
    return rounded(out, "o_orderkey")
