"""Landed tables by value, and what is checked while tables are written."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from gavelworks import schemas
from gavelworks.functions import jsons
from gavelworks.functions.sql import register_functions
from gavelworks.operators import checks, summaries
from gavelworks.session import shared_dir
from gavelworks.sources import bindings, tables
from gavelworks.sources import documents as docs
from registry.auctions import PICKUP_NAMES
from registry.common import ITEMS, ORACLE, query, r, rounded, with_
from registry.documents import nested
from registry.items import SALES, sale_rows


def folder_of(spark, name):
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


# ------------------------------------------------------------- renamed tables


@query(
    "landed_auctions",
    f"""SELECT o_orderkey AS auction_id, o_orderpriority AS auction_title, o_custkey AS auction_item_count,
      {r("o_totalprice", "auction_winning_price")} FROM orders""",
)
def landed_auctions(spark, folder):
    """The auction table from its raw fields."""
    raw = bindings.table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("id"),
        F.col("o_orderpriority").alias("title"),
        F.col("o_custkey").alias("catalog_lots"),
        F.col("o_totalprice").alias("current_bid"),
    )
    return rounded(schemas.AUCTIONS.apply(raw), "auction_id")


@query(
    "landed_items",
    with_(ITEMS)
    + f"SELECT item_id, auction_id, item_title, {r('item_current_bid', 'item_current_bid')}, item_bid_count FROM items",
)
def landed_items(spark, folder):
    """The item table from its raw fields; the auction's id keeps its name."""
    raw = bindings.items(spark, folder).select(
        F.col("item_id").alias("id"),
        "auction_id",
        F.col("item_title").alias("title"),
        F.col("item_current_bid").alias("current_bid"),
        F.col("item_bid_count").alias("bid_count"),
    )
    return rounded(schemas.ITEMS.apply(raw), "item_id")


@query(
    "landed_bids",
    f"""SELECT user_id % 10 AS auction_id, user_id AS item_id, event_id AS bid_id, epoch_us(ts) AS bid_time,
      {r("value", "bid_amount")}, CAST(event_type = 'purchase' AS BIGINT) AS bid_is_proxy FROM events""",
)
def landed_bids(spark, folder):
    """The bid table from its raw fields; both keys keep their names."""
    bindings.use_utc(spark)
    raw = bindings.table(spark, folder, "events").select(
        (F.col("user_id") % 10).alias("auction_id"),
        F.col("user_id").alias("item_id"),
        F.col("event_id").alias("id"),
        F.col("ts").cast("timestamp").alias("time_of_bid"),
        F.col("value").alias("amount"),
        (F.col("event_type") == "purchase").alias("isproxy"),
    )
    return rounded(schemas.BIDS.apply(raw), "bid_id")


@query(
    "landed_enriched_auctions",
    """SELECT c_custkey AS auction_id, c_nationkey::BIGINT AS item_id, c_mktsegment AS enriched_auction_type,
      c_name AS enriched_auction_approxLocation_city FROM customer""",
)
def landed_enriched_auctions(spark, folder):
    raw = bindings.table(spark, folder, "customer").select(
        F.col("c_custkey").alias("amAuctionId"),
        F.col("c_nationkey").cast("long").alias("amLotId"),
        F.col("c_mktsegment").alias("type"),
        F.col("c_name").alias("approxLocation_city"),
    )
    return schemas.ENRICHED_AUCTIONS.apply(raw)


@query(
    "landed_enriched_items",
    """SELECT p_partkey AS item_id, p_size::BIGINT AS auction_id, p_name AS enriched_item_title, p_brand AS enriched_item_brand
      FROM part""",
)
def landed_enriched_items(spark, folder):
    raw = bindings.table(spark, folder, "part").select(
        F.col("p_partkey").alias("amLotId"),
        F.col("p_size").cast("long").alias("amAuctionId"),
        F.col("p_name").alias("title"),
        F.col("p_brand").alias("brand"),
    )
    return schemas.ENRICHED_ITEMS.apply(raw)


@query(
    "documents_as_json",
    with_(ITEMS)
    + f"""SELECT item_id, auction_id * 1000 + (item_lot_number - 1) // 50 AS auction_id, item_title AS title,
      {r("item_current_bid", "winning_price")}, epoch_us(item_closes) AS end_time, item_bid_count AS bids FROM items""",
)
def documents_as_json(spark, folder):
    """Nested documents written as JSON lines, read back under their schema, down to the bids."""
    path = folder_of(spark, "json")
    docs.write_documents(nested(spark, folder), path, compression="gzip")
    back = spark.read.schema(schemas.AUCTION_DOCUMENT).json(path)
    records = docs.flat_records(back)
    bids = records["bids"].groupBy("item_id").agg(F.count("*").alias("bids"))
    items = records["items"].select("item_id", "auction_id", "title", "winning_price", "end_time")
    return rounded(items.join(bids, "item_id", "left").fillna(0, ["bids"]), "item_id")


# ------------------------------------------------------------- contracts


@query(
    "append_under_contract",
    f"""WITH chunks AS (
        SELECT o_orderkey, o_custkey, {r("o_totalprice", "price")}, o_orderstatus AS status FROM orders UNION ALL
        SELECT o_orderkey, NULL, {r("floor(o_totalprice)", "price")}, o_orderstatus FROM orders UNION ALL
        SELECT CAST(o_orderkey % 1000 AS INTEGER), o_custkey, NULL, NULL FROM orders)
      SELECT o_orderkey, o_custkey, price, status, count(*) AS n FROM chunks GROUP BY ALL""",
)
def append_under_contract(spark, folder):
    """Chunks in another order, with narrower types and without columns, and two that are refused."""
    path = folder_of(spark, "contract")
    orders = bindings.table(spark, folder, "orders")
    first = orders.select("o_orderkey", "o_custkey", F.col("o_totalprice").alias("price"), F.col("o_orderstatus").alias("status"))
    tables.write_parquet(first, path)
    tables.append_to_contract(first.select("status", F.floor("price").cast("int").alias("price"), "o_orderkey"), path)
    tables.append_to_contract(first.select("o_custkey", (F.col("o_orderkey") % 1000).cast("int").alias("o_orderkey")), path)
    for refused in (first.withColumn("extra", F.lit(1)), first.withColumn("price", F.col("price").cast("string"))):
        try:
            tables.append_to_contract(refused, path)
        except tables.ContractError:
            continue
        raise AssertionError("rows that break the contract were added")
    out = rounded(tables.read_parquet(spark, path, first.schema), "o_orderkey", "o_custkey")
    return out.groupBy(*out.columns).agg(F.count("*").alias("n"))


@query(
    "quality_report",
    with_(ITEMS, SALES)
    + """SELECT rule, CAST(sum(broken) AS BIGINT) AS broken, count(*) AS rows FROM (
        SELECT unnest(['Missing title', 'Negative winning bid', 'Bid count mismatch', 'Missing winning_bid', 'Not a number: title']) AS rule,
          unnest([CAST(coalesce(title, '') = '' AS INTEGER), CAST(coalesce(winning_bid < 0, FALSE) AS INTEGER),
            CAST(bid_count > 0 AND recorded_bids = 0 AS INTEGER), CAST(winning_bid IS NULL AS INTEGER),
            CAST(title IS NOT NULL AND try_cast(title AS DOUBLE) IS NULL AS INTEGER)]) AS broken FROM sales) t GROUP BY rule""",
)
def quality_report(spark, folder):
    """How many items break each rule, counted while they are written."""
    path = folder_of(spark, "sales")
    rows = sale_rows(spark, folder)
    rules = checks.item_rules() | checks.column_rules(rows, ["winning_bid"], ["title"])
    checks.write_with_report(rows, f"{path}/rows", f"{path}/report", rules)
    return spark.read.parquet(f"{path}/report")


@query(
    "distinct_counts_by_batch",
    """SELECT name AS "column", exact, CAST(1 AS BIGINT) AS close, CAST(1 AS BIGINT) AS same_in_any_order FROM (
      SELECT 'l_partkey' AS name, count(DISTINCT l_partkey) AS exact FROM lineitem UNION ALL
      SELECT 'l_orderkey', count(DISTINCT l_orderkey) FROM lineitem UNION ALL
      SELECT 'l_extendedprice', count(DISTINCT l_extendedprice) FROM lineitem UNION ALL
      SELECT 'l_shipdate', count(DISTINCT l_shipdate) FROM lineitem) t""",
)
def distinct_counts_by_batch(spark, folder):
    """Sketches of four batches, merged in two orders, against the exact counts of all rows."""
    columns = ["l_partkey", "l_orderkey", "l_extendedprice", "l_shipdate"]
    path = folder_of(spark, "sketches")
    rows = bindings.table(spark, folder, "lineitem")
    batches = rows.select(*columns, F.pmod(F.xxhash64("l_orderkey", "l_linenumber"), F.lit(4)).alias("batch"))
    batches.write.partitionBy("batch").parquet(f"{path}/rows")
    for batch in range(4):
        summaries.add_sketches(spark.read.parquet(f"{path}/rows/batch={batch}"), columns, str(batch), f"{path}/sketches")
    sketches = spark.read.parquet(f"{path}/sketches")
    all_at_once = summaries.merged_distinct_counts(sketches)
    # The last two batches first, then the others one by one.
    union = lambda of: of.groupBy("column").agg(F.hll_union_agg("sketch").alias("sketch"))
    step = union(sketches.filter("batch >= 2"))
    for batch in (1, 0):
        step = union(step.unionByName(sketches.filter(F.col("batch") == batch).select("column", "sketch")))
    in_steps = step.select("column", F.hll_sketch_estimate("sketch").alias("again"))
    exact = summaries.distinct_counts(rows, columns)
    exact = exact.toDF("column", "exact")
    out = all_at_once.join(in_steps, "column").join(exact, "column")
    close = F.abs(F.col("distinct") - F.col("exact")) <= F.col("exact") * 0.02
    return out.select(
        "column", "exact", close.cast("long").alias("close"), (F.col("distinct") == F.col("again")).cast("long").alias("same_in_any_order")
    )


# ------------------------------------------------------------- table functions


@query("sql_pickup_windows", ORACLE["auction_pickup_windows"])
def sql_pickup_windows(spark, folder):
    """Pickup windows of every auction, called from SQL text."""
    register_functions(spark)
    bindings.auctions(spark, folder).createOrReplaceTempView("landed_auctions")
    out = spark.sql("SELECT auction_id, p.* FROM landed_auctions, LATERAL pickup_windows(auction_removal_info) AS p")
    return rounded(out.toDF("auction_id", *PICKUP_NAMES), "auction_id")


@query("sql_json_counts", ORACLE["item_list_counts"])
def sql_json_counts(spark, folder):
    """Entries or keys of every item's JSON columns, called from SQL text."""
    register_functions(spark)
    bindings.enriched_items(spark, folder).createOrReplaceTempView("landed_enriched_items")
    calls, names = [], []
    for i, (source, (out, keys)) in enumerate(jsons.LIST_COUNTS.items()):
        calls.append(f"LATERAL json_counts(`{source}`) AS t{i}")
        names.append(f"t{i}.{'keys' if keys else 'entries'} AS {out}")
    counted = spark.sql(f"SELECT item_id, {', '.join(names)} FROM landed_enriched_items, {', '.join(calls)}")
    return rounded(counted, "item_id")
