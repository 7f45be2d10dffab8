"""Landed JSON documents flattened to tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from gavelworks.schemas import image_columns
from gavelworks.session import shared_dir
from gavelworks.sources import bindings
from gavelworks.sources import documents as docs
from registry.common import ENRICHED_AUCTIONS, ENRICHED_ITEMS, ITEMS, query, r, rounded, with_

IMAGES = "CASE item_id % 4 WHEN 0 THEN 2 WHEN 1 THEN 1 WHEN 2 THEN 1 ELSE 3 END"


@query(
    "documents_to_auctions",
    with_(ITEMS)
    + f"""SELECT auction_id * 1000 + (item_lot_number - 1) // 50 AS id,
      CASE WHEN auction_id % 4 < 2 THEN 'Auction ' || auction_id END AS title,
      CASE WHEN auction_id % 4 = 1 THEN 99 ELSE count(*) END AS catalog_lots,
      CAST(sum(item_lot_number) AS BIGINT) AS total_viewed, {r("sum(coalesce(item_current_bid, 0))", "total_winning_price", 2)},
      CAST(sum(item_bid_count) AS BIGINT) AS total_bid_count, CAST(sum({IMAGES}) AS BIGINT) AS total_images
      FROM items GROUP BY auction_id, (item_lot_number - 1) // 50""",
)
def documents_to_auctions(spark, folder):
    out = docs.auctions_from_documents(bindings.auction_documents(spark, folder))
    names = ["title", "catalog_lots", "total_viewed", "total_winning_price", "total_bid_count", "total_images"]
    return rounded(out.select("id", *names), "id", digits=2)


@query(
    "documents_to_items",
    with_(ITEMS)
    + f"""SELECT item_id AS id, auction_id * 1000 + (item_lot_number - 1) // 50 AS auction_id, item_title AS title,
      item_lot_number AS viewed, {r("item_current_bid", "current_bid")}, item_bid_count AS bid_count,
      CAST(item_bidding_extended AS BIGINT) AS bidding_extended, CAST({IMAGES} AS BIGINT) AS number_of_images FROM items""",
)
def documents_to_items(spark, folder):
    out = docs.items_from_documents(bindings.auction_documents(spark, folder))
    names = ["auction_id", "title", "viewed", "current_bid", "bid_count", "bidding_extended", "number_of_images"]
    return rounded(out.select("id", *names), "id")


@query(
    "documents_to_bids",
    f"""SELECT user_id % 10 AS auction_id, user_id * 100000 + event_id // 1000 AS item_id,
      strftime(ts, '%Y-%m-%d %H:%M:%S') AS time_of_bid, {r("value", "amount")},
      CAST(event_type = 'purchase' AS BIGINT) AS isproxy,
      count(*) OVER (PARTITION BY user_id, event_id // 1000) - row_number() OVER (PARTITION BY user_id, event_id // 1000 ORDER BY event_id) + 1 AS id,
      count(*) OVER (PARTITION BY user_id, event_id // 1000) AS count FROM events""",
)
def documents_to_bids(spark, folder):
    return rounded(docs.bids_from_documents(bindings.bid_documents(spark, folder)), "auction_id", "item_id")


LINK = "'https://img.example/' || item_id"


@query(
    "documents_to_first_images",
    with_(ITEMS)
    + f"""SELECT auction_id * 1000 + (item_lot_number - 1) // 50 AS auction_id, item_id, CAST(0 AS BIGINT) AS image_index,
      {LINK} AS image_url FROM items WHERE item_id % 4 <> 3""",
)
def documents_to_first_images(spark, folder):
    return rounded(docs.images_from_documents(bindings.auction_documents(spark, folder)), "auction_id", "item_id")


@query(
    "documents_to_all_images",
    with_(ITEMS)
    + f"""SELECT item_id, CAST(i AS BIGINT) AS image_index, CASE WHEN i = 0 THEN {LINK} ELSE {LINK} || '/2' END AS image_url
      FROM items, (SELECT 0 AS i UNION ALL SELECT 1) t WHERE item_id % 4 <> 3 AND (i = 0 OR item_id % 4 = 0)""",
)
def documents_to_all_images(spark, folder):
    out = docs.images_from_documents(bindings.auction_documents(spark, folder), max_images=None)
    return rounded(out.drop("auction_id"), "item_id")


@query(
    "documents_to_enriched_auctions",
    with_(ENRICHED_AUCTIONS)
    + f"""SELECT auction_id, type, category, region AS "displayRegion",
      CASE WHEN auction_id % 6 > 1 THEN city END AS "approxLocation_city",
      CASE WHEN auction_id % 6 > 1 THEN country END AS "approxLocation_countryCode",
      CASE WHEN auction_id % 6 > 1 THEN province END AS "approxLocation_regionCode",
      CASE WHEN auction_id % 6 > 1 THEN postal END AS "approxLocation_postalCode",
      {r("CASE WHEN auction_id % 6 > 1 THEN lat END", "approxLocation_lat")},
      {r("CASE WHEN auction_id % 6 > 1 THEN lng END", "approxLocation_lng")} FROM enriched_auctions""",
)
def documents_to_enriched_auctions(spark, folder):
    out = docs.enriched_auctions_from_documents(bindings.enriched_auction_documents(spark, folder))
    return rounded(out, "auction_id")


@query(
    "documents_to_enriched_items",
    with_(ENRICHED_ITEMS)
    + """SELECT item_id AS "amLotId", auction_id AS "amAuctionId",
      CASE WHEN item_id % 9 <> 0 THEN enriched_item_title END AS title,
      CASE WHEN item_id % 9 <> 0 THEN enriched_item_condition END AS condition,
      CASE WHEN item_id % 9 <> 0 THEN '3' END AS "numItems",
      CASE WHEN item_id % 9 <> 0 THEN '["A",' || coalesce('"' || enriched_item_working || '"', 'null') || ']' END AS brands,
      CASE WHEN item_id % 9 <> 0 THEN '{"color":"red","size":' || (item_id % 10) || '}' END AS attributes,
      NULL AS "photosTaken" FROM enriched_items""",
)
def documents_to_enriched_items(spark, folder):
    out = docs.enriched_items_from_documents(bindings.enriched_item_documents(spark, folder))
    return out.select("amLotId", "amAuctionId", "title", "condition", "numItems", "brands", "attributes", "photosTaken")


# ------------------------------------------------------------ nested records


def nested(spark, folder, share=(0, 1)):
    return docs.typed_documents(bindings.nested_documents(spark, folder, share))


@query(
    "nested_auctions",
    with_(ITEMS)
    + """SELECT auction_id * 1000 + (item_lot_number - 1) // 50 AS auction_id, 'Auction ' || auction_id AS title,
      CASE WHEN auction_id % 3 <> 0 THEN 'Ottawa' END AS city, CASE WHEN auction_id % 3 <> 0 THEN 'ON' END AS state,
      count(*) AS num_items, CASE WHEN auction_id % 2 = 0 THEN 'closed' ELSE 'unknown' END AS status
      FROM items GROUP BY auction_id, (item_lot_number - 1) // 50""",
)
def nested_auctions(spark, folder):
    out = docs.flat_records(nested(spark, folder))["auctions"]
    return out.select("auction_id", "title", "city", "state", "num_items", "status")


@query(
    "nested_items",
    with_(ITEMS)
    + f"""SELECT item_id, auction_id * 1000 + (item_lot_number - 1) // 50 AS auction_id, CAST(item_lot_number AS BIGINT) AS lot_number,
      item_title AS title, {r("0", "starting_bid")}, {r("item_current_bid", "winning_price")},
      CASE WHEN item_id % 2 = 0 THEN item_bid_count ELSE 0 END AS num_bids, epoch_us(item_closes) AS end_time,
      CAST(0 AS BIGINT) AS has_bids FROM items""",
)
def nested_items(spark, folder):
    out = docs.flat_records(nested(spark, folder))["items"]
    names = ["auction_id", "lot_number", "title", "starting_bid", "winning_price", "num_bids", "end_time", "has_bids"]
    return rounded(out.select("item_id", *names), "item_id")


@query(
    "nested_bids",
    with_(ITEMS)
    + f"""SELECT item_id || '-' || i AS bid_id, item_id, {r("i * 1.5", "amount")}, CAST(i = 1 AS BIGINT) AS is_winning,
      CAST(0 AS BIGINT) AS extended_auction FROM items, (SELECT unnest(range(1, 5)) AS i) t WHERE i <= item_bid_count""",
)
def nested_bids(spark, folder):
    out = docs.flat_records(nested(spark, folder))["bids"]
    return rounded(out.select("bid_id", "item_id", "amount", "is_winning", "extended_auction"), "bid_id")


@query(
    "nested_records_written",
    with_(ITEMS)
    + """SELECT 'auctions' AS name, count(DISTINCT (auction_id, (item_lot_number - 1) // 50)) AS rows FROM items UNION ALL
      SELECT 'items', count(*) FROM items UNION ALL SELECT 'bids', CAST(sum(item_bid_count) AS BIGINT) FROM items""",
)
def nested_records_written(spark, folder):
    """All three tables written from one parse, and the documents as JSON lines beside them.

    The documents are made and parsed in two shares, so that half of their shuffles are on disk at once.
    """
    import uuid

    root = f"{shared_dir(spark)}/nested-{uuid.uuid4().hex}"
    first, second = (nested(spark, folder, share=(i, 2)) for i in range(2))
    paths = docs.write_flat_records(first, root, "batch_0000", lines=f"{root}/json", more=[second])
    counted = [
        spark.read.parquet(path).agg(F.count("*").alias("rows")).select(F.lit(name).alias("name"), "rows")
        for name, path in paths.items()
    ]
    return counted[0].unionByName(counted[1]).unionByName(counted[2])


@query(
    "collection_totals",
    with_(ITEMS)
    + """SELECT (SELECT count(*) FROM orders) AS total, count(DISTINCT auction_id) AS completed,
      (SELECT count(*) FROM orders) - count(DISTINCT auction_id) AS failed, count(*) AS items_collected,
      CAST(sum(item_bid_count) AS BIGINT) AS bids_collected FROM items WHERE auction_id % 3 <> 0""",
)
def collection_totals(spark, folder):
    """Orders requested against all documents fetched for them; a third is requested under numbers that have none."""
    order = F.col("o_orderkey")
    number = F.when(order % 3 == 0, -order - 1).otherwise(order)
    requested = bindings.table(spark, folder, "orders").select(number.alias("auction_id"))
    parts = bindings.nested_documents(spark, folder).select("order", "body")
    fetched = docs.typed_documents(parts, keep=["order"]).drop("auction_id").withColumnRenamed("order", "auction_id")
    return rounded(docs.collection_totals(requested, fetched))


@query("image_vectors", f"SELECT vec_id AS item_id, CAST(label AS BIGINT) AS image_index, {r('list_sum(embedding)', 'total', 4)} FROM embeddings")
def image_vectors(spark, folder):
    stored = bindings.table(spark, folder, "embeddings").select(
        F.col("vec_id").alias("item_id"), F.col("label").alias("image_index"), "embedding", F.lit("https://x").alias("image_url")
    )
    out = image_columns(stored)
    total = F.aggregate(F.col("image_embedding").cast("array<double>"), F.lit(0.0), lambda s, x: s + x)
    return rounded(out.select("item_id", "image_index", total.alias("total")), "item_id", digits=4)
