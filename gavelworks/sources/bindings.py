"""Auction-shaped views of the star-schema and event tables.

The auction tables have no files of their own here, so each is a projection of
the given ones: events become bids, orders become auctions, line items become
items, customers become postal areas.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gavelworks.operators.scans import row_numbers
from gavelworks.session import use_utc

REMOVAL_NOTES = [
    "<p>Pickup: Saturday at the barn, 8AM - 12 NOON</p>",
    "<b>Pickup:</b> Friday rain or shine, 3PM - 8PM",
    "<p>Pickup: Sunday, 10:30AM - 1:15PM</p><p>Category A: 9AM - 11AM</p><p>Cat B: 11AM - 1PM</p>",
    "<div>Pickup: Monday 11PM - 2AM</div>",
    "no times announced",
    "",
    "Pickup:&nbsp;Tuesday 9:30PM - 8PM and 13PM - 14PM and 5PM - 5PM",
    "Pickup: thursday 12AM - 12PM, 6:30 pm - 8:45 pm",
]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    use_utc(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def bids(spark: SparkSession, folder: str, coarse: bool = False) -> DataFrame:
    """Events as bids, with time compressed 600-fold so that trailing windows are busy.

    ``coarse`` cuts the time to whole minutes, which makes many bids simultaneous.
    """
    events = table(spark, folder, "events")
    us = F.expr("unix_micros(cast(ts as timestamp)) div 600")
    if coarse:
        us = F.floor(us / F.lit(60_000_000)) * F.lit(60_000_000)
    return events.select(
        F.col("user_id").alias("item_id"),
        (F.col("user_id") % 10).alias("auction_id"),
        F.col("event_id").alias("bid_id"),
        F.timestamp_micros(us).alias("bid_time"),
        F.col("value").alias("bid_amount"),
        (F.col("event_type") == "purchase").alias("is_proxy_bid"),
    )


def auctions(spark: SparkSession, folder: str) -> DataFrame:
    """Orders as auctions: schedule, removal notes, partner link and item totals."""
    key = F.col("o_orderkey")
    day, minute = F.expr("interval 1 day"), F.expr("interval 1 minute")
    ends = F.col("o_orderdate").cast("timestamp") + day * (key % 10)
    note = F.element_at(F.lit(REMOVAL_NOTES), (key % 8).cast("int") + 1)
    partner = (
        F.when(key % 5 == 0, F.concat(F.lit("https://partner.example/"), key.cast("string")))
        .when(key % 5 == 1, "")
        .when(key % 5 == 2, "nan")
        .when(key % 5 == 3, "None")
    )
    totals = (
        table(spark, folder, "lineitem")
        .groupBy(F.col("l_orderkey").alias("o_orderkey"))
        .agg(
            F.count("*").alias("auction_item_count"),
            F.sum("l_quantity").cast("long").alias("auction_total_viewed"),
            F.round(F.sum("l_extendedprice"), 2).alias("auction_total_winning_price"),
            F.sum("l_linenumber").cast("long").alias("auction_total_bid_count"),
            F.sum(F.col("l_linenumber") % 4).cast("long").alias("auction_total_images"),
        )
    )
    return (
        table(spark, folder, "orders")
        .join(totals, "o_orderkey", "left")
        .select(
            key.alias("auction_id"),
            F.concat(F.lit("Auction "), key.cast("string")).alias("auction_title"),
            F.col("o_orderdate").cast("timestamp").alias("auction_starts"),
            ends.alias("auction_ends"),
            (ends + minute * (key % 7 * 5)).alias("auction_last_item_closes"),
            F.nullif(note, F.when(key % 24 == 5, F.lit(""))).alias("auction_removal_info"),
            partner.alias("auction_partner_url"),
            F.when(F.col("o_orderstatus") == "F", "completed").otherwise("open").alias("auction_status"),
            F.coalesce("auction_item_count", F.lit(0)).alias("auction_item_count"),
            "auction_total_viewed",
            "auction_total_winning_price",
            "auction_total_bid_count",
            "auction_total_images",
        )
    )


def postal_code() -> F.Column:
    """Postal code of a customer: valid, lower-case, unspaced, malformed and missing ones."""
    key = F.col("c_custkey")
    letters = F.lit("ABCEGHJKLM")
    code = F.concat(
        F.substring(letters, (key % 10).cast("int") + 1, 1),
        (key % 7).cast("string"),
        F.substring(letters, (key % 3).cast("int") + 1, 1),
    )
    return (
        F.when(key % 11 == 0, F.lit(None).cast("string"))
        .when(key % 13 == 0, F.concat(F.lit("9"), code))
        .when(key % 3 == 0, F.lower(F.concat(code, F.lit(" 3a8"))))
        .when(key % 3 == 1, F.concat(code, F.lit("3A8")))
        .otherwise(F.concat(code, F.lit(" 3A8")))
    )


def enriched_auctions(spark: SparkSession, folder: str) -> DataFrame:
    """Location and category of each auction, from its customer and nation."""
    key = F.col("o_orderkey")
    base = "enriched_auction_"
    customer = table(spark, folder, "customer")
    nation = table(spark, folder, "nation")
    region = table(spark, folder, "region")
    places = nation.join(F.broadcast(region), nation.n_regionkey == region.r_regionkey)
    return (
        table(spark, folder, "orders")
        .join(customer, F.col("o_custkey") == F.col("c_custkey"), "left")
        .join(F.broadcast(places), F.col("c_nationkey") == F.col("n_nationkey"), "left")
        .select(
            key.alias("auction_id"),
            F.when(key % 17 != 0, F.col("o_orderpriority")).alias(base + "category"),
            F.col("o_orderstatus").alias(base + "type"),
            F.when(key % 19 != 0, F.col("r_name")).alias(base + "displayRegion"),
            F.col("c_name").alias(base + "approxLocation_city"),
            F.when(F.col("c_nationkey") < 10, "CA").otherwise("US").alias(base + "approxLocation_countryCode"),
            F.col("n_name").alias(base + "approxLocation_regionCode"),
            postal_code().alias(base + "approxLocation_postalCode"),
            F.when(F.col("c_custkey") % 9 != 0, F.lit(40.0) + F.col("c_custkey") % 20).alias(
                base + "approxLocation_lat"
            ),
            F.when(F.col("c_custkey") % 9 != 0, F.lit(-135.0) + F.col("c_custkey") % 80).alias(
                base + "approxLocation_lng"
            ),
        )
    )


def areas(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Census and tax rows as delivered: padded headers, text keys, aggregate rows among them.

    A quarter of the customers counts in areas that only the census has, another in areas that only the tax table has.
    """
    customer = table(spark, folder, "customer").withColumn(
        "area", F.substring(F.replace(postal_code(), F.lit(" "), F.lit("")), 1, 3)
    )

    def moved(part: int, letter: str) -> DataFrame:
        area = F.concat(F.lit(letter), F.substring("area", 2, 2))
        return customer.withColumn("area", F.when(F.col("c_custkey") % 4 == part, area).otherwise(F.col("area")))

    population = (
        moved(1, "Y")
        .groupBy("area")
        .agg(
            F.count("*").cast("long").alias("Population, 2021 "),
            F.sum(F.col("c_nationkey")).cast("long").alias("Total private dwellings, 2021"),
            F.sum(F.col("c_nationkey") % 5).cast("long").alias(
                "Private dwellings occupied by usual residents, 2021"
            ),
        )
        .withColumnRenamed("area", "Population and dwelling counts ")
        .unionByName(
            customer.groupBy(F.lit("Canada 2").alias("Population and dwelling counts ")).agg(
                F.count("*").cast("long").alias("Population, 2021 "),
                F.sum(F.col("c_nationkey")).cast("long").alias("Total private dwellings, 2021"),
                F.sum(F.col("c_nationkey") % 5).cast("long").alias(
                    "Private dwellings occupied by usual residents, 2021"
                ),
            )
        )
    )
    tax = (
        moved(2, "X")
        .groupBy(F.col("area").alias("FSA"))
        .agg(
            F.sum(F.col("c_custkey") % 3).cast("long").alias("Total"),
            F.sum(F.col("c_custkey") % 1000).cast("long").alias("Total income"),
            F.sum(F.col("c_custkey") % 900).cast("long").alias("Net income"),
            F.sum(F.col("c_custkey") % 800).cast("long").alias("Taxable income"),
        )
    )
    return population, tax


LINE_ORDER = ("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")


def _item_fields() -> dict[str, F.Column]:
    """Fields of an item, from a numbered line and the names of its part."""
    key = F.col("l_orderkey")
    id_ = key * 100 + F.col("lot")
    return {
        "item_id": id_,
        "auction_id": key,
        "item_lot_number": F.col("lot"),
        "item_title": F.when(id_ % 23 != 0, F.col("p_name")),
        "item_description": F.when(id_ % 7 == 0, F.lit(None).cast("string"))
        .when(id_ % 7 == 1, "")
        .otherwise(F.concat_ws(" ", "p_name", "p_type", "p_brand")),
        "item_current_bid": F.when(id_ % 29 != 0, F.col("l_extendedprice")),
        "item_closes": F.when(id_ % 31 != 0, F.col("l_shipdate").cast("timestamp")),
        "item_number_of_images": (id_ % 6).cast("int"),
        "item_bidding_extended": id_ % 4 == 0,
        "item_bid_count": id_ % 5,
        "item_seller_id": F.col("l_suppkey"),
    }


def items(spark: SparkSession, folder: str) -> DataFrame:
    """Line items as auction items, numbered within their order."""
    order = [F.col(c).asc() for c in LINE_ORDER]
    numbered = row_numbers(table(spark, folder, "lineitem"), ["l_orderkey"], order, "lot")
    part = table(spark, folder, "part")
    return numbered.join(part, F.col("l_partkey") == F.col("p_partkey"), "left").select(
        *[c.alias(name) for name, c in _item_fields().items()]
    )


def titled_items(spark: SparkSession, folder: str, share: tuple[int, int] = (0, 1)) -> DataFrame:
    """The fields of ``items`` that documents nest, with the items of an order left in one place.

    ``share`` is the number of a share of the orders, and how many shares there are.

    Parts are joined before the lines are numbered, so grouping these by order needs no exchange of
    its own, which would move the nested rows. A part that is listed twice would be numbered twice;
    with such parts the lines are numbered first.
    """
    lines = table(spark, folder, "lineitem").select("l_orderkey", "l_shipdate", *LINE_ORDER)
    if share[1] > 1:
        lines = lines.filter(F.pmod(F.xxhash64("l_orderkey"), F.lit(share[1])) == share[0])
    part = table(spark, folder, "part").select("p_partkey", "p_name")
    order = [F.col(c).asc() for c in LINE_ORDER]
    same = F.col("l_partkey") == F.col("p_partkey")
    often = part.filter(F.col("p_partkey").isNotNull()).groupBy("p_partkey").agg(F.count("*").alias("n")).filter(F.col("n") > 1)
    if often.isEmpty():
        numbered = row_numbers(lines.join(part, same, "left"), ["l_orderkey"], order, "lot", sizes=lines)
    else:
        numbered = row_numbers(lines, ["l_orderkey"], order, "lot").join(part, same, "left")
    fields = _item_fields()
    names = ["item_id", "auction_id", "item_lot_number", "item_title", "item_current_bid", "item_closes", "item_bid_count"]
    return numbered.select(*[fields[name].alias(name) for name in names])


def enriched_items(spark: SparkSession, folder: str) -> DataFrame:
    """Described items: brand, condition and JSON lists in every state they come in."""
    base = items(spark, folder)
    lineitem_key = F.col("item_id")
    k = lineitem_key % 8
    return base.select(
        "item_id",
        "auction_id",
        F.concat(F.lit("The "), F.col("item_title")).alias("enriched_item_title"),
        F.col("item_description").alias("enriched_item_description"),
        F.when(k < 4, "used, works").alias("enriched_item_qualitativeDescription"),
        F.when(k == 0, F.lit(None).cast("string")).when(k == 1, "").when(k == 2, "nan").when(k == 3, "None")
        .otherwise(F.concat(F.lit("Brand "), k.cast("string"))).alias("enriched_item_brand"),
        F.when(lineitem_key % 3 == 0, F.lit("Series 1")).alias("enriched_item_seriesLine"),
        F.when(k == 0, F.lit(None).cast("string")).when(k == 1, "").when(k == 2, "unknown")
        .when(k == 3, "Like New").when(k == 4, "Good/Fair").otherwise("Excellent").alias("enriched_item_condition"),
        F.when(k < 3, "Yes").when(k < 6, "Not-Tested").alias("enriched_item_working"),
        F.when(k == 0, "[]").when(k == 1, '["A", "B"]').when(k == 2, '{"a": 1}').when(k == 3, "not json")
        .when(k == 4, " ").when(k == 5, "0").when(k == 6, '"x"').alias("enriched_item_brands"),
        F.when(k < 5, '["Tools", "Hand Tools", "Saws"]').otherwise("[1, 2").alias("enriched_item_categories"),
        F.when(k < 2, "").when(k < 4, "nan").otherwise('[{"n": 1}, {"n": 2}]').alias("enriched_item_items"),
        F.when(k < 3, '{"color": "red", "size": "L", "n": {"m": 1}}').when(k < 5, "{}")
        .when(k == 5, "[1, 2, 3, 4]").when(k == 6, "{bad").alias("enriched_item_attributes"),
    )


# ----------------------------------------------------------------- documents
# Documents are built from the flat tables and cut to bounded size, so that a
# long auction or item becomes several documents.


def _image_json() -> F.Column:
    """Images as addresses, as objects under either name, or as a bare number."""
    link = F.concat(F.lit("https://img.example/"), F.col("item_id").cast("string"))
    k = F.col("item_id") % 4
    second = F.concat(link, F.lit("/2"))
    return (
        F.when(k == 0, F.to_json(F.array(link, second)))
        .when(k == 1, F.to_json(F.array(F.struct(link.alias("url")))))
        .when(k == 2, F.to_json(F.array(F.struct(F.lit("").alias("url"), link.alias("src")))))
        .otherwise("3")
    )


def auction_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Auction documents in the four shapes they come in: (auction_id, body)."""
    fields = F.to_json(
        F.struct(
            F.col("item_id").alias("id"),
            F.col("item_title").alias("title"),
            F.col("item_lot_number").alias("viewed"),
            F.col("item_current_bid").alias("current_bid"),
            F.col("item_bid_count").alias("bid_count"),
            F.col("item_bidding_extended").alias("bidding_extended"),
        )
    )
    # The text of the fields is used twice, so it is a column of its own.
    without_end = F.expr("substr(fields, 1, length(fields) - 1)")
    body = F.concat(without_end, F.lit(', "images": '), _image_json(), F.lit("}"))
    part = F.floor((F.col("item_lot_number") - 1) / 50)
    listed = (
        items(spark, folder)
        .withColumn("fields", fields)
        .groupBy("auction_id", part.alias("part"))
        .agg(F.array_sort(F.collect_list(F.struct("item_lot_number", body.alias("body")))).alias("lots"))
    )
    texts = F.transform("lots", lambda x: x["body"])
    as_list = F.concat(F.lit("["), F.array_join(texts, ","), F.lit("]"))
    keyed = F.transform(texts, lambda t, i: F.concat(F.lit('"'), i.cast("string"), F.lit('":'), t))
    as_object = F.concat(F.lit("{"), F.array_join(keyed, ","), F.lit("}"))
    head = F.concat(F.lit('{"auction": {"title": "Auction '), F.col("auction_id").cast("string"), F.lit('", '))
    k = F.col("auction_id") % 4
    document = (
        F.when(k == 0, F.concat(head, F.lit('"items": '), as_list, F.lit("}}")))
        .when(k == 1, F.concat(head, F.lit('"catalog_lots": 99, "items": '), as_object, F.lit("}}")))
        .when(k == 2, as_list)
        .otherwise(F.concat(F.lit('{"items": '), as_list, F.lit("}")))
    )
    return listed.select((F.col("auction_id") * 1000 + F.col("part")).alias("auction_id"), document.alias("body"))


def bid_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Bid histories of items in two shapes, at most a thousand bids each."""
    events = table(spark, folder, "events")
    bid = F.struct(
        F.col("event_id").alias("order"),
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("time_of_bid"),
        F.col("value").alias("amount"),
        (F.col("event_type") == "purchase").alias("isproxy"),
    )
    id_ = F.col("user_id") * 100_000 + F.floor(F.col("event_id") / 1000)
    histories = events.groupBy("user_id", id_.alias("id")).agg(F.array_sort(F.collect_list(bid)).alias("bids"))
    keyed = F.concat(
        F.lit('{"auction": {"items": {"0": '),
        F.to_json(F.struct("id", F.col("bids").alias("bid_history"))),
        F.lit("}}}"),
    )
    listed = F.to_json(F.array(F.struct("id", "bids")))
    return histories.select(
        (F.col("user_id") % 10).alias("auction_id"), F.when(F.col("user_id") % 2 == 0, keyed).otherwise(listed).alias("body")
    )


def enriched_auction_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Enriched auctions; some have no location, or text in its place."""
    base = "enriched_auction_"
    place = base + "approxLocation_"
    rows = enriched_auctions(spark, folder)
    location = F.struct(
        *[F.col(place + c).alias(c) for c in ("city", "countryCode", "regionCode", "postalCode")],
        F.struct(F.col(place + "lat").alias("lat"), F.col(place + "lng").alias("lng")).alias("latLng"),
    )
    plain = [F.col("auction_id").alias("amAuctionId"), *[F.col(base + c).alias(c) for c in ("type", "category", "displayRegion")]]
    k = F.col("auction_id") % 6
    body = (
        F.when(k == 0, F.to_json(F.struct(*plain)))
        .when(k == 1, F.to_json(F.struct(*plain, F.lit("unknown").alias("approxLocation"))))
        .otherwise(F.to_json(F.struct(*plain, location.alias("approxLocation"))))
    )
    return rows.select("auction_id", body.alias("body"))


def enriched_item_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Described items; some lack their own id or the whole description."""
    k = F.col("item_id")
    described = F.struct(
        F.col("enriched_item_title").alias("title"),
        F.col("enriched_item_condition").alias("condition"),
        F.lit(3).alias("numItems"),
        F.array(F.lit("A"), F.col("enriched_item_working")).alias("brands"),
        F.struct(F.lit("red").alias("color"), (k % 10).alias("size")).alias("attributes"),
    )
    return enriched_items(spark, folder).select(
        "item_id",
        F.to_json(
            F.struct(
                F.when(k % 5 != 0, k).alias("amLotId"),
                F.col("auction_id").alias("amAuctionId"),
                F.when(k % 9 != 0, described).alias("generatedDescription"),
            )
        ).alias("body"),
    )


def nested_documents(spark: SparkSession, folder: str, share: tuple[int, int] = (0, 1)) -> DataFrame:
    """Nested auction documents with up to four bids per item: (auction_id, order, body); all, or those of a share of the orders."""
    k = F.col("item_id")
    bid = lambda i: F.struct(
        F.concat(k.cast("string"), F.lit("-"), i.cast("string")).alias("bid_id"),
        (i * 1.5).alias("amount"),
        F.when(i == 1, True).alias("is_winning"),
    )
    bids_ = F.transform(F.filter(F.sequence(F.lit(0), F.col("item_bid_count").cast("int")), lambda i: i > 0), bid)
    item = F.struct(
        k.alias("item_id"),
        F.col("item_lot_number").alias("lot_number"),
        F.col("item_title").alias("title"),
        F.col("item_current_bid").alias("winning_price"),
        F.when(k % 2 == 0, F.col("item_bid_count")).alias("num_bids"),
        F.col("item_closes").alias("end_time"),
        bids_.alias("bids"),
    )
    part = F.floor((F.col("item_lot_number") - 1) / 50)
    grouped = titled_items(spark, folder, share).groupBy("auction_id", part.alias("part")).agg(F.collect_list(item).alias("items"))
    id_ = F.col("auction_id") * 1000 + F.col("part")
    body = F.to_json(
        F.struct(
            id_.alias("auction_id"),
            F.concat(F.lit("Auction "), F.col("auction_id").cast("string")).alias("title"),
            F.when(F.col("auction_id") % 3 != 0, F.struct(F.lit("Ottawa").alias("city"), F.lit("ON").alias("state"))).alias(
                "location"
            ),
            F.size("items").alias("num_items"),
            F.when(F.col("auction_id") % 2 == 0, "closed").alias("status"),
            "items",
        )
    )
    return grouped.select(id_.alias("auction_id"), F.col("auction_id").alias("order"), body.alias("body"))
