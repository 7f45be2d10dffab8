"""Landed JSON documents, flattened to tables.

A document is parsed once to VARIANT and read by path, so the shapes a
document comes in (items as a list, as an object keyed "0", "1", ..., or as
the whole document) differ only in where the items are looked for.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gavelworks.schemas import (
    AUCTION_DOCUMENT,
    AUCTION_FIELDS,
    BID_FIELDS,
    DESCRIPTION_FIELDS,
    DESCRIPTION_JSON_FIELDS,
    ITEM_FIELDS,
)
from gavelworks.session import shuffles_dropped, written

DOC = "_doc"


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """One document per file, with the file's name."""
    return spark.read.text(path, wholetext=True).select(
        F.col("value").alias("body"), F.col("_metadata.file_name").alias("file_name")
    )


def parsed(df: DataFrame, body: str = "body") -> DataFrame:
    return df.withColumn(DOC, F.try_parse_json(F.col(body)))


def _at(doc: Column, path: str, kind: str) -> Column:
    return F.try_variant_get(doc, path, kind)


def _listed(doc: Column, path: str) -> Column:
    """Elements of a list, or of an object in the order of its numeric keys."""

    def in_order(fields: Column) -> Column:
        keys = F.transform(F.map_keys(fields), lambda k: F.struct(k.try_cast("long").alias("n"), k.alias("k")))
        return F.transform(F.array_sort(keys), lambda k: F.element_at(fields, k["k"]))

    # The object is read once, as the only element of an array, and not again for each of its keys.
    once = F.transform(F.array(_at(doc, path, "map<string,variant>")), in_order)
    return F.coalesce(_at(doc, path, "array<variant>"), F.get(once, 0))


def document_items(doc: Column) -> Column:
    """Items of a document of any shape; an empty array when it has none."""
    empty = F.array().cast("array<variant>")
    return F.coalesce(
        _listed(doc, "$.auction.items"), _at(doc, "$.items", "array<variant>"), _at(doc, "$", "array<variant>"), empty
    )


def image_count(item: Column) -> Column:
    """Length of an image list, or the number itself; 0 for anything else."""
    images = _at(item, "$.images", "variant")
    is_number = F.schema_of_variant(images) == "BIGINT"
    return F.coalesce(
        F.size(_at(item, "$.images", "array<variant>")).cast("long"),
        F.when(is_number, _at(item, "$.images", "long")),
        F.lit(0).cast("long"),
    )


def auctions_from_documents(df: DataFrame, body: str = "body") -> DataFrame:
    """One row per document: auction fields, and totals over its items.

    The items are inside the row already, so the totals need no shuffle.
    """
    docs = parsed(df, body).withColumn("_items", document_items(F.col(DOC)))
    items = F.col("_items")

    def total(kind: str, value) -> Column:
        zero = F.lit(0).cast(kind)
        return F.aggregate(items, zero, lambda acc, x: acc + F.coalesce(value(x).cast(kind), zero))

    fields = {c: _at(F.col(DOC), f"$.auction.{c}", kind) for c, kind in AUCTION_FIELDS.items()}
    fields["catalog_lots"] = F.coalesce(fields["catalog_lots"], F.size(items).cast("long"))
    return docs.select(
        F.col("auction_id").alias("id"),
        *[c.alias(n) for n, c in fields.items()],
        total("long", lambda x: _at(x, "$.viewed", "long")).alias("total_viewed"),
        total("double", lambda x: _at(x, "$.current_bid", "double")).alias("total_winning_price"),
        total("long", lambda x: _at(x, "$.bid_count", "long")).alias("total_bid_count"),
        total("long", image_count).alias("total_images"),
    )


def exploded_items(df: DataFrame, body: str = "body") -> DataFrame:
    """One row per item of each document, with its position."""
    return parsed(df, body).select(
        "auction_id", F.posexplode(document_items(F.col(DOC))).alias("position", "_item")
    )


def items_from_documents(df: DataFrame, body: str = "body") -> DataFrame:
    item = F.col("_item")
    return exploded_items(df, body).select(
        _at(item, "$.id", "long").alias("id"),
        "auction_id",
        *[_at(item, f"$.{c}", kind).alias(c) for c, kind in ITEM_FIELDS.items()],
        image_count(item).alias("number_of_images"),
    )


def bids_from_documents(df: DataFrame, body: str = "body") -> DataFrame:
    """One row per bid. Ids count down: the first bid listed has the item's bid count, the last has 1."""
    item = F.col("_item")
    history = F.coalesce(
        _listed(item, "$.bid_history"),
        _at(item, "$.bids", "array<variant>"),
        _at(item, "$.bidHistory", "array<variant>"),
    )
    listed = (
        exploded_items(df, body)
        .select("auction_id", _at(item, "$.id", "long").alias("item_id"), history.alias("_history"))
        .select("auction_id", "item_id", F.size("_history").alias("_count"), F.posexplode("_history").alias("_at", "_bid"))
    )
    return listed.select(
        "auction_id",
        "item_id",
        *[_at(F.col("_bid"), f"$.{c}", kind).alias(c) for c, kind in BID_FIELDS.items()],
        (F.col("_count") - F.col("_at")).cast("long").alias("id"),
        F.col("_count").cast("long").alias("count"),
    )


def images_from_documents(df: DataFrame, body: str = "body", max_images: int | None = 1) -> DataFrame:
    """Image addresses per item: the first one, or up to ``max_images`` (``None``: all)."""
    item = F.col("_item")
    images = _at(item, "$.images", "array<variant>")
    if max_images is not None:
        images = F.slice(images, 1, max_images)

    def address(image: Column) -> Column:
        return F.coalesce(
            F.nullif(_at(image, "$.url", "string"), F.lit("")),
            F.nullif(_at(image, "$.src", "string"), F.lit("")),
            F.when(F.schema_of_variant(image) == "STRING", F.nullif(_at(image, "$", "string"), F.lit(""))),
        )

    # Addresses are made before the list is unnested, or the filter would make each of them a second time.
    listed = F.posexplode(F.transform(images, address)).alias("image_index", "image_url")
    return (
        exploded_items(df, body)
        .select("auction_id", _at(item, "$.id", "long").alias("item_id"), listed)
        .filter(F.col("image_url").isNotNull())
    )


def enriched_auctions_from_documents(df: DataFrame, body: str = "body") -> DataFrame:
    """Category and flattened location; every location column is NULL when there is none."""
    doc = F.col(DOC)
    place = {c: _at(doc, f"$.approxLocation.{c}", "string") for c in ("city", "countryCode", "regionCode", "postalCode")}
    point = {c: _at(doc, f"$.approxLocation.latLng.{c}", "double") for c in ("lat", "lng")}
    return parsed(df, body).select(
        "auction_id",
        *[_at(doc, f"$.{c}", "string").alias(c) for c in ("type", "category", "displayRegion")],
        *[c.alias(f"approxLocation_{n}") for n, c in (place | point).items()],
    )


def _json_text(value: Column) -> Column:
    return F.when(~F.is_variant_null(value), F.to_json(value))


def enriched_items_from_documents(df: DataFrame, body: str = "body", default_id: str = "item_id") -> DataFrame:
    """Description fields as columns, and its lists and objects as JSON text."""
    doc = F.col(DOC)
    fields = [f"{c}: string" for c in DESCRIPTION_FIELDS] + [f"{c}: variant" for c in DESCRIPTION_JSON_FIELDS]
    # The description is read once for all of its fields, not once or twice for each.
    read = parsed(df, body).select(
        F.coalesce(_at(doc, "$.amLotId", "long"), F.col(default_id)).alias("amLotId"),
        _at(doc, "$.amAuctionId", "long").alias("amAuctionId"),
        _at(doc, "$.generatedDescription", f"struct<{', '.join(fields)}>").alias("_described"),
    )
    described = F.col("_described")
    return read.select(
        "amLotId",
        "amAuctionId",
        *[described[c].alias(c) for c in DESCRIPTION_FIELDS],
        *[_json_text(described[c]).alias(c) for c in DESCRIPTION_JSON_FIELDS],
    )


# ------------------------------------------------------------ nested records


def typed_documents(df: DataFrame, body: str = "body", keep: Sequence[str] = ()) -> DataFrame:
    """Documents under the declared schema, with the columns ``keep``; a missing field is NULL."""
    return df.select(*keep, F.from_json(F.col(body), AUCTION_DOCUMENT).alias("d")).select(*keep, "d.*")


def flat_records(docs: DataFrame) -> dict[str, DataFrame]:
    """The auction, item and bid tables of nested documents."""
    auctions = docs.select(
        "auction_id",
        "title",
        "auction_type",
        F.col("location.city").alias("city"),
        F.col("location.state").alias("state"),
        F.col("location.country").alias("country"),
        "start_time",
        "end_time",
        F.coalesce("num_items", F.lit(0)).alias("num_items"),
        F.coalesce("status", F.lit("unknown")).alias("status"),
    )
    exploded = docs.select("auction_id", F.explode("items").alias("i"))
    defaults = {"starting_bid": F.lit(0.0), "num_bids": F.lit(0).cast("long"), "has_bids": F.lit(False)}
    item_columns = [
        "lot_number",
        "title",
        "description",
        "category",
        "starting_bid",
        "winning_price",
        "num_bids",
        "num_bidders",
        "primary_image_url",
        "end_time",
        "has_bids",
    ]
    items = exploded.select(
        "i.item_id",
        "auction_id",
        *[(F.coalesce(F.col(f"i.{c}"), defaults[c]) if c in defaults else F.col(f"i.{c}")).alias(c) for c in item_columns],
    )
    bids = exploded.select("auction_id", "i.item_id", F.explode("i.bids").alias("b")).select(
        "b.bid_id",
        "item_id",
        "auction_id",
        "b.bidder_id",
        "b.amount",
        "b.bid_time",
        F.coalesce("b.is_winning", F.lit(False)).alias("is_winning"),
        F.coalesce("b.extended_auction", F.lit(False)).alias("extended_auction"),
    )
    return {"auctions": auctions, "items": items, "bids": bids}


def write_flat_records(
    docs: DataFrame, folder: str, batch: str, lines: str | None = None, more: Sequence[DataFrame] = ()
) -> dict[str, str]:
    """Three Parquet datasets from one parse of the documents, and the documents as JSON lines if ``lines`` says where.

    All of them lie on disk together with the parsed documents, so all are compressed well. ``more``
    are further documents: each frame is parsed in its turn, and only its own shuffles are there then.
    """
    with shuffles_dropped(docs.sparkSession):
        docs = written(docs, "parsed", compression="zstd", more=more)
    paths = {}
    for name, df in flat_records(docs).items():
        paths[name] = f"{folder}/{name}_{batch}"
        df.write.mode("overwrite").parquet(paths[name], compression="zstd")
    if lines is not None:
        write_documents(docs, lines, compression="gzip", level="FOUR")
    return paths


def write_documents(docs: DataFrame, path: str, compression: str = "none", level: str = "DEFAULT_COMPRESSION") -> None:
    """Nested documents as JSON lines, one file for each task; Spark reads compressed ones by their names.

    ``level`` is Hadoop's name of a level of gzip, up to ``BEST_COMPRESSION``.
    """
    docs.write.mode("overwrite").option("zlib.compress.level", level).json(path, compression=compression)


def collection_totals(requested: DataFrame, docs: DataFrame) -> DataFrame:
    """Requested, collected and failed auctions, and what was collected with them; an auction may have many documents."""
    items = F.coalesce(F.col("items"), F.array())
    fetched = docs.select(
        "auction_id",
        F.size(items).alias("items"),
        F.aggregate(
            items, F.lit(0), lambda n, i: n + F.coalesce(F.size(i["bids"]), F.lit(0))
        ).alias("bids"),
    )
    fetched = fetched.groupBy("auction_id").agg(*[F.sum(F.col(c).cast("long")).alias(c) for c in ("items", "bids")])
    return (
        requested.select("auction_id")
        .join(fetched, "auction_id", "left")
        .agg(
            F.count("*").alias("total"),
            F.count("items").alias("completed"),
            F.count_if(F.col("items").isNull()).alias("failed"),
            F.coalesce(F.sum("items"), F.lit(0)).alias("items_collected"),
            F.coalesce(F.sum("bids"), F.lit(0)).alias("bids_collected"),
        )
    )
