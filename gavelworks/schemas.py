"""Record schemas, and the rename-then-prefix rule of the landed tables."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class Naming:
    """How a landed table's fields become columns: rename first, then prefix."""

    prefix: str
    renames: dict[str, str] = field(default_factory=dict)
    unprefixed: tuple[str, ...] = ()

    def column(self, name: str) -> str:
        name = self.renames.get(name, name)
        return name if name in self.unprefixed else self.prefix + name

    def apply(self, df: DataFrame) -> DataFrame:
        return df.toDF(*[self.column(c) for c in df.columns])


KEYS = ("auction_id", "item_id")
# The renames and prefixes of each landed table.
AUCTIONS = Naming("auction_", {"catalog_lots": "item_count", "current_bid": "winning_price"})
ITEMS = Naming("item_", {}, ("auction_id",))
BIDS = Naming("bid_", {"time_of_bid": "time", "isproxy": "is_proxy"}, KEYS)
ENRICHED_AUCTIONS = Naming("enriched_auction_", {"amAuctionId": "auction_id", "amLotId": "item_id"}, KEYS)
ENRICHED_ITEMS = Naming("enriched_item_", {"amLotId": "item_id", "amAuctionId": "auction_id"}, KEYS)

# Fields read from each kind of document.
AUCTION_FIELDS = {
    "title": "string",
    "starts": "string",
    "ends": "string",
    "last_item_closes": "string",
    "removal_info": "string",
    "intro": "string",
    "pickup_time": "string",
    "partner_url": "string",
    "extended_bidding": "boolean",
    "extended_bidding_interval": "long",
    "extended_bidding_threshold": "long",
    "catalog_lots": "long",
}
ITEM_FIELDS = {
    "title": "string",
    "description": "string",
    "viewed": "long",
    "starting_bid": "double",
    "current_bid": "double",
    "proxy_bid": "double",
    "start_time": "string",
    "end_time": "string",
    "bid_count": "long",
    "bidding_extended": "boolean",
}
BID_FIELDS = {"time_of_bid": "string", "amount": "double", "isproxy": "boolean"}
DESCRIPTION_FIELDS = [
    "title",
    "slug",
    "description",
    "qualitativeDescription",
    "brand",
    "seriesLine",
    "condition",
    "working",
    "singleKeyItem",
    "numItems",
]
DESCRIPTION_JSON_FIELDS = ["brands", "categories", "items", "attributes", "photosTaken"]


def image_columns(df: DataFrame) -> DataFrame:
    """Stored image vectors: 32-bit floats, without the address."""
    out = df.withColumnRenamed("embedding", "image_embedding").drop("image_url")
    if "image_embedding" in out.columns:
        out = out.withColumn("image_embedding", F.col("image_embedding").cast("array<float>"))
    return out


_LOCATION = T.StructType([T.StructField(c, T.StringType()) for c in ("city", "state", "country", "postal_code")])
_BID = T.StructType(
    [
        T.StructField("bid_id", T.StringType()),
        T.StructField("bidder_id", T.StringType()),
        T.StructField("amount", T.DoubleType()),
        T.StructField("bid_time", T.TimestampType()),
        T.StructField("is_winning", T.BooleanType()),
        T.StructField("extended_auction", T.BooleanType()),
    ]
)
_ITEM = T.StructType(
    [
        T.StructField("item_id", T.LongType()),
        T.StructField("lot_number", T.IntegerType()),
        T.StructField("title", T.StringType()),
        T.StructField("description", T.StringType()),
        T.StructField("category", T.StringType()),
        T.StructField("starting_bid", T.DoubleType()),
        T.StructField("winning_price", T.DoubleType()),
        T.StructField("num_bids", T.LongType()),
        T.StructField("num_bidders", T.LongType()),
        T.StructField("primary_image_url", T.StringType()),
        T.StructField("end_time", T.TimestampType()),
        T.StructField("has_bids", T.BooleanType()),
        T.StructField("bids", T.ArrayType(_BID)),
    ]
)
# A nested auction document: auction -> items -> bids.
AUCTION_DOCUMENT = T.StructType(
    [
        T.StructField("auction_id", T.LongType()),
        T.StructField("title", T.StringType()),
        T.StructField("auction_type", T.StringType()),
        T.StructField("location", _LOCATION),
        T.StructField("start_time", T.TimestampType()),
        T.StructField("end_time", T.TimestampType()),
        T.StructField("num_items", T.LongType()),
        T.StructField("status", T.StringType()),
        T.StructField("items", T.ArrayType(_ITEM)),
    ]
)
