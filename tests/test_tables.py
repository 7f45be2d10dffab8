"""Documents, merges, files, pipelines."""

from __future__ import annotations

import json

import pytest
from rows import by
from pyspark.sql import functions as F

from gavelworks import schemas
from gavelworks.operators import joins
from gavelworks.operators.auctions import engineer_auction_features
from gavelworks.operators.items import engineer_item_features
from gavelworks.operators.predictions import add_fusion
from gavelworks.operators.splits import split_frames
from gavelworks.plans import pipelines
from gavelworks.sources import bindings, documents, tables

ITEM = {"id": 7, "title": "Lamp", "viewed": 3, "current_bid": 5.5, "bid_count": 2, "images": ["a", "b"]}


def docs(spark, *bodies):
    return spark.createDataFrame([(i + 1, b if isinstance(b, str) else json.dumps(b)) for i, b in enumerate(bodies)], "auction_id long, body string")


def test_document_shapes(spark):
    second = {"id": 8, "viewed": None, "images": 4}
    df = docs(
        spark,
        {"auction": {"title": "One", "items": [ITEM, second]}},
        {"auction": {"catalog_lots": 9, "items": {str(i): {"id": i, "viewed": 1} for i in range(12)}}},
        [ITEM],
        {"items": [second, "junk"]},
        {"auction": {}},
        "not json",
    )
    rows = by(documents.auctions_from_documents(df).collect(), "id")
    assert [r["catalog_lots"] for r in rows] == [2, 9, 1, 2, 0, 0]
    assert [r["total_viewed"] for r in rows] == [3, 12, 3, 0, 0, 0]
    assert [r["total_images"] for r in rows] == [6, 0, 2, 4, 0, 0]
    assert [r["title"] for r in rows] == ["One", None, None, None, None, None]
    order = documents.exploded_items(df.filter("auction_id = 2")).select(F.try_variant_get("_item", "$.id", "int")).collect()
    assert [r[0] for r in order] == list(range(12))


def test_image_counts(spark):
    forms = [["a", "b"], 5, "3", None, {"x": 1}, []]
    df = docs(spark, *[[{"id": 1, "images": f}] for f in forms])
    assert [r["number_of_images"] for r in by(documents.items_from_documents(df).collect(), "auction_id")] == [2, 5, 0, 0, 0, 0]


def test_bid_ids_count_down(spark):
    history = [{"time_of_bid": f"t{i}", "amount": i, "isproxy": i == 1} for i in range(3)]
    df = docs(spark, {"auction": {"items": {"0": {"id": 5, "bid_history": history}}}}, [{"id": 6, "bidHistory": history[:1]}], [{"id": 7}])
    rows = by(documents.bids_from_documents(df).collect(), "auction_id", "time_of_bid")
    assert [(r["item_id"], r["id"], r["count"]) for r in rows] == [(5, 3, 3), (5, 2, 3), (5, 1, 3), (6, 1, 1)]
    named = schemas.BIDS.apply(documents.bids_from_documents(df))
    assert named.columns == ["auction_id", "item_id", "bid_time", "bid_amount", "bid_is_proxy", "bid_id", "bid_count"]


def test_images(spark):
    df = docs(spark, [{"id": 1, "images": [{"url": "u"}, "v"]}, {"id": 2, "images": [{"url": "", "src": "s"}]}, {"id": 3, "images": [""]}, {"id": 4, "images": 2}])
    first = by(documents.images_from_documents(df).collect(), "item_id")
    assert [(r["item_id"], r["image_url"]) for r in first] == [(1, "u"), (2, "s")]
    assert documents.images_from_documents(df, max_images=None).count() == 3


def test_enriched_documents(spark):
    place = {"city": "Ottawa", "latLng": {"lat": 45.4, "lng": -75.7}}
    df = docs(spark, {"type": "x", "approxLocation": place}, {"type": "y"}, {"type": "z", "approxLocation": "n/a"})
    rows = by(documents.enriched_auctions_from_documents(df).collect(), "auction_id")
    assert [r["approxLocation_lat"] for r in rows] == [45.4, None, None]
    assert [r["approxLocation_city"] for r in rows] == ["Ottawa", None, None]
    item = {"amAuctionId": 3, "generatedDescription": {"title": "T", "brands": ["A"], "attributes": None, "numItems": 2}}
    got = documents.enriched_items_from_documents(docs(spark, item).withColumn("item_id", F.lit(44))).first()
    assert (got["amLotId"], got["title"], got["brands"], got["attributes"], got["numItems"]) == (44, "T", '["A"]', None, "2")


def test_names():
    assert [schemas.AUCTIONS.column(c) for c in ("id", "catalog_lots", "current_bid")] == ["auction_id", "auction_item_count", "auction_winning_price"]
    assert schemas.ITEMS.column("auction_id") == "auction_id" and schemas.ITEMS.column("id") == "item_id"
    assert schemas.ENRICHED_ITEMS.column("amLotId") == "item_id"


# -------------------------------------------------------------------- merges


def test_merges(spark):
    auctions = spark.createDataFrame([(1, 48, 10.0), (2, 24, 20.0), (3, 12, 30.0)], "auction_id long, hours long, price double")
    items = spark.createDataFrame([(1, 11, 5.0), (1, 12, 6.0), (9, 13, 7.0)], "auction_id long, item_id long, price double")
    merged = joins.merge_auctions_items(auctions, items)
    assert merged.columns == ["auction_id", "hours", "price_auction", "item_id", "price_item"]
    assert merged.count() == 5
    bids = spark.createDataFrame([(1, 11, 1, 2.0), (1, 11, 2, 3.0), (5, 50, 1, 4.0)], "auction_id long, item_id long, n int, hours double")
    left = joins.merge_bids(bids, merged)
    assert left.columns == ["auction_id", "item_id", "n", "hours_bid", "hours", "price_auction", "price_item"]
    assert left.count() == 3
    assert joins.merge_bids(bids, merged, "full").count() == 3 + 4
    assert joins.merge_auctions_items(auctions, items.drop("auction_id")).columns == ["item_id", "price"]
    with pytest.raises(ValueError, match="no common keys"):
        joins.merge_bids(bids.select("n"), merged)


def test_pipelines_write_and_resume(spark, data, tmp_path):
    paths = {n: str(tmp_path / n) for n in ("auctions", "enriched", "items", "described", "bids", "first", "out", "features", "auction_features", "item_features")}
    bindings.auctions(spark, data).write.parquet(paths["auctions"])
    bindings.enriched_auctions(spark, data).write.parquet(paths["enriched"])
    bindings.items(spark, data).write.parquet(paths["items"])
    bindings.enriched_items(spark, data).write.parquet(paths["described"])
    bids = bindings.bids(spark, data)
    bids.write.parquet(paths["bids"])
    bids.filter("item_id < 5").write.parquet(paths["first"])

    pipelines.bid_pipeline(spark, paths["bids"], paths["features"], tiebreak=["bid_id"])
    assert spark.read.parquet(paths["features"]).count() == bids.count()
    pipelines.auction_pipeline(spark, paths["auctions"], paths["enriched"], paths["auction_features"])
    pipelines.item_pipeline(spark, paths["items"], paths["described"], paths["item_features"])
    built = spark.read.parquet(paths["item_features"])
    assert built.columns[:2] == ["item_id", "auction_id"] and "item_title" not in built.columns
    assert spark.read.parquet(paths["auction_features"]).columns[0] == "auction_id"

    pipelines.combine_pipeline(spark, paths["auction_features"], paths["item_features"], paths["first"], paths["out"])
    before = spark.read.parquet(paths["out"]).count()
    spark.catalog.clearCache()
    pipelines.resume_combine(spark, paths["auction_features"], paths["item_features"], paths["bids"], paths["out"])
    done = tables.read_parquet(spark, paths["out"])
    assert before < done.count() == bids.count()
    assert done.columns[:2] == ["auction_id", "item_id"]


def test_text_pipeline(spark, data, tmp_path):
    bindings.items(spark, data).limit(400).write.parquet(str(tmp_path / "items"))
    words = pipelines.text_pipeline(spark, str(tmp_path / "items"), str(tmp_path / "out"), 8, epochs=1)
    out = spark.read.parquet(str(tmp_path / "out"))
    assert out.columns == ["auction_id", "item_id", "embedding"] and out.count() == 400
    assert out.select(F.size("embedding")).distinct().collect() == [(8,)] and words.count() > 5


def test_compaction_keeps_rows_and_globs_read_parts(spark, data, tmp_path):
    source, target = str(tmp_path / "many"), str(tmp_path / "few")
    orders = bindings.table(spark, data, "orders")
    orders.repartition(12).write.parquet(source)
    tables.compact(spark, source, target)
    read = tables.read_parquet(spark, target, files="*.parquet")
    assert read.count() == orders.count() and len(read.inputFiles()) < 12


def test_registered_tables_stream_and_take_parameters(spark, data):
    known = tables.Tables(spark, {"orders": f"{data}/orders.parquet"})
    known.register()
    one = known.sql("SELECT o_orderkey FROM orders WHERE o_orderkey = :k", {"k": 3})
    assert one.collect() == [(3,)]
    plan = one._sc._jvm.PythonSQLUtils.explainString(one._jdf.queryExecution(), "simple")
    assert "PushedFilters: [IsNotNull(o_orderkey), EqualTo(o_orderkey,3)]" in plan
    assert "ReadSchema: struct<o_orderkey:bigint>" in plan
    assert known.stream("orders").isStreaming


def test_final_tables_have_no_raw_text(spark, data):
    auctions = engineer_auction_features(bindings.auctions(spark, data), bindings.enriched_auctions(spark, data))
    assert "auction_fsa" not in auctions.columns and "auction_removal_info" not in auctions.columns
    rest = auctions.columns[1:]
    assert auctions.columns[0] == "auction_id" and rest == sorted(rest)
    items = engineer_item_features(bindings.items(spark, data), bindings.enriched_items(spark, data))
    assert "item_end_time" in items.columns and "item_closes" not in items.columns


def test_splits(spark, data):
    orders = bindings.table(spark, data, "orders")
    parts = [p.select("o_orderkey").toPandas()["o_orderkey"] for p in split_frames(orders, "o_orderkey")]
    assert sum(map(len, parts)) == orders.count() and not set(parts[0]) & set(parts[1])
    again = [p.count() for p in split_frames(orders.repartition(5), "o_orderkey")]
    assert again == [len(p) for p in parts]
    exact = split_frames(orders, "o_orderkey", stratify="o_orderstatus")[0].groupBy("o_orderstatus").count().collect()
    sizes = {r[0]: r[1] for r in orders.groupBy("o_orderstatus").count().collect()}
    assert all(abs(r[1] - 0.7 * sizes[r[0]]) <= 1 for r in exact)
    with pytest.raises(ValueError):
        split_frames(orders, "o_orderkey", ratios=(0.5, 0.1, 0.1))


def test_fusion(spark):
    df = spark.createDataFrame([(10.0, 20.0), (10.0, None), (None, None)], "a double, b double")
    rows = add_fusion(df, ["a", "b"]).collect()
    assert [r["predicted_price"] for r in rows] == [15, 10, 0]
    assert rows[0]["confidence_upper"] == pytest.approx(15 + 1.96 * 5)
    assert rows[1]["confidence_lower"] == pytest.approx(10 - 1.96 * 2)
    assert (rows[2]["confidence_lower"], rows[2]["confidence_upper"]) == (0, 0)


def test_collection_totals_of_orders_with_many_documents(spark, tmp_path):
    import duckdb
    from registry.documents import collection_totals
    from registry.common import ORACLE

    lots = [(1, n, 1, 1, 2.0) for n in range(1, 121)] + [(2, 1, 1, 1, 2.0), (3, 1, 1, 1, 2.0)]
    frames = {
        "orders": spark.createDataFrame([(k,) for k in (1, 2, 3, 4)], "o_orderkey long"),
        "part": spark.createDataFrame([(1, "n", "t", "b")], "p_partkey long, p_name string, p_type string, p_brand string"),
        "lineitem": spark.createDataFrame(
            lots, "l_orderkey long, l_linenumber long, l_partkey long, l_suppkey long, l_extendedprice double"
        ).withColumn("l_shipdate", F.lit("2020-01-01").cast("date")),
    }
    db = duckdb.connect()
    for name, frame in frames.items():
        frame.coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    (row,) = collection_totals(spark, str(tmp_path)).collect()
    cursor = db.execute(ORACLE["collection_totals"])
    assert row.asDict() == dict(zip([d[0] for d in cursor.description], cursor.fetchone()))
    assert (row.total, row.completed, row.failed, row.items_collected) == (4, 2, 2, 121)


def test_a_description_is_read_once(spark):
    """Every field comes from one read of the description, whatever stands in its place."""
    bodies = [
        '{"amLotId": 1, "amAuctionId": 2, "generatedDescription": {"title": "a", "numItems": 3, "brands": "x", "attributes": null, "items": [1, "b"]}}',
        '{"amAuctionId": "x", "generatedDescription": {"title": null, "brands": {"k": [1.50]}, "condition": {"a": 1}}}',
        '{"amLotId": 3, "generatedDescription": "none"}',
        '{"amLotId": 4, "generatedDescription": [{"title": "a"}]}',
        '{"amLotId": 5, "generatedDescription": null}',
        "[1]",
        "no json",
        None,
    ]
    frame = spark.createDataFrame([(10 + i, b) for i, b in enumerate(bodies)], "item_id long, body string")
    out = documents.enriched_items_from_documents(frame)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("try_variant_get") == 3
    names = ["amAuctionId", "title", "numItems", "condition", "brands", "attributes", "items", "photosTaken"]
    got = {r.amLotId: tuple(r[n] for n in names) for r in out.collect()}
    blank = (None,) * 8
    assert got == {
        1: (2, "a", "3", None, '"x"', None, '[1,"b"]', None),
        11: (None, None, None, '{"a":1}', '{"k":[1.5]}', None, None, None),
        **{i: blank for i in (3, 4, 5, 15, 16, 17)},
    }
