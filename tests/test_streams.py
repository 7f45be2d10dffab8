"""Streams fed in several files equal the batch, and late bids are dropped."""

from __future__ import annotations

import random
import time
from types import SimpleNamespace

import pandas as pd
import pytest
from pyspark.sql import functions as F
from rows import by

from gavelworks.operators.bids import engineer_bid_features
from gavelworks.operators.embeddings import embed_new_items
from gavelworks.operators.summaries import soft_close
from gavelworks.sources import bindings
from gavelworks.streaming import bids as jobs
from gavelworks.streaming.features import NOT_IN_STREAM, BidState, Running, causal_features
from gavelworks.streaming.sinks import BatchTable, LateRows, VersionedTable, enrich_batches, into_table, write_stream


@pytest.fixture(scope="module")
def landed(spark, data, tmp_path_factory):
    """Three files of bids, in order of time."""
    root = str(tmp_path_factory.mktemp("bids"))
    bids = bindings.bids(spark, data)
    for part in range(3):
        bids.filter(F.floor(F.col("bid_id") / 400) == part).coalesce(1).write.mode("append").parquet(root)
    return root


def stream(spark, path):
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(path)


@pytest.mark.parametrize("gaps", [False, True])
def test_features_across_batches_equal_the_batch(spark, landed, tmp_path, gaps):
    def gapped(bids):
        if not gaps:
            return bids
        return bids.withColumns(
            {
                "bid_amount": F.when(F.col("bid_id") % 5 != 0, F.col("bid_amount")),
                "item_id": F.when(F.col("item_id") % 3 != 0, F.col("item_id")),
                "bid_number": F.when(F.col("bid_id") % 7 != 0, F.col("bid_id") % 100),
            }
        )

    out = causal_features(gapped(stream(spark, landed)))
    write_stream(out, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    got = by(spark.read.schema(out.schema).parquet(str(tmp_path / "out")).collect(), "bid_id")
    batch = engineer_bid_features(gapped(spark.read.parquet(landed)), ["bid_id"])
    names = [c for c in batch.columns if c in out.columns]
    assert set(batch.columns) - set(names) == {"auction_id", "bid_time", "bid_amount", "is_proxy_bid", *NOT_IN_STREAM}
    want = {r["bid_id"]: r for r in batch.collect()}
    assert len(got) > 500
    for row in got:
        for name in names:
            assert row[name] == pytest.approx(want[row["bid_id"]][name]), (row["bid_id"], name)


def test_state_goes_when_items_end(spark, tmp_path):
    """What is left when the watermark has passed the items' ends is nothing, and a bid after an end is left out."""
    source = str(tmp_path / "in")

    def arrive(rows):
        spark.createDataFrame(rows, "item_id long, bid_id long, t long, amount double").select(
            "item_id",
            "bid_id",
            F.timestamp_seconds("t").alias("bid_time"),
            F.col("amount").alias("bid_amount"),
            F.timestamp_seconds(F.lit(2000)).alias("ends"),
        ).coalesce(1).write.mode("append").parquet(source)
        out = causal_features(stream(spark, source), "1 minute", "ends")
        query = write_stream(out, str(tmp_path / "out"), str(tmp_path / "check"))
        query.awaitTermination()
        return out, query.recentProgress[-1].stateOperators[0].numRowsTotal

    _, held = arrive([(i, i * 10 + n, 1000 + n, 5.0) for i in (1, 2) for n in range(3)])
    out, left = arrive([(1, 50, 10_000, 7.0)])
    assert held > 0 and left == 0
    rows = {r.bid_id: r.number_of_bids_so_far for r in spark.read.schema(out.schema).parquet(str(tmp_path / "out")).collect()}
    assert rows == {10: 1, 11: 2, 12: 3, 20: 1, 21: 2, 22: 3}


def test_an_item_takes_few_state_calls():
    """Each is a question to the executor: two for bids that come, three for those that fall due."""
    calls, held = [], []

    class Listed:
        def appendList(self, values):
            calls.append("append")
            held.extend(values)

        def put(self, values):
            calls.append("put")
            held[:] = values

        def get(self):
            calls.append("get")
            return iter(list(held))

    def none(*_):
        raise AssertionError("no state of its own")

    handle = SimpleNamespace(
        getListState=lambda *_: Listed(), getValueState=none, deleteTimer=none, registerTimer=lambda t: calls.append(t)
    )
    item = BidState(ends=False)
    item.init(handle)
    rows = [(n, n * 1_000_000, 5.0 + n if n % 3 else None, None, 2**60 + n if n % 2 else None) for n in range(8)]
    frames = pd.DataFrame(rows, columns=["bid_id", "bid_us", "bid_amount", "is_proxy_bid", "bid_number"], dtype="object")
    list(item.handleInputRows((0, 1), iter([frames.assign(end_ms=None)]), None))
    assert calls == ["append", 0]
    calls.clear()
    passed = SimpleNamespace(getCurrentWatermarkInMs=lambda: 6000)
    (out,) = item.handleExpiredTimer((0, 1), passed, None)
    assert calls == ["get", "put", 6000] and len(out) == 6
    calls.clear()
    passed = SimpleNamespace(getCurrentWatermarkInMs=lambda: 9000)
    (rest,) = item.handleExpiredTimer((0, 1), passed, None)
    assert calls == ["get", "put"] and len(rest) == 2
    # In two parts, by way of bytes, as in one.
    whole = Running(None)
    want = [whole.advance(row[1], row[2], row[4]) for row in rows]
    longs = [w for frame in (out, rest) for w in frame["longs"]]
    assert [w[0] for w in longs] == list(range(8)) and [w[2 + 2] for w in longs] == [w[0] for w in want]
    assert [w[3] for w in longs] == [row[4] for row in rows]
    again = Running(bytes(held[0][0]))
    assert again.state() == whole.state() and again.advance(10**7, 3.0, 1) == whole.advance(10**7, 3.0, 1)


def plain_closes(rows, mode):
    """End and extensions of each item, bid by bid."""
    out = {}
    for item, end in {r[0]: r[3] for r in rows}.items():
        count = 0
        for u in sorted(r[2] for r in rows if r[0] == item and r[2] is not None):
            if end is not None and end - 120 <= u <= end:
                end, count = (u if mode == "bid" else end) + 120, count + 1
        out[item] = (end, count)
    return out


@pytest.mark.parametrize("mode", ["bid", "end"])
def test_soft_close_of_random_items(spark, mode):
    """Bids on and around the edges of the last two minutes, many at once, missing times and ends."""
    draw = random.Random(7)
    rows = []
    for item in range(300):
        end = None if item % 17 == 0 else 10_000
        for bid in range(draw.randrange(1, 14)):
            at = draw.choice([9880, 10_000, 10_120, 10_240, 10_360, 9870, 9999, 10_001, draw.randrange(9800, 10_700), None])
            rows.append((item if item != 5 else None, bid, at, end))
    frame = spark.createDataFrame(rows, "item_id long, bid_id long, t long, e long").select(
        "item_id", "bid_id", F.timestamp_seconds("t").alias("bid_time"), F.timestamp_seconds("e").alias("close")
    )
    want = plain_closes(rows, mode)
    got = {
        r.item_id: (r.e, r.soft_close_extensions)
        for r in soft_close(frame, "close", mode=mode)
        .withColumn("e", F.unix_seconds("actual_end_time"))
        .collect()
    }
    if mode == "bid":  # its join back leaves items without a number as they were
        want.pop(None), got.pop(None)
    assert got == want


def test_soft_close_stream_without_end(spark, tmp_path):
    rows = [(1, 0, 950, None), (2, 0, 950, 1000), (2, 1, 5000, 1000)]
    bids = spark.createDataFrame(rows, "item_id long, bid_id long, t long, e long").select(
        "item_id", "bid_id", F.timestamp_seconds("t").alias("bid_time"), F.timestamp_seconds("e").alias("close")
    )
    bids.coalesce(1).write.parquet(str(tmp_path / "in"))
    out = jobs.soft_close_ends(stream(spark, str(tmp_path / "in")), "close", "end", "1 minute")
    table = BatchTable(spark, str(tmp_path / "out"), "close")
    into_table(out, table, str(tmp_path / "check"), mode="update").awaitTermination()
    got = {r.item_id: (r.end_us, r.extensions) for r in table.read(out.schema).collect()}
    assert got == {1: (None, 0), 2: (1120 * 10**6, 1)}


def test_batches_are_taken_once(spark, tmp_path):
    table = BatchTable(spark, str(tmp_path / "t"), "app")
    rows = spark.range(5)
    assert table.write(lambda: rows, 0) and not table.write(lambda: 1 / 0, 0)
    # One that died before it was committed is written whole.
    rows.write.parquet(table.folder(1))
    (tmp_path / "t" / "app=app" / "batch=1" / "_SUCCESS").unlink()
    assert table.batches() == [0] and table.read(rows.schema).count() == 5
    assert table.write(lambda: rows.limit(2), 1)
    assert table.batches() == [0, 1] and table.read(rows.schema).count() == 7
    assert BatchTable(spark, str(tmp_path / "none"), "app").read(rows.schema).count() == 0


def test_enrichment_takes_the_latest_version(spark, landed, tmp_path):
    static = VersionedTable(spark, str(tmp_path / "static"))
    with pytest.raises(ValueError, match="no version"):
        static.read()
    names = spark.createDataFrame([(i, "old") for i in range(9)], "auction_id long, title string")
    assert static.publish(names) == 0
    assert static.publish(names.withColumn("title", F.lit("new"))) == 1
    assert static.publish(names.filter("false"), 1) == 1
    table = BatchTable(spark, str(tmp_path / "out"), "enriched")
    source = stream(spark, landed)
    for check in ("a", "b"):
        enrich_batches(source, static, table, str(tmp_path / check), limit=50).awaitTermination()
    columns = [*source.schema.fields, *static.read().drop("auction_id").schema.fields]
    rows = table.read(type(source.schema)(columns)).collect()
    assert len(rows) == spark.read.parquet(landed).count() == len({r.bid_id for r in rows})
    assert {(r.title, r.version) for r in rows if r.auction_id != 9} == {("new", 1)}
    assert {(r.title, r.version) for r in rows if r.auction_id == 9} == {(None, None)}


def test_soft_close_modes(spark, tmp_path):
    rows = [(1, i, t) for i, t in enumerate([900, 990, 1100, 1300, 5000])]
    bids = spark.createDataFrame(rows, "item_id long, bid_id long, t long").select(
        "item_id", "bid_id", F.timestamp_seconds("t").alias("bid_time"), F.timestamp_seconds(F.lit(1000)).alias("close")
    )
    # One file, so that no bid arrives behind the watermark.
    bids.coalesce(1).write.parquet(str(tmp_path / "in"))
    ends = {}
    for mode in ("bid", "end"):
        name = f"ends_{mode}"
        out = jobs.soft_close_ends(stream(spark, str(tmp_path / "in")), "close", mode, "1 minute")
        query = out.writeStream.outputMode("update").format("memory").queryName(name).trigger(availableNow=True).start()
        query.awaitTermination()
        ends[mode] = tuple(spark.table(name).agg(F.max("end_us") / 1e6, F.max("extensions")).first())
    # Bids at 900, 990 and 1100 each extend to two minutes after themselves; the one at 1300 is too late.
    assert ends["bid"] == (1220, 3)
    # Adding two minutes to the end each time: 1000 -> 1120; 990 is before its last two minutes, 1100 is not.
    assert ends["end"] == (1240, 2)


def test_late_bids_are_dropped_and_counted(spark, tmp_path):
    source = str(tmp_path / "in")
    late = LateRows()
    spark.streams.addListener(late)
    for minute in (60, 0):
        spark.createDataFrame([(1, minute, minute * 60)], "item_id long, bid_id long, t long").select(
            "item_id", "bid_id", F.timestamp_seconds("t").alias("bid_time")
        ).coalesce(1).write.mode("append").parquet(source)
        query = write_stream(jobs.deduplicated(stream(spark, source)), str(tmp_path / "out"), str(tmp_path / "check"))
        query.awaitTermination()
    for _ in range(100):  # progress reports arrive on a thread of their own
        if late.dropped.get(str(query.id)):
            break
        time.sleep(0.1)
    spark.streams.removeListener(late)
    assert late.dropped == {str(query.id): 1}
    assert [r["bid_id"] for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [60]


def test_new_items_are_embedded_once(spark, data, tmp_path):
    """The batch counterpart of resuming: only items without a vector are added."""
    items = bindings.items(spark, data).select("item_id", "auction_id", "item_title", "item_description")
    words = spark.createDataFrame([("small", [1.0, 0.0]), ("red", [0.0, 1.0])], "word string, vector array<float>")
    path = str(tmp_path / "vectors")
    embed_new_items(items.filter("item_id < 1000"), words, None, path, 2)
    first = spark.read.parquet(path)
    assert first.count() == items.filter("item_id < 1000").count()
    embed_new_items(items, words, first, path, 2)
    after = spark.read.schema(first.schema).parquet(path)
    assert after.count() == items.count() == after.select("item_id").distinct().count()


def test_enrichment_needs_a_common_key(spark, landed):
    with pytest.raises(ValueError, match="no common keys"):
        jobs.enriched(stream(spark, landed), spark.createDataFrame([(1,)], "x int"))
