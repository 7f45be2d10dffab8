"""Faults that only larger or odder tables than the given ones show."""

from __future__ import annotations

import json
import random
import time
from datetime import datetime, timedelta
from pathlib import Path

import duckdb
import oracle
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from gavelworks.functions import jsons, text
from gavelworks.operators import bids, embeddings, long_items, scans
from gavelworks.sources import bindings, documents


def test_close_of_items_with_bids_of_zero(spark, tmp_path):
    """Some last bids, first bids and whole items are at zero."""
    amounts = {1: [0.0, 5.0, 3.0], 2: [4.0, 0.0], 3: [0.0, 0.0], 4: [7.5]}
    start = datetime(2024, 1, 1)
    rows = [(k * 10 + i, k, start + timedelta(hours=i), "bid", a) for k, v in amounts.items() for i, a in enumerate(v)]
    frame = spark.createDataFrame(rows, "event_id long, user_id long, ts timestamp_ntz, event_type string, value double")
    frame.coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    db = duckdb.connect()
    db.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    name = "bid_features_at_close"
    assert oracle.compare(spark, db, str(tmp_path), name, entry.queries()[name], entry.oracle_sql()[name]) == ""


@pytest.mark.parametrize("remove_numbers", [True, False])
def test_tokens_of_plain_texts_are_those_of_the_patterns(spark, remove_numbers):
    draw = random.Random(5)
    parts = ["Oak", "a", "12", "7_b", "x1", "the", "It's", "#", "_", " ", "\t", "\n", "\x1f", "\x00", ".", ",", "$9", "-", "<b>", "me@x", "http://a"]
    texts = ["".join(draw.choice(parts) + draw.choice(["", " ", "  "]) for _ in range(draw.randrange(9))) for _ in range(400)]
    frame = spark.createDataFrame([(t,) for t in texts], "t string")
    # A letter beyond ASCII sends a text through all patterns, and is itself too short to be a token.
    both = [text.tokens(c, remove_numbers=remove_numbers) for c in (F.col("t"), F.concat("t", F.lit(" \u00e9")))]
    for t, plain, through_patterns in frame.select("t", both[0].alias("a"), both[1].alias("b")).collect():
        # A hyphen at the very end is the one mark that what follows changes.
        assert plain == through_patterns or t.endswith("-"), t


def test_tokens_are_split_at_one_character(spark):
    """Spark hands other patterns to a split that compiles them for every row."""
    plan = spark.range(1).select(text.tokens(F.col("id").cast("string")))._jdf.queryExecution().optimizedPlan().toString()
    assert ",  , -1)" in plan and "\\s+, -1" not in plan


def test_json_that_only_a_lenient_reader_takes(spark):
    cases = {"[1, 2": (1, 1), "[1, 2] x": (2, 2), "['a', 'b']": (1, 1), "[1, 2]": (2, 2), " \n[1,2,3]\t": (3, 3), '{"a": 1} {': (1, 1),
             "{'a': 1, 'b': 2}": (1, 1), '{"a": 1, "b": 2}': (1, 2), '{"a": 1, "a": 2}': (1, 1), "[]": (0, 0), "{}": (1, 0), "[1]],[2": (1, 1)}
    frame = spark.createDataFrame([(t,) for t in cases], "t string")
    got = {r[0]: (r[1], r[2]) for r in frame.select("t", jsons.json_count(F.col("t")), jsons.json_count(F.col("t"), True)).collect()}
    assert got == cases


@pytest.mark.parametrize("frequent", [1, 3, 20, 4096])
def test_vectors_of_frequent_and_rare_words(spark, frequent):
    draw = random.Random(3)
    words = [(f"w{i}", [float(i), float(i * i)]) for i in range(12)]
    lists = [[draw.choice(["w0", "w0", "w1", "none", None] + [w for w, _ in words]) for _ in range(draw.randrange(7))] for _ in range(90)]
    rows = [(i // 2, i, t) for i, t in enumerate([*lists, None])]
    docs = spark.createDataFrame(rows, "auction_id long, item_id long, tokens array<string>")
    table = spark.createDataFrame([*words, ("w99", [1.0, 1.0])], "word string, vector array<float>")
    got = embeddings.document_vectors(docs, table, dimensions=2, broadcast_bytes=0, frequent=frequent).collect()
    known, want = dict(words), {}
    for _, item, listed in rows:
        met = [known[w] for w in listed or [] if w in known]
        want[item] = [sum(v[d] for v in met) / max(len(met), 1) for d in range(2)]
    assert len(got) == len(rows)
    for row in got:
        assert list(row.embedding) == pytest.approx(want[row.item_id], rel=1e-5), row


def test_frequent_words_bring_no_vectors_along(spark):
    docs = spark.createDataFrame([(i, i, ["oak", "chair"]) for i in range(40)], "auction_id long, item_id long, tokens array<string>")
    table = spark.createDataFrame([("oak", [1.0]), ("chair", [3.0])], "word string, vector array<float>")
    out = embeddings.document_vectors(docs, table, dimensions=1, broadcast_bytes=0)
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
    assert {r.embedding[0] for r in out.collect()} == {2.0}


def test_chunks_of_a_long_item_do_not_grow_with_the_callers_limit(spark, monkeypatch):
    limits = []
    chunked = long_items.chunked
    monkeypatch.setattr(long_items, "chunked", lambda *a: limits.append(a[-1]) or chunked(*a))
    monkeypatch.setattr(bids, "GROUP_LIMIT", 12)
    frame = spark.range(60).select(
        F.lit(1).alias("item_id"), F.col("id").alias("bid_id"), F.timestamp_seconds("id").alias("bid_time"), (F.col("id") * 7 % 11).cast("double").alias("bid_amount")
    )
    got = [
        sorted(map(tuple, bids.engineer_bid_features(frame, ["bid_id"], groups=["bid_amounts"], item_limit=n).select("bid_id", "bid_amount_relative_to_median").collect()))
        for n in (100, 50)
    ]
    assert limits == [12] and got[0] == got[1]


class Counted:
    """How often a column of a frame is worked out."""

    def __init__(self, spark):
        self.calls = spark.sparkContext.accumulator(0)

    def column(self, c, kind):
        calls = self.calls
        return F.udf(lambda x: calls.add(1) or x, kind).asNondeterministic()(c)


@pytest.mark.parametrize("limit", [5, 1000])
def test_medians_read_their_rows_once(spark, limit):
    counted = Counted(spark)
    rows = spark.range(1, 41, numPartitions=2).select((F.col("id") % 2).alias("k"), counted.column(F.col("id") * 1.0, "double").alias("v"))
    got = {r.k: r.m for r in scans.grouped_median(rows, ["k"], "v", "m", limit=limit).collect()}
    assert got == {0: 21.0, 1: 20.0} and counted.calls.value == 40


def test_nested_records_are_parsed_once(spark, tmp_path):
    counted = Counted(spark)
    bodies = [json.dumps({"auction_id": i, "items": [{"item_id": i, "bids": [{"bid_id": f"{i}-1", "amount": 1.0}]}]}) for i in range(7)]
    frame = spark.createDataFrame([(b,) for b in bodies], "body string").select(counted.column(F.col("body"), "string").alias("body"))
    paths = documents.write_flat_records(documents.typed_documents(frame), str(tmp_path), "b", lines=f"{tmp_path}/json")
    assert {name: spark.read.parquet(path).count() for name, path in paths.items()} == {"auctions": 7, "items": 7, "bids": 7}
    assert spark.read.text(f"{tmp_path}/json").count() == 7 and counted.calls.value == 7


def test_documents_as_compressed_lines(spark, tmp_path):
    frame = documents.typed_documents(spark.createDataFrame([(f'{{"auction_id": {i}, "title": "t"}}',) for i in range(500)], "body string"))
    sizes = {}
    for how in ("none", "gzip"):
        documents.write_documents(frame, f"{tmp_path}/{how}", compression=how)
        assert spark.read.schema(frame.schema).json(f"{tmp_path}/{how}").exceptAll(frame).isEmpty()
        sizes[how] = sum(f.stat().st_size for f in (tmp_path / how).glob("part-*"))
    assert sizes["gzip"] * 4 < sizes["none"]


def test_documents_read_once(spark):
    """A keyed object is read once, whatever keys it has, and an image's address is made once."""
    body = '{"auction": {"items": {"10": {"id": 3, "images": ["", "z"]}, "2": {"id": 2, "images": [{"src": "y"}]}, "x": {"id": 1}}}}'
    frame = spark.createDataFrame([(7, body)], "auction_id long, body string")
    listed = documents.items_from_documents(frame)
    assert [r.id for r in listed.collect()] == [1, 2, 3]
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    generate = next(line for line in plan(listed).splitlines() if "posexplode" in line)
    assert generate.count("MapType(StringType,VariantType") == 1
    images = documents.images_from_documents(frame, max_images=None)
    assert [(r.item_id, r.image_index, r.image_url) for r in images.collect()] == [(2, 0, "y"), (3, 1, "z")]
    assert plan(images).count("SchemaOfVariant.schemaOfVariant(") == 1


def shuffle_files(spark):
    blocks = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {f for f in blocks.mkString("\n").split("\n") if "/shuffle_" in f}


def test_nested_records_on_disk_are_compressed(spark, tmp_path):
    """The outputs lie beside the parsed documents, whose shuffle files are gone by then."""
    bodies = [json.dumps({"auction_id": i, "title": "t", "items": [{"item_id": i, "bids": [{"bid_id": f"{i}-1", "amount": 1.0}]}]}) for i in range(900)]
    frame = documents.typed_documents(spark.createDataFrame([(b,) for b in bodies], "body string").repartition(2, "body"))
    shares = [frame.filter(F.col("auction_id") % 2 == i) for i in range(2)]
    before = shuffle_files(spark)
    paths = documents.write_flat_records(shares[0], str(tmp_path / "out"), "b", lines=f"{tmp_path}/out/json", more=shares[1:])
    until = time.time() + 20
    while shuffle_files(spark) - before and time.time() < until:
        time.sleep(0.2)
    assert not shuffle_files(spark) - before
    parts = [f for path in paths.values() for f in Path(path).glob("part-*")]
    assert parts and all(".zstd." in f.name for f in parts)
    lines = [*(tmp_path / "out/json").glob("part-*")]
    assert sum(f.stat().st_size for f in lines) * 4 < sum(map(len, bodies))
    assert spark.read.schema(frame.schema).json(f"{tmp_path}/out/json").exceptAll(frame).isEmpty()
    assert {name: spark.read.parquet(path).count() for name, path in paths.items()} == dict.fromkeys(paths, 900)


@pytest.mark.parametrize("listed", ["once", "twice"])
def test_lines_stay_where_they_are_numbered(spark, tmp_path, listed):
    """Nested rows are not exchanged; parts that are listed twice, missing or null count as in the SQL."""
    draw = random.Random(3)
    day = datetime(2024, 1, 1)
    lines = [(draw.choice([*range(9), None]), draw.choice([*range(6), None]), draw.randrange(3), i, i * 1.25, day) for i in range(120)]
    part = [(k, n, "t", "b") for k, n in [(1, "a"), (2, None), (4, "b"), (None, "n"), (None, "m")] + [(4, "c"), (1, "a")] * (listed == "twice")]
    kind = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_extendedprice double, l_shipdate timestamp_ntz"
    spark.createDataFrame(lines, kind).coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame(part, "p_partkey long, p_name string, p_type string, p_brand string").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    db = duckdb.connect()
    db.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    db.execute(f"CREATE VIEW part AS SELECT * FROM '{tmp_path}/part.parquet/*.parquet'")
    for name in ("nested_items", "nested_records_written"):
        assert oracle.compare(spark, db, str(tmp_path), name, entry.queries()[name], entry.oracle_sql()[name]) == ""
    bodies = [sorted(r.body or "" for i in range(n) for r in bindings.nested_documents(spark, str(tmp_path), (i, n)).collect()) for n in (1, 3)]
    assert [len(b) for b in bodies[0]] == [len(b) for b in bodies[1]] and len(bodies[0]) == 10
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")
    try:
        plan = bindings.nested_documents(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set(key, before)
    assert plan.count("Exchange hashpartitioning(") == (3 if listed == "once" else 4)
