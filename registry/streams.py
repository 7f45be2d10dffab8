"""Streaming jobs, drained once over the event files and read back.

What a stream has emitted when it stops is what its watermark has passed: ten
minutes before the latest bid. The SQL says so in ``closed``.
"""

from __future__ import annotations

import time
import uuid

from pyspark.sql import functions as F
from pyspark.sql import types as T

from gavelworks.operators import summaries
from gavelworks.session import shared_dir, use_utc
from gavelworks.sources import bindings
from gavelworks.sources.tables import Tables
from gavelworks.streaming import bids as jobs
from gavelworks.streaming.features import causal_features
from gavelworks.streaming.sinks import BatchTable, LateRows, VersionedTable, enrich_batches, into_table, write_stream
from registry.auctions import END_US, bids_with_schedule
from registry.bids import BASE, FAR, GAPPED_BIDS, GROUP_SQL, joined_groups, with_gaps
from registry.common import AUCTIONS, BIDS, query, r, rounded, with_

CLOSED = "closed AS (SELECT (max(u) // 1000 - 600000) * 1000 AS w FROM bids)"


def bid_stream(spark, folder):
    """The event file as a stream of bids."""
    use_utc(spark)
    schema = spark.read.parquet(f"{folder}/events.parquet").schema
    events = spark.readStream.schema(schema).parquet(f"{folder}/event[s].parquet")
    return events.select(
        F.col("user_id").alias("item_id"),
        (F.col("user_id") % 10).alias("auction_id"),
        F.col("event_id").alias("bid_id"),
        F.timestamp_micros(F.expr("unix_micros(cast(ts as timestamp)) div 600")).alias("bid_time"),
        F.col("value").alias("bid_amount"),
        (F.col("event_type") == "purchase").cast("long").alias("is_proxy_bid"),
    )


def new_folder(spark):
    return f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"


def drained(spark, stream):
    """Run the stream to the end of what has arrived; its output as a table."""
    root = new_folder(spark)
    write_stream(stream, f"{root}/out", f"{root}/checkpoint").awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{root}/out")


@query("stream_deduplicated_bids", with_(BIDS) + f"SELECT item_id, bid_id, u AS bid_time, {r('bid_amount', 'bid_amount')} FROM bids")
def stream_deduplicated_bids(spark, folder):
    """Every bid arrives twice and leaves once."""
    twice = bid_stream(spark, folder).withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2)))).drop("copy")
    return rounded(drained(spark, jobs.deduplicated(twice)).drop("auction_id", "is_proxy_bid"), "item_id", "bid_id")


@query(
    "stream_window_counts",
    with_(BIDS, CLOSED)
    + """SELECT item_id, s AS window_start, s + 300000000 AS window_end, count(*) AS bids
      FROM (SELECT item_id, u // 60000000 * 60000000 - k * 60000000 AS s FROM bids, (SELECT unnest(range(0, 5)) AS k) o) t
      WHERE s + 300000000 <= (SELECT w FROM closed) GROUP BY 1, 2""",
)
def stream_window_counts(spark, folder):
    return rounded(drained(spark, jobs.window_counts(bid_stream(spark, folder))), "item_id")


@query(
    "stream_clusters",
    with_(BIDS, CLOSED)
    + f"""SELECT item_id, min(u) AS cluster_start, count(*) AS cluster_size FROM (
      SELECT item_id, u, sum(g) OVER {FAR} AS c FROM (
        SELECT *, CASE WHEN u - lag(u) OVER (PARTITION BY item_id ORDER BY u, bid_id) > 30000000 THEN 1 ELSE 0 END AS g FROM bids) a) b
      GROUP BY item_id, c HAVING max(u) + 30000000 <= (SELECT w FROM closed)""",
)
def stream_clusters(spark, folder):
    return rounded(drained(spark, jobs.clusters(bid_stream(spark, folder))), "item_id")


# Rank and median are not in the stream.
_ONLY_BATCH = "bid_amount_percentile_so_far, bid_amount_relative_to_median, bid_number"
_CAUSAL_SQL = f"""SELECT f.* EXCLUDE ({_ONLY_BATCH}), f.bid_number, u AS bid_us FROM ({joined_groups(GROUP_SQL)}) f
  JOIN base USING (bid_id) WHERE u < (SELECT w FROM closed)"""


@query("stream_causal_features", with_(BIDS, BASE, CLOSED) + _CAUSAL_SQL)
def stream_causal_features(spark, folder):
    """Every feature of the batch but rank and median."""
    return rounded(drained(spark, causal_features(bid_stream(spark, folder))), "item_id", "bid_id")


@query("stream_causal_features_with_gaps", with_(GAPPED_BIDS, BASE, CLOSED) + _CAUSAL_SQL)
def stream_causal_features_with_gaps(spark, folder):
    """The same where amounts and items are missing."""
    return rounded(drained(spark, causal_features(with_gaps(bid_stream(spark, folder)))), "item_id", "bid_id")


# The rule itself, bid by bid: the end moves with every bid in its last two minutes.
_FOLD = """WITH RECURSIVE {bids}, {closed},
  numbered AS (SELECT item_id, u, row_number() OVER (PARTITION BY item_id ORDER BY u, bid_id) AS n FROM bids WHERE {taken}),
  fold AS (
    SELECT item_id, CAST(0 AS BIGINT) AS n, max({end_us}) AS e, CAST(0 AS BIGINT) AS k FROM bids GROUP BY item_id
    UNION ALL
    SELECT f.item_id, f.n + 1, CASE WHEN b.u BETWEEN f.e - 120000000 AND f.e THEN {moved} + 120000000 ELSE f.e END,
      CASE WHEN b.u BETWEEN f.e - 120000000 AND f.e THEN f.k + 1 ELSE f.k END
    FROM fold f JOIN numbered b ON b.item_id = f.item_id AND b.n = f.n + 1),
  closes AS (SELECT item_id, arg_max(e, n) AS end_us, max(k) AS extensions FROM fold GROUP BY item_id)
"""


def fold_sql(mode: str, taken: str = "true") -> str:
    return _FOLD.format(
        bids=BIDS.strip(), closed=CLOSED, taken=taken, end_us=END_US, moved="b.u" if mode == "bid" else "f.e"
    )


def soft_closes(spark, folder, mode):
    """The last state of each item that was extended at all."""
    root = new_folder(spark)
    stream = bid_stream(spark, folder).withColumn("end", F.timestamp_micros(F.expr(END_US)))
    ends = jobs.soft_close_ends(stream, "end", mode)
    table = BatchTable(spark, f"{root}/out", "soft_close")
    into_table(ends, table, f"{root}/checkpoint", mode="update").awaitTermination()
    out = table.read(ends.schema)
    last = out.groupBy("item_id").agg(F.max_by("end_us", "extensions").alias("end_us"), F.max("extensions").alias("extensions"))
    return last.filter("extensions > 0")


_PASSED = "u < (SELECT w FROM closed)"


@query("stream_soft_close", fold_sql("bid", _PASSED) + "SELECT * FROM closes WHERE extensions > 0")
def stream_soft_close(spark, folder):
    return soft_closes(spark, folder, "bid")


@query("stream_soft_close_added", fold_sql("end", _PASSED) + "SELECT * FROM closes WHERE extensions > 0")
def stream_soft_close_added(spark, folder):
    return soft_closes(spark, folder, "end")


@query(
    "stream_enriched_bids",
    with_(BIDS, AUCTIONS)
    + f"""SELECT b.bid_id, b.auction_id, u AS bid_time, {r("bid_amount", "bid_amount")}, auction_title, auction_item_count,
        CAST(CASE WHEN auction_title IS NOT NULL THEN 1 END AS BIGINT) AS version
      FROM bids b LEFT JOIN auctions a ON b.auction_id = a.auction_id AND a.auction_id <> 4""",
)
def stream_enriched_bids(spark, folder):
    """Bids joined with the latest version of the auctions; every batch is delivered twice."""
    root = new_folder(spark)
    # One auction under a number that no bid has.
    number = F.when(F.col("auction_id") == 4, -4).otherwise(F.col("auction_id")).cast("long").alias("auction_id")
    auctions = bindings.auctions(spark, folder).select(number, "auction_title", "auction_item_count")
    static = VersionedTable(spark, f"{root}/auctions")
    static.publish(auctions.withColumn("auction_title", F.lit("an older title")))
    static.publish(auctions)
    table = BatchTable(spark, f"{root}/out", "enriched")
    bids = bid_stream(spark, folder)
    for delivery in range(2):  # a new checkpoint forgets what was done, the table does not
        enrich_batches(bids, static, table, f"{root}/checkpoint-{delivery}", limit=2000).awaitTermination()
    schema = T.StructType(
        [*bids.schema.fields, *static.read().drop("auction_id").schema.fields]
    )
    out = table.read(schema)
    return rounded(
        out.select("bid_id", "auction_id", "bid_time", "bid_amount", "auction_title", "auction_item_count", "version"), "bid_id"
    )


# When a bid arrives: in the run of its own time, or one or two runs later.
_RUN_US = 1_000_000_000
_DELAY = "CASE WHEN bid_id % 11 = 0 THEN 2 WHEN bid_id % 7 = 0 THEN 1 ELSE 0 END"


@query(
    "stream_late_bids",
    with_(BIDS)
    + f""", arriving AS (SELECT *, u // {_RUN_US} + {_DELAY} AS run FROM bids),
      runs AS (SELECT run, max(u) AS latest FROM arriving GROUP BY run),
      marks AS (SELECT run, coalesce((max(latest) OVER (ORDER BY run ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) // 1000
        - 600000) * 1000, 0) AS mark, row_number() OVER (ORDER BY run) AS number FROM runs)
      SELECT number AS run, count(*) AS arrived, count(*) FILTER (u <= mark) AS dropped, count(*) FILTER (u > mark) AS kept
      FROM arriving JOIN marks USING (run) GROUP BY number""",
)
def stream_late_bids(spark, folder):
    """What each run of the stream received, dropped as too late, and kept."""
    root = new_folder(spark)
    at = F.unix_micros("bid_time")
    batch = bindings.bids(spark, folder).select("item_id", "bid_id", "bid_time")
    arriving = batch.withColumn("run", F.expr(f"unix_micros(bid_time) div {_RUN_US}") + F.expr(_DELAY))
    arriving.write.partitionBy("run").parquet(f"{root}/arriving")
    runs = [row.run for row in arriving.select("run").distinct().orderBy("run").collect()]
    late = LateRows()
    spark.streams.addListener(late)
    table = BatchTable(spark, f"{root}/kept", "late")
    for run in runs:
        spark.read.schema(batch.schema).parquet(f"{root}/arriving/run={run}").write.parquet(f"{root}/source/run{run}")
        source = spark.readStream.schema(batch.schema).option("recursiveFileLookup", "true").parquet(f"{root}/source")
        query = into_table(jobs.deduplicated(source), table, f"{root}/checkpoint")
        query.awaitTermination()
    for _ in range(100):  # reports come a little after their batch
        if len(late.counts) >= len(runs):
            break
        time.sleep(0.1)
    spark.streams.removeListener(late)
    late.write(spark, f"{root}/late")
    counts = spark.read.parquet(f"{root}/late").filter(F.col("query") == str(query.id)).filter("arrived > 0")
    kept = table.read(batch.schema).groupBy("batch").agg(F.count("*").alias("kept"))
    numbered = counts.withColumn("run", F.expr("row_number() over (order by batch)").cast("long"))
    return numbered.join(kept, "batch", "left").select("run", "arrived", "dropped", F.coalesce("kept", F.lit(0)).alias("kept"))


@query("stream_in_chunks", with_(BIDS) + f"SELECT item_id, bid_id, u AS bid_time, {r('bid_amount', 'bid_amount')} FROM bids")
def stream_in_chunks(spark, folder):
    """A table scanned two files at a time, stopped in the middle of a batch and gone on with: each row once."""
    root = new_folder(spark)
    columns = ["item_id", "bid_id", "bid_time", "bid_amount"]
    bindings.bids(spark, folder).select(*columns).repartition(8).write.parquet(f"{root}/bids")
    known = Tables(spark, {"bids": f"{root}/bids"})
    table = BatchTable(spark, f"{root}/out", "scan")

    class Stopped(RuntimeError):
        pass

    def run(stop_in: int | None):
        def take(rows, batch):
            table.write(lambda: rows, batch)
            if batch == stop_in:  # written, and not yet known to the checkpoint
                raise Stopped

        query = (
            known.stream("bids", files_per_trigger=2)
            .writeStream.foreachBatch(take)
            .option("checkpointLocation", f"{root}/checkpoint")
            .trigger(availableNow=True)
            .start()
        )
        try:
            query.awaitTermination()
        except Exception:  # noqa: BLE001  the stop comes back as the stream's own failure
            if stop_in is None:
                raise

    run(stop_in=1)
    assert table.batches() == [0, 1]
    run(stop_in=None)
    assert table.batches() == [0, 1, 2, 3]
    return rounded(table.read(known.read("bids").schema).drop("batch"), "item_id", "bid_id")


_ENDS_SQL = "SELECT item_id, extensions AS soft_close_extensions, end_us AS actual_end_time FROM closes"


@query("soft_close_ends", fold_sql("bid") + _ENDS_SQL)
def soft_close_ends(spark, folder):
    """The batch's ends; the SQL takes bid by bid."""
    return rounded(summaries.soft_close(bids_with_schedule(spark, folder), "auction_end_time"), "item_id")


@query("soft_close_ends_added", fold_sql("end") + _ENDS_SQL)
def soft_close_ends_added(spark, folder):
    """The same where each extending bid adds two minutes to the end."""
    out = summaries.soft_close(bids_with_schedule(spark, folder), "auction_end_time", mode="end")
    return rounded(out, "item_id")
