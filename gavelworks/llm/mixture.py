"""Mixing sources to target weights by a low-discrepancy schedule.

Every source is a line of its shuffled documents' words, cut into blocks of equal length. The mix is a sequence of
slots; slot ``k`` takes the van der Corput point of ``k``, maps it through the cumulative slot counts of the sources to
a source, and takes that source's next block, beginning again at its first when all are taken. Any stretch of the mix is
therefore close to the target weights, and over all slots the counts are exact.

Defined results: a null text has size 0; a null source is a source of its own, last in order. Sources of size 0 have
target 0 and take nothing. Repeated rows are rows of their own. Without words every target and ``taken`` is 0; an empty
table gives an empty result. Only the three named columns are read. Equal input rows give equal output on every run.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gavelworks.operators.scans import WINDOW_LIMIT, chunk_size, running_total, split_by_size
from gavelworks.session import written

WORD = r"[^\x20\x09-\x0D]+"
# Slots, and marks of source beginnings, that one window task sorts together.
CHUNK_BITS = 12
# Words in a block of a large source; a small source still has this many blocks.
BLOCK_WORDS = 4096
LEAST_BLOCKS = 256
# Hash chunks of a source's shuffled order.
ORDER_CHUNKS = 4096


def words_in(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _running(df: DataFrame, order: str, value: str, out: str) -> DataFrame:
    """Inclusive running total over the whole frame; in runs across the cluster when it is long."""
    df = df.withColumn("_all", F.lit(0))
    parts = split_by_size(df, ["_all"])
    if parts.large is None:
        w = Window.partitionBy("_all").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
        return df.withColumn(out, F.sum(value).over(w)).drop("_all")
    size = chunk_size(parts.large_rows, WINDOW_LIMIT)
    return running_total(
        df.withColumn(out, F.col(value)), ["_all"], [F.col(order)], F.col(value), out, parts.large_rows, size
    ).drop("_all")


def source_targets(
    sizes: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, most: float = 2.0
) -> DataFrame:
    """``source, sid, source_size, target`` from ``source, size`` rows.

    Sources in code point order, null last, take the weights in turn. A target
    is the source's weighted part of ``share`` times all words, at most
    ``most`` times its own; what is over is shared again among the others.
    Each step of that costs one aggregate over the short table of sources.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    # A struct orders null first, so its flag puts the null source last.
    totals = written(totals.withColumn("_by", F.struct(F.col("source").isNull(), "source")), "sources")
    ranked = _running(totals.withColumn("_one", F.lit(1).cast("long")), "_by", "_one", "sid")
    pick = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("sid") - 1).cast("int") % len(weights) + 1)
    ranked = written(ranked.select("source", "source_size", (F.col("sid") - 1).alias("sid"), pick.alias("w")), "sources")
    total = ranked.agg(F.sum("source_size")).first()[0] or 0
    level, capped = 0.0, -1
    while total:
        over = F.col("source_size") * most <= F.lit(level) * F.col("w")
        row = ranked.agg(
            F.count_if(over).alias("n"),
            F.sum(F.when(over, F.col("source_size")).otherwise(0)).alias("held"),
            F.sum(F.when(over, 0.0).otherwise(F.col("w"))).alias("w"),
        ).first()
        if row["n"] == capped or not row["w"]:
            break
        capped, level = row["n"], (share * total - most * row["held"]) / row["w"]
    target = F.least(F.col("source_size") * F.lit(float(most)), F.lit(level) * F.col("w"))
    return ranked.select("source", "sid", "source_size", target.alias("target"))


def _bits_reversed(n: Column) -> Column:
    """The 64 bits of ``n`` in reverse: the van der Corput point as a whole number."""
    for shift, mask in (
        (1, 0x5555555555555555),
        (2, 0x3333333333333333),
        (4, 0x0F0F0F0F0F0F0F0F),
        (8, 0x00FF00FF00FF00FF),
        (16, 0x0000FFFF0000FFFF),
        (32, 0x00000000FFFFFFFF),
    ):
        m = F.lit(mask).cast("long")
        n = F.shiftrightunsigned(n, shift).bitwiseAND(m).bitwiseOR(F.shiftleft(n.bitwiseAND(m), shift))
    return n


def schedule(sources: DataFrame) -> DataFrame:
    """``slot, sid, block, epoch`` from ``sid, blocks, slots``.

    Points are whole numbers below a power of two, each once, so a source whose
    interval is ``slots`` long gets that many.
    """
    spark = sources.sparkSession
    ends = written(_running(sources.filter(F.col("slots") > 0), "sid", "slots", "_end"), "intervals")
    total = ends.agg(F.max("_end")).first()[0] or 0
    bits = max(1, (total - 1).bit_length())
    chunk = lambda c: F.shiftright(c, CHUNK_BITS)
    begin = F.col("_end") - F.col("slots")
    # Where a source begins, and again where each later chunk of points begins inside it.
    marks = (
        ends.withColumn("chunk", F.explode(F.sequence(chunk(begin), chunk(F.col("_end") - 1))))
        .withColumn("at", F.greatest(begin, F.shiftleft("chunk", CHUNK_BITS)))
        .select("chunk", "at", F.struct("sid", "blocks").alias("source"), F.lit(None).cast("long").alias("slot"))
    )
    point = F.shiftrightunsigned(_bits_reversed(F.col("id")), 64 - bits)
    points = spark.range(1 << bits if total else 0).select(F.col("id").alias("slot"), point.alias("at"))
    points = points.filter(F.col("at") < total).select(
        chunk(F.col("at")).alias("chunk"), "at", F.lit(None).cast("struct<sid:bigint,blocks:bigint>").alias("source"), "slot"
    )
    place = Window.partitionBy("chunk").orderBy("at", F.col("slot").asc_nulls_first())
    drawn = (
        marks.unionByName(points)
        .withColumn("source", F.last("source", ignorenulls=True).over(place))
        .filter(F.col("slot").isNotNull())
        .select("slot", "source.sid", "source.blocks", chunk(F.col("slot")).alias("stretch"))
    )
    # Rank within the source: the slots of earlier stretches, then the place in this one.
    drawn = written(drawn, "slots")
    earlier = Window.partitionBy("sid").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    before = (
        drawn.groupBy("sid", "stretch")
        .agg(F.count(F.lit(1)).alias("n"))
        .select("sid", "stretch", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    )
    inside = Window.partitionBy("sid", "stretch").orderBy("slot")
    ranked = drawn.withColumn("rank", F.row_number().over(inside) - 1).join(before, ["sid", "stretch"])
    rank = F.col("before") + F.col("rank")
    return ranked.select(
        "slot", "sid", F.pmod(rank, F.col("blocks")).alias("block"), F.floor(rank / F.col("blocks")).alias("epoch")
    )


def blocks(sized: DataFrame, sources: DataFrame, seed: int) -> DataFrame:
    """Rows of ``sized`` (``doc_id, source, size, key``) with their place ``start`` in the shuffled words of their source."""
    rows = (
        sized.alias("d")
        .join(sources.alias("s"), F.col("d.source").eqNullSafe(F.col("s.source")))
        .select("d.doc_id", "d.size", "d.key", "s.sid", "s.source_size", "s.target", "s.block_words")
        .withColumn("_hash", F.xxhash64(F.col("doc_id"), F.lit(seed)))
        .withColumn("_chunk", F.pmod(F.col("_hash"), F.lit(ORDER_CHUNKS)))
    )
    earlier = Window.partitionBy("sid").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    before = (
        rows.groupBy("sid", "_chunk")
        .agg(F.sum("size").alias("n"))
        .select("sid", "_chunk", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("_before"))
    )
    inside = Window.partitionBy("sid", "_chunk").orderBy("_hash", "doc_id", "size", "key")
    upto = F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0))
    return (
        rows.withColumn("_row", F.row_number().over(inside))
        .withColumn("_upto", upto)
        .join(before, ["sid", "_chunk"])
        .withColumn("start", F.col("_before") + F.col("_upto") - F.col("size"))
        .drop("_before", "_upto", "_hash")
    )


def mix(
    docs: DataFrame,
    weights: Sequence[float] = (5, 2, 1),
    share: float = 1.5,
    most: float = 2.0,
    seed: int = 17,
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
) -> tuple[DataFrame, DataFrame]:
    """The words each row gives to the mix, and the schedule of blocks.

    The first frame is ``doc_id, size, source_size, target, taken, key, passes``:
    a source is gone through from its beginning as often as needed, so what the
    mix takes of a row is its first ``passes[0]`` words, then its first
    ``passes[1]`` and so on. ``key`` is a hash of the text. The second frame is
    ``slot, sid, block, epoch``, whose blocks cut the lines of ``blocks``.
    """
    sized = written(
        docs.select(
            F.col(doc_id).alias("doc_id"),
            F.col(source).alias("source"),
            words_in(F.col(text)).alias("size"),
            F.xxhash64(F.col(text)).alias("key"),
        ),
        "sizes",
    )
    size, target = F.col("source_size"), F.col("target")
    length = F.greatest(F.lit(1), F.least(F.lit(BLOCK_WORDS), F.floor(size / LEAST_BLOCKS))).cast("long")
    sources = source_targets(sized, weights, share, most).withColumn("block_words", length)
    sources = sources.withColumn("blocks", F.ceil(size / F.col("block_words")).cast("long"))
    most_slots = F.floor(F.col("blocks") * F.lit(float(most))).cast("long")
    sources = written(
        sources.withColumn("slots", F.least(F.round(target / F.col("block_words")).cast("long"), most_slots)),
        "targets",
    )
    slots = written(schedule(sources.select("sid", "blocks", "slots")), "schedule")
    times = slots.groupBy("sid", "block").agg(F.count(F.lit(1)).alias("times"))
    rows = blocks(sized, sources, seed)
    step, first = F.col("block_words"), F.col("start")
    last = F.floor((first + F.col("size") - 1) / step).cast("long")
    span = F.when(F.col("size") > 0, F.sequence(F.floor(first / step).cast("long"), last))
    pieces = rows.withColumn("block", F.explode_outer(span))
    low, high = F.col("block") * step, (F.col("block") + 1) * step
    inside = F.least(first + F.col("size"), high) - F.greatest(first, low)
    taken = (
        pieces.withColumn("words", inside)
        .join(times, ["sid", "block"], "left")
        .groupBy("sid", "_chunk", "_row", "doc_id", "key", "size", "source_size", "target")
        .agg(
            F.coalesce(F.sum(F.col("words") * F.col("times")), F.lit(0)).cast("long").alias("taken"),
            F.array(
                *[
                    F.sum(F.when(F.col("times") > e, F.col("words")).otherwise(0)).cast("long")
                    for e in range(math.ceil(most))
                ]
            ).alias("passes"),
        )
        .select("doc_id", "size", "source_size", "target", "taken", "key", "passes")
    )
    return taken, slots


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that the mix takes, with their columns, once for each pass over their source.

    A row that a pass takes only the first words of has those words, joined by
    blanks, as its text, and ``n_chars``, where there is such a column, counts
    its text again. Rows that repeat both id and text give what the first gives.
    """
    takes = mix(docs, **options)[0].filter(F.col("taken") > 0)
    takes = takes.groupBy(F.col("doc_id").alias("_id"), F.col("key").alias("_key")).agg(
        F.min(F.struct("size", "passes")).alias("_take")
    )
    keyed = docs.withColumn("_hash", F.xxhash64("text"))
    rows = keyed.join(takes, keyed["doc_id"].eqNullSafe(takes["_id"]) & (keyed["_hash"] == takes["_key"]))
    rows = rows.withColumn("_pass", F.explode("_take.passes")).filter(F.col("_pass") > 0)
    some = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(WORD), F.lit(0)), F.lit(1), F.col("_pass").cast("int")), " ")
    rows = rows.withColumn("text", F.when(F.col("_pass") == F.col("_take.size"), F.col("text")).otherwise(some))
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return rows.select(docs.columns)
