"""Ordered running values per group, for groups of any size.

A window function brings a whole group to one task. That is right for nearly
every auction and item, and wrong for one that holds a large share of the
rows. ``split_by_size`` separates the two: ordinary groups go through Spark's
own windows, and oversized ones through ``chunked``, which range-sorts the
group across the cluster and numbers its rows, so later steps can work on
(group, chunk) with a small carry table.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gavelworks.session import written

# Rows of one group that a Python worker should hold.
GROUP_LIMIT = 100_000
# Rows of one group that a window function should sort in one task; it can spill.
WINDOW_LIMIT = 4_000_000
# Hash buckets of the quick look for oversized groups.
BUCKETS = 8192


class Split(NamedTuple):
    small: DataFrame
    large: DataFrame | None
    large_rows: int


def split_by_size(
    df: DataFrame, keys: Sequence[str], limit: int = WINDOW_LIMIT, sizes: DataFrame | None = None
) -> Split:
    """Rows of groups up to ``limit``, and rows of larger groups if there are any.

    Counting reads only the key columns. A first look counts hash buckets,
    which bound the groups in them and cost a few thousand rows of shuffle;
    only if a bucket is over the limit are the groups themselves counted. At
    most rows/limit groups can be large, so their list is short; AQE measures
    it and broadcasts it when it is. ``sizes`` may name a cheaper frame that
    has at least as many rows of every group as ``df``.
    """
    source = df if sizes is None else sizes
    bucket = F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)).alias("bucket")
    fullest = source.groupBy(bucket).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0]
    if (fullest or 0) <= limit:
        return Split(df, None, 0)
    counted = source.groupBy(*[F.col(k).alias(f"_large_{k}") for k in keys]).agg(F.count("*").alias("_rows"))
    large_keys = counted.filter(F.col("_rows") > limit)
    totals = large_keys.agg(F.count("*").alias("groups"), F.sum("_rows").alias("rows")).first()
    if not totals["groups"]:
        return Split(df, None, 0)
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_large_{k}")) for k in keys])
    return Split(df.join(large_keys, same, "left_anti"), df.join(large_keys, same, "left_semi"), totals["rows"])


def chunk_size(rows: int, limit: int = WINDOW_LIMIT) -> int:
    """Rows per chunk: at least ``limit``, and enough that chunks squared stay below rows."""
    return max(limit, math.isqrt(max(rows, 1)))


def sorted_runs(df: DataFrame, keys: Sequence[str], order: Sequence[Column], rows: int, chunk: int) -> DataFrame:
    """``df`` range-sorted by (keys, order) with its run in ``_run`` and its place in ``_at``.

    Spark samples the order to cut runs of about equal size, even inside one
    group. The result is written because the cuts must not be drawn again when
    several jobs read it.
    """
    parts = max(1, math.ceil(rows / chunk))
    by = [F.col(k).asc_nulls_first() for k in keys] + list(order)
    return written(
        df.repartitionByRange(parts, *by)
        .sortWithinPartitions(*by)
        .withColumn("_run", F.spark_partition_id())
        .withColumn("_at", F.monotonically_increasing_id()),
        "runs",
    )


def running_total(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    value: Column,
    out: str,
    rows: int,
    chunk: int,
) -> DataFrame:
    """Inclusive running total of ``value`` within oversized groups."""
    keys = list(keys)
    runs = sorted_runs(df.withColumn(out, value), keys, order, rows, chunk)
    carried = (
        runs.groupBy(*keys, "_run")
        .agg(F.sum(out).alias("_sum"))
        .withColumn(
            "_carry",
            F.sum("_sum").over(
                Window.partitionBy(*keys).orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)
            ),
        )
        .drop("_sum")
    )
    local = Window.partitionBy(*keys, "_run").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    same = reduce(lambda a, b: a & b, [F.col(f"r.{k}").eqNullSafe(F.col(f"c.{k}")) for k in [*keys, "_run"]])
    return (
        runs.withColumn("_local", F.sum(out).over(local))
        .alias("r")
        .join(carried.alias("c"), same, "left")
        .select(
            *[F.col(f"r.{c}") for c in df.columns if c != out],
            (F.col("_local") + F.coalesce(F.col("_carry"), F.lit(0))).alias(out),
        )
    )


def numbered(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], out: str, rows: int, chunk: int
) -> DataFrame:
    """1-based position of every row within its oversized group."""
    return running_total(df, keys, order, F.lit(1).cast("long"), out, rows, chunk)


def carried_in(summary: DataFrame, keys: Sequence[str], chunk: str, values: dict[str, Column]) -> DataFrame:
    """Per (group, chunk): each aggregate taken over all earlier chunks of the group."""
    earlier = Window.partitionBy(*keys).orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)
    return summary.select(*keys, chunk, *[v.over(earlier).alias(n) for n, v in values.items()])


def row_numbers(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    out: str,
    limit: int = WINDOW_LIMIT,
    sizes: DataFrame | None = None,
) -> DataFrame:
    """``row_number`` over groups of any size."""
    parts = split_by_size(df, keys, limit, sizes)
    done = parts.small.withColumn(
        out, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("long")
    )
    if parts.large is None:
        return done
    size = chunk_size(parts.large_rows, limit)
    return done.unionByName(numbered(parts.large, keys, order, out, parts.large_rows, size))


def grouped_median(
    df: DataFrame, keys: Sequence[str], value: str, out: str, limit: int = WINDOW_LIMIT
) -> DataFrame:
    """Exact median per group.

    Equal values are counted together before the shuffle, so a group costs one
    row per distinct value; groups with very many of those are ranked in runs.
    """
    keys = list(keys)
    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_n"))
    # Read for the totals, for the sizes and for either kind of group, so written once.
    counts = written(counts, "counts")
    totals = counts.groupBy(*keys).agg(F.sum("_n").alias("_total"))
    parts = split_by_size(counts, keys, limit)
    order = [F.col(value).asc()]
    running = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    ranked = parts.small.withColumn("_upto", F.sum("_n").over(running))
    if parts.large is not None:
        size = chunk_size(parts.large_rows, limit)
        large = running_total(
            parts.large.withColumn("_upto", F.col("_n")), keys, order, F.col("_n"), "_upto", parts.large_rows, size
        )
        ranked = ranked.unionByName(large.select(*ranked.columns))
    # Ranks of the two middle values (the same one when the total is odd).
    low, high = F.floor((F.col("_total") + 1) / 2), F.floor(F.col("_total") / 2) + 1
    covers = lambda rank: (F.col("_upto") - F.col("_n") < rank) & (rank <= F.col("_upto"))
    totals = totals.select(*[F.col(k).alias(f"_of_{k}") for k in keys], "_total")
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in keys])
    return (
        ranked.join(totals, same)
        .filter(covers(low) | covers(high))
        .groupBy(*keys)
        .agg(((F.min(value) + F.max(value)) / 2).alias(out))
    )


def with_previous(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    columns: dict[str, str],
    limit: int = WINDOW_LIMIT,
) -> DataFrame:
    """Values of the row before, as output name by source column, in groups of any size."""
    keys = list(keys)
    parts = split_by_size(df, keys, limit)
    w = Window.partitionBy(*keys).orderBy(*order)
    small = parts.small.withColumns({out: F.lag(c).over(w) for c, out in columns.items()})
    if parts.large is None:
        return small
    size = chunk_size(parts.large_rows, limit)
    placed = numbered(parts.large, keys, order, "_place", parts.large_rows, size)
    placed = written(placed.withColumn("_chunk", F.floor((F.col("_place") - 1) / size)), "placed")
    # The last row of a chunk is also shown to the next one.
    visits = F.when(F.col("_place") % size == 0, F.array("_chunk", F.col("_chunk") + 1)).otherwise(F.array("_chunk"))
    inside = Window.partitionBy(*keys, "_in").orderBy("_place")
    large = (
        placed.withColumn("_in", F.explode(visits))
        .withColumns({out: F.lag(c).over(inside) for c, out in columns.items()})
        .filter(F.col("_in") == F.col("_chunk"))
    )
    return small.unionByName(large.select(*small.columns))
