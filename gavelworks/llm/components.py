"""Connected components of a link table, by alternating stars.

Each round points every neighbour of a node at the smallest one known, first among larger neighbours and then among
smaller ones. Rounds grow with the logarithm of the longest chain; each one is two aggregates and joins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gavelworks.session import written


def _smallest(pairs: DataFrame) -> DataFrame:
    """``(u, v)`` with ``m``, the smallest of ``u`` and all its ``v``."""
    lowest = pairs.groupBy("u").agg(F.min("v").alias("m"))
    return pairs.join(lowest.select("u", F.least("u", "m").alias("m")), "u")


def components(links: DataFrame) -> DataFrame:
    """``node, component`` for every node of ``a, b``; the component is its smallest node."""
    edges = written(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _smallest(both).filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.filter(F.col("u") != F.col("v")).distinct()
        near = _smallest(large)
        small = near.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            near.select("u", F.col("m").alias("v"))
        )
        edges = written(small.filter(F.col("u") != F.col("v")).distinct(), "edges")
        # All stars: no centre points further.
        if edges.select("v").distinct().join(edges.select(F.col("u").alias("v")), "v", "left_semi").isEmpty():
            break
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return written(edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots), "components")
