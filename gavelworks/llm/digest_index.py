"""Exact deduplication against a persistent digest index.

The index is a table bucketed and sorted by the digest of the normalised text. A batch is reduced to one row per
digest, anti-joined with the index (whose side of the sort-merge join needs no exchange) and appended.

Defined results: a null text counts as the empty text, so null and empty rows are copies of each other. Equal texts are
those identical after lower-casing A-Z alone. Of equal texts in one batch the largest ``doc_id`` stays; rows that repeat
the id that stays are all marked kept. A null ``doc_id`` is below every other and is kept only where its whole group has
no id. An empty table gives an empty result and leaves the index as it was. Only the two named columns are read, so
further columns may have any name.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gavelworks.session import written


def normalised(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)


def digest(text: Column) -> Column:
    """SHA-256 of the normalised text in UTF-8, as 32 bytes."""
    return F.unhex(F.sha2(normalised(text), 256))


class DigestIndex:
    """Digests seen so far: ``digest, keep_id, batch``, each digest once."""

    def __init__(self, spark: SparkSession, table: str, buckets: int = 0):
        self.spark, self.table = spark, table
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def exists(self) -> bool:
        return self.spark.catalog.tableExists(self.table)

    def read(self) -> DataFrame:
        return self.spark.table(self.table)

    def append(self, groups: DataFrame, batch: str) -> None:
        """Add the digests of ``groups`` that the index lacks. Running a batch again adds nothing."""
        rows = groups.select("digest", "keep_id", F.lit(batch).alias("batch"))
        if self.exists():
            rows = rows.join(self.read().select("digest"), "digest", "left_anti")
        # One file per bucket: rows arrive dealt and sorted as the table keeps them.
        rows = rows.repartition(self.buckets, "digest").sortWithinPartitions("digest")
        writer = rows.write.format("parquet").mode("append").bucketBy(self.buckets, "digest").sortBy("digest")
        writer.saveAsTable(self.table)

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")

    def deduplicate(self, docs: DataFrame, batch: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
        """Index ``docs`` and return ``doc_id, digest, keep_id, group_size, kept`` for every row.

        ``keep_id`` names the row that stays, which for a digest of an earlier
        batch is a row of that batch; then no row of this one is kept.
        """
        seen = written(docs.select(F.col(doc_id).alias("doc_id"), digest(F.col(text)).alias("digest")), "digests")
        groups = seen.groupBy("digest").agg(
            F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")
        )
        self.append(groups, batch)
        owners = self.read().select("digest", F.col("keep_id").alias("owner"), (F.col("batch") == batch).alias("new"))
        # Written, so that both sides of the last join are dealt out by Spark and a digest with many rows is split.
        decided = written(
            groups.join(owners, "digest").select("digest", F.col("owner").alias("keep_id"), "group_size", "new"),
            "decided",
        )
        kept = F.col("new") & F.col("doc_id").eqNullSafe(F.col("keep_id"))
        return seen.join(decided, "digest").select("doc_id", "digest", "keep_id", "group_size", kept.alias("kept"))


def without_copies(docs: DataFrame, index: DigestIndex, batch: str) -> DataFrame:
    """The rows of ``docs`` that stay, with their columns."""
    copies = index.deduplicate(docs, batch).filter(~F.col("kept"))
    copies = copies.select(F.col("doc_id").alias("_copy"), F.col("digest").alias("_digest")).distinct()
    same = docs["doc_id"].eqNullSafe(copies["_copy"]) & (digest(docs["text"]) == copies["_digest"])
    return docs.join(copies, same, "left_anti").select(docs.columns)
