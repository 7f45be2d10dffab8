"""Documents to training tokens: five stages, each written as Parquet and read again by the next."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gavelworks.llm.digest_index import DigestIndex, without_copies
from gavelworks.llm.jaccard_join import one_of_each
from gavelworks.llm.mixture import mixed_documents
from gavelworks.llm.pieces import encode_checked
from gavelworks.llm.toxicity import score_toxicity
from gavelworks.llm.words import BATCH_BYTES, SMALL_BYTES
from gavelworks.session import arrow_batches, written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learnt from the table of labels, does not call toxic."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return score_toxicity(docs, labels).filter(F.col("score") < 0.5).select(docs.columns)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts equal but for the case of A-Z, the document with the largest id."""
    index = DigestIndex(spark, f"digest_index_{uuid.uuid4().hex}")
    kept = without_copies(docs, index, "corpus")
    index.drop()
    return kept


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a Jaccard similarity of 0.8 of their five-word shingles, the one with the smallest id."""
    return one_of_each(docs, words=5, per_hundred=80)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes, a row for each document and pass."""
    return mixed_documents(docs)


def to_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, source, tokens, n_tokens, lossless``: token ids, and whether they decode to the text."""
    found = encode_checked(docs.select("doc_id", "source", "text"), most=SMALL_BYTES)
    # Batches of ten thousand texts are held several times over beside the heap, so the tokens are made here, from small ones.
    with arrow_batches(spark, BATCH_BYTES):
        found = written(found, "tokens")
    return found.select("doc_id", "source", "tokens", F.size("tokens").cast("long").alias("n_tokens"), "lossless")


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_exact_copies),
    ("near_dedup", drop_near_copies),
    ("source_mix", mix_sources),
    ("pieces", to_tokens),
]

# The first stage is a trained classifier, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
