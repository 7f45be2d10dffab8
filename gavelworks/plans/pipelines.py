"""The flows end to end: read, build, write."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from gavelworks.operators.auctions import engineer_auction_features
from gavelworks.operators.bids import engineer_bid_features
from gavelworks.operators.embeddings import (
    DIMENSIONS,
    document_vectors,
    item_tokens,
    train_word_vectors,
    training_corpus,
)
from gavelworks.operators.items import engineer_item_features
from gavelworks.operators.joins import merge_auctions_items, merge_bids, not_done
from gavelworks.sources.areas import area_lookup, clean_population, clean_tax
from gavelworks.sources.tables import read_parquet, write_combined, write_parquet


def bid_pipeline(spark: SparkSession, source: str, target: str, **options) -> None:
    """Bid features of a landed bid dataset."""
    write_parquet(engineer_bid_features(read_parquet(spark, source), **options), target)


def item_pipeline(spark: SparkSession, items: str, enriched: str, target: str) -> None:
    write_parquet(engineer_item_features(read_parquet(spark, items), read_parquet(spark, enriched)), target)


def auction_pipeline(
    spark: SparkSession,
    auctions: str,
    enriched: str,
    target: str,
    population: DataFrame | None = None,
    tax: DataFrame | None = None,
) -> None:
    areas = None
    if population is not None and tax is not None:
        areas = area_lookup(clean_population(population), clean_tax(tax))
    write_parquet(engineer_auction_features(read_parquet(spark, auctions), read_parquet(spark, enriched), areas), target)


def combined_table(auctions: DataFrame, items: DataFrame, bids: DataFrame, how: str = "left") -> DataFrame:
    """Every bid with its auction and item features, as one lazy plan."""
    return merge_bids(bids, merge_auctions_items(auctions, items), how)


def combine_pipeline(spark: SparkSession, auctions: str, items: str, bids: str, target: str, how: str = "left") -> None:
    parts = (read_parquet(spark, path) for path in (auctions, items, bids))
    write_combined(combined_table(*parts, how=how), target)


def resume_combine(
    spark: SparkSession,
    auctions: str,
    items: str,
    bids: str,
    target: str,
    key: Sequence[str] = ("auction_id", "item_id", "bid_id"),
) -> None:
    """Append the bids that are not in the target yet.

    What is done is told by the bids in the target, not by a row offset, so a
    new bid on an item that is there already is added too.
    """
    done = read_parquet(spark, target)
    pending = not_done(read_parquet(spark, bids), done, list(key))
    merged = combined_table(read_parquet(spark, auctions), read_parquet(spark, items), pending)
    write_parquet(merged.select(*done.columns), target, "append")


def text_pipeline(spark: SparkSession, items: str, target: str, dimensions: int = DIMENSIONS, **options) -> DataFrame:
    """Train word vectors on the items' texts and write one vector per item. Returns the word vectors."""
    tokens = item_tokens(read_parquet(spark, items))
    words = train_word_vectors(training_corpus(tokens), dimensions, **options)
    write_parquet(document_vectors(tokens, words, dimensions=dimensions), target)
    return words
