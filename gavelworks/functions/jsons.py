"""Counts over JSON text, lists and maps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Output name and whether object keys are counted, by source column.
LIST_COUNTS = {
    "enriched_item_brands": ("item_brands_count", False),
    "enriched_item_categories": ("item_categories_count", False),
    "enriched_item_items": ("item_items_count", False),
    "enriched_item_attributes": ("item_attributes_count", True),
}
EMPTY_SCALARS = r'^(null|false|""|-?0(\.0+)?([eE][+-]?[0-9]+)?)$'


def json_count(text: Column, count_keys: bool = False) -> Column:
    """How many entries a JSON text holds.

    A list counts its elements; an object counts 1, or its keys; any other
    value counts 1 unless it is an empty one; text that is not JSON counts 1
    unless blank; NULL and the placeholder spellings count 0.
    """
    body = F.trim(text, F.lit(" \t\n\r"))
    junk = F.lit(1)
    # The lenient count comes first: where it is NULL the product is, and the strict reading, whose
    # refusals are dear, is not tried.
    valid = F.when(F.try_parse_json(text).isNotNull(), 1)
    as_list = F.coalesce(F.json_array_length(text) * valid, junk)
    as_object = junk
    if count_keys:
        as_object = F.coalesce(F.array_size(F.json_object_keys(text)) * valid, junk)
    return (
        F.when(text.isNull() | text.isin("", "nan", "None"), 0)
        .when(body.startswith("["), as_list)
        .when(body.startswith("{"), as_object)
        .when(body.rlike(EMPTY_SCALARS), 0)
        .when(F.regexp_replace(text, r"(?U)\s+", "") == "", 0)
        .otherwise(1)
    )


def entry_count(df: DataFrame, column: str, count_keys: bool = False) -> Column:
    """``json_count`` for text; the size of an array or map column."""
    kind, c = dict(df.dtypes)[column], F.col(column)
    if kind.startswith("array"):
        return F.when(c.isNull(), 0).otherwise(F.size(c))
    if kind.startswith("map"):
        return F.when(c.isNull(), 0).otherwise(F.size(c) if count_keys else F.lit(1))
    return json_count(c.cast("string"), count_keys)


def list_count_columns(df: DataFrame) -> dict[str, Column]:
    """Entry counts of the list and object columns ``df`` has."""
    return {
        out: entry_count(df, source, keys) for source, (out, keys) in LIST_COUNTS.items() if source in df.columns
    }


def add_list_counts(df: DataFrame) -> DataFrame:
    zeros = {out: F.lit(0) for out, _ in LIST_COUNTS.values()}
    return df.withColumns(zeros | list_count_columns(df))
