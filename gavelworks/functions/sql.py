"""The rules as SQL functions, for users of ``spark.sql``: scalar ones, and tables of several values.

They are SQL functions, so Catalyst inlines them and they cost what the
expression costs. Their bodies are made of the Column rules, as Catalyst spells
them, or of the text that the Columns themselves are made of; no rule is
written here.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from gavelworks.functions.jsons import json_count
from gavelworks.functions.money import expected_increment
from gavelworks.functions.pickup import html_text_sql, pickup_sql, ranges_sql
from gavelworks.functions.places import fsa
from gavelworks.functions.times import is_canadian_holiday, is_us_holiday, part_of_day, season

# Name: (parameter, its type, type of the result, rule).
SCALARS: dict[str, tuple[str, str, str, Callable[[Column], Column]]] = {
    "expected_increment": ("bid", "DOUBLE", "INT", expected_increment),
    "postal_area": ("code", "STRING", "STRING", fsa),
    "part_of_day": ("hour", "INT", "STRING", part_of_day),
    "season_of": ("month", "INT", "STRING", season),
    "is_us_holiday": ("t", "TIMESTAMP", "BOOLEAN", is_us_holiday),
    "is_canadian_holiday": ("t", "TIMESTAMP", "BOOLEAN", is_canadian_holiday),
    "json_entries": ("json", "STRING", "INT", json_count),
    "json_keys": ("json", "STRING", "INT", lambda c: json_count(c, count_keys=True)),
}

PICKUP_TYPES = ["INT", "DOUBLE", "DOUBLE", "DOUBLE", "INT", "BOOLEAN"]


def spelled(spark: SparkSession, rule: Callable[[Column], Column], parameter: str, kind: str) -> str:
    """A rule over one column as SQL text. Rules with lambda functions cannot be spelled so."""
    frame = spark.createDataFrame([], f"{parameter} {kind}").select(rule(F.col(parameter)).alias("value"))
    return frame._jdf.queryExecution().analyzed().projectList().head().child().sql()


def table_functions() -> dict[str, str]:
    """Signature and body of the functions that return a row of several values."""
    text, ranges = "coalesce(" + html_text_sql("html") + ", '')", ranges_sql("note")
    features = pickup_sql("note", "ranges")
    columns = ", ".join(f"{name} {kind}" for name, kind in zip(features, PICKUP_TYPES))
    values = ", ".join(f"{value} AS {name}" for name, value in features.items())
    return {
        f"pickup_windows(html STRING) RETURNS TABLE({columns})": (
            f"SELECT {values} FROM (SELECT note, {ranges} AS ranges FROM (SELECT {text} AS note))"
        ),
        "json_counts(json STRING) RETURNS TABLE(entries INT, keys INT)": (
            "SELECT json_entries(json) AS entries, json_keys(json) AS keys"
        ),
    }


def register_functions(spark: SparkSession) -> None:
    for name, (parameter, kind, result, rule) in SCALARS.items():
        body = spelled(spark, rule, parameter, kind)
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameter} {kind}) RETURNS {result} RETURN {body}")
    for signature, body in table_functions().items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {signature} RETURN {body}")
