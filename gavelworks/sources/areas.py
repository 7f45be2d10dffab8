"""Postal-area lookup from census and tax tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Tax columns as delivered and as used.
TAX_NAMES = {
    "Total": "Number of Returns",
    "Total income": "Total Income",
    "Net income": "Net Income",
    "Taxable income": "Taxable Income",
}
POPULATION_SCHEMA = T.StructType(
    [
        T.StructField("GEO", T.StringType()),
        T.StructField("Population, 2021", T.LongType()),
        T.StructField("Total private dwellings, 2021", T.LongType()),
        T.StructField("Private dwellings occupied by usual residents, 2021", T.LongType()),
    ]
)
TAX_SCHEMA = T.StructType([T.StructField("FSA", T.StringType()), *[T.StructField(c, T.LongType()) for c in TAX_NAMES]])


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """CSV with a header, read by position under a fixed schema: no inference pass."""
    return spark.read.csv(path, header=True, schema=schema, enforceSchema=True, ignoreTrailingWhiteSpace=True)


def stripped(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.strip() for c in df.columns])


def _three_letter_rows(df: DataFrame, key: str) -> DataFrame:
    """Rows of single areas; totals and blank rows have keys of another length."""
    return df.filter(F.length(key) == 3).withColumn(key, F.upper(key))


def clean_population(df: DataFrame) -> DataFrame:
    """Trimmed headers, first column named GEO, single areas only."""
    df = stripped(df)
    return _three_letter_rows(df.withColumnRenamed(df.columns[0], "GEO"), "GEO")


def clean_tax(df: DataFrame) -> DataFrame:
    """Amounts come in thousands; the median is not published, so the average stands in for it."""
    df = _three_letter_rows(stripped(df).withColumnsRenamed(TAX_NAMES), "FSA")
    average = F.try_divide(
        (F.col("Total Income") * 1000).cast("double"), F.col("Number of Returns").cast("double")
    )
    return df.withColumns({"Average Total Income": average, "Median Total Income": average})


def area_lookup(population: DataFrame, tax: DataFrame) -> DataFrame:
    """One row per area known to either table."""
    tax = tax.withColumnRenamed("FSA", "_tax_area")
    joined = population.join(tax, F.col("GEO") == F.col("_tax_area"), "full")
    rest = [c for c in joined.columns if c not in ("GEO", "_tax_area")]
    return joined.select(F.coalesce("GEO", "_tax_area").alias("FSA"), *[F.col(f"`{c}`") for c in rest])
