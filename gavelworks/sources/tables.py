"""Named tables, readers, writers and dataset descriptions."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gavelworks.operators.joins import keys_first


@dataclass
class Tables:
    """Landed datasets by name. Registering a dataset reads nothing but its schema."""

    spark: SparkSession
    paths: dict[str, str] = field(default_factory=dict)
    schemas: dict[str, T.StructType] = field(default_factory=dict)

    def read(self, name: str) -> DataFrame:
        return read_parquet(self.spark, self.paths[name], self.schemas.get(name))

    def stream(self, name: str, files_per_trigger: int = 100) -> DataFrame:
        """The same dataset in bounded steps, each of at most ``files_per_trigger`` files."""
        schema = self.schemas.get(name) or self.read(name).schema
        reader = self.spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger)
        return reader.parquet(self.paths[name])

    def register(self) -> None:
        for name in self.paths:
            self.read(name).createOrReplaceTempView(name)

    def sql(self, query: str, params: dict | None = None) -> DataFrame:
        """Run SQL over the registered tables; parameters are bound, never pasted in."""
        return self.spark.sql(query, args=params or {})


def read_parquet(
    spark: SparkSession, path: str, schema: T.StructType | None = None, files: str | None = None
) -> DataFrame:
    """One file or a folder of part files; ``files`` is a glob such as ``batch_*.parquet``."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    if files is not None:
        reader = reader.option("pathGlobFilter", files)
    return reader.parquet(path)


def row_count(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a Parquet dataset. No column is read."""
    return read_parquet(spark, path).agg(F.count("*").alias("rows"))


# ------------------------------------------------------------------ readers


def _limited(df: DataFrame, limit: int | None) -> DataFrame:
    return df if limit is None else df.limit(limit)


def read_auctions(auctions: DataFrame, completed_only: bool = True, limit: int | None = None) -> DataFrame:
    if completed_only:
        auctions = auctions.filter(F.col("status") == "completed")
    return _limited(auctions if limit is None else auctions.orderBy("auction_id"), limit)


def read_items(items: DataFrame, auction_id: int | None = None, limit: int | None = None) -> DataFrame:
    if auction_id is not None:
        items = items.filter(F.col("auction_id") == auction_id)
    return _limited(items if limit is None else items.orderBy("item_id"), limit)


def read_bids(
    bids: DataFrame, item_id: int | None = None, limit: int | None = None, tiebreak: Sequence[str] = ("bid_id",)
) -> DataFrame:
    """Bids in time order. With a limit Spark keeps only the first rows of each task."""
    if item_id is not None:
        bids = bids.filter(F.col("item_id") == item_id)
    return _limited(bids.orderBy("bid_time", *tiebreak), limit)


def read_ids(
    df: DataFrame, names: Sequence[str] = ("auction_id", "amAuctionId", "id"), limit: int | None = None
) -> DataFrame:
    """Distinct ids in order, from the first of the names the table has."""
    source = next((c for c in names if c in df.columns), None)
    if source is None:
        raise ValueError(f"no id column among {list(names)}")
    ids = df.select(F.col(source).cast("long").alias(names[0])).filter(F.col(names[0]).isNotNull())
    return _limited(ids.distinct().orderBy(names[0]), limit)


def read_pairs(df: DataFrame, limit: int | None = None) -> DataFrame:
    """Distinct (auction, item) pairs in order."""
    pairs = df.select(F.col("auction_id").cast("long"), F.col("item_id").cast("long")).dropna()
    return _limited(pairs.distinct().orderBy("auction_id", "item_id"), limit)


# ------------------------------------------------------------------ writers


def write_parquet(df: DataFrame, path: str, mode: str = "overwrite", partition_by: Sequence[str] = ()) -> None:
    writer = df.write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)


def append_parquet(df: DataFrame, path: str) -> None:
    """Add part files; nothing already there is read or rewritten."""
    write_parquet(df, path, "append")


# Types that hold every value of another, narrowest first.
_WIDER = {
    "tinyint": ("smallint", "int", "bigint", "double"),
    "smallint": ("int", "bigint", "float", "double"),
    "int": ("bigint", "double"),
    "float": ("double",),
    "date": ("timestamp", "timestamp_ntz"),
}


class ContractError(ValueError):
    """Rows that do not fit the table they were to be added to; ``report`` says why, column by column."""

    def __init__(self, report: list[tuple[str, str | None, str | None, str]]):
        self.report = report
        refused = [f"{name}: {verdict} ({given} for {kept})" for name, given, kept, verdict in report if verdict in REFUSED]
        super().__init__("; ".join(refused))


REFUSED = ("extra", "narrowed")


def contract_report(rows: T.StructType, target: T.StructType) -> list[tuple[str, str | None, str | None, str]]:
    """``(column, given type, type of the table, verdict)`` for every column of either side, those of the table first.

    A column is ``same``, ``widened`` into a type that holds all its values,
    ``missing`` and so NULL, ``extra``, or ``narrowed`` into one that does not
    hold them. The last two are refused. Names are compared as they are spelled.
    """
    given = {f.name: f.dataType.simpleString() for f in rows}
    out: list[tuple[str, str | None, str | None, str]] = []
    for f in target:
        kept, own = f.dataType.simpleString(), given.pop(f.name, None)
        if own is None:
            verdict = "missing"
        elif own == kept:
            verdict = "same"
        else:
            verdict = "widened" if own == "void" or kept in _WIDER.get(own, ()) else "narrowed"
        out.append((f.name, own, kept, verdict))
    return [*out, *[(name, own, None, "extra") for name, own in given.items()]]


def append_to_contract(df: DataFrame, path: str, target: T.StructType | None = None) -> list[tuple]:
    """Add rows under the names, order and types that the table already has, and return the report.

    The table's schema is that of ``target`` or of what lies at ``path``. The
    check reads no rows; nothing is written when a column is refused.
    """
    spark = df.sparkSession
    target = spark.read.parquet(path).schema if target is None else target
    report = contract_report(df.schema, target)
    if any(verdict in REFUSED for *_, verdict in report):
        raise ContractError(report)
    given = set(df.columns)
    columns = [
        (F.col(f"`{f.name}`") if f.name in given else F.lit(None)).cast(f.dataType).alias(f.name) for f in target
    ]
    append_parquet(df.select(*columns), path)
    return report


def compact(spark: SparkSession, source: str, target: str, schema: T.StructType | None = None) -> None:
    """Rewrite many small files as few well-sized ones.

    Rebalancing lets AQE choose how many, from the measured sizes.
    """
    read_parquet(spark, source, schema).hint("rebalance").write.mode("overwrite").parquet(target)


def write_query(spark: SparkSession, query: str, path: str, params: dict | None = None) -> None:
    spark.sql(query, args=params or {}).write.mode("overwrite").parquet(path)


def write_combined(df: DataFrame, path: str) -> None:
    """The training table under its fixed column order: keys first."""
    write_parquet(keys_first(df), path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def union_all(tables: Sequence[DataFrame]) -> DataFrame:
    """Concatenation by column name; columns a table lacks are NULL."""
    first, *rest = tables
    for table in rest:
        first = first.unionByName(table, allowMissingColumns=True)
    return first


def describe_dataset(df: DataFrame, name: str, created_at: str, tags: Sequence[str] = ()) -> DataFrame:
    """One row: name, rows, columns, tags and creation time."""
    return df.agg(F.count("*").alias("rows")).select(
        F.lit(name).alias("name"),
        "rows",
        F.lit(list(df.columns)).alias("columns"),
        F.lit(list(tags)).cast("array<string>").alias("tags"),
        F.lit(created_at).alias("created_at"),
    )
