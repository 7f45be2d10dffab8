"""Running streams: bounded sources, sinks that take a batch once, static tables in versions, counts of late rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from gavelworks.operators.joins import KEY_LIMIT, left_join


def write_stream(df: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Drain what has arrived into Parquet, exactly once; run again to continue."""
    return (
        df.writeStream.format("parquet")
        .outputMode(mode)
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def _files(spark: SparkSession, path: str):
    """The file system of a path, whatever store it is in, and the path for it."""
    jvm = spark._jvm.org.apache.hadoop.fs
    found = jvm.Path(path)
    return found.getFileSystem(spark._jsc.hadoopConfiguration()), found


def committed(spark: SparkSession, path: str) -> bool:
    """Whether a job that wrote this folder has come to its end."""
    files, found = _files(spark, f"{path}/_SUCCESS")
    return files.exists(found)


def _numbered(spark: SparkSession, path: str, name: str) -> list[int]:
    """The numbers of the finished folders ``name=<number>`` below ``path``."""
    files, found = _files(spark, path)
    if not files.exists(found):
        return []
    folders = [f.getPath().getName() for f in files.listStatus(found)]
    numbers = sorted(int(f.split("=")[1]) for f in folders if f.startswith(f"{name}="))
    return [n for n in numbers if committed(spark, f"{path}/{name}={n}")]


class BatchTable:
    """A Parquet table that takes each batch of each stream once.

    A batch is a folder, named by the stream (``app``) and the batch's number,
    which together are its transaction. A batch that was committed is not
    written again, and one whose writer died is overwritten whole; readers see
    committed batches only. So a batch may be delivered any number of times.
    """

    def __init__(self, spark: SparkSession, path: str, app: str):
        self.spark, self.app, self.root = spark, app, f"{path}/app={app}"

    def folder(self, batch: int) -> str:
        return f"{self.root}/batch={batch}"

    def batches(self) -> list[int]:
        return _numbered(self.spark, self.root, "batch")

    def write(self, rows: Callable[[], DataFrame], batch: int) -> bool:
        """Write the batch unless it is there; ``rows`` is only called if it is not."""
        if committed(self.spark, self.folder(batch)):
            return False
        rows().write.mode("overwrite").parquet(self.folder(batch))
        return True

    def read(self, schema: T.StructType) -> DataFrame:
        """All committed batches, with their number as ``batch``."""
        found = [self.folder(b) for b in self.batches()]
        whole = T.StructType([*schema.fields, T.StructField("batch", T.LongType())])
        if not found:
            return self.spark.createDataFrame([], whole)
        return self.spark.read.schema(whole).option("basePath", self.root).parquet(*found)


def into_table(
    stream: DataFrame,
    table: BatchTable,
    checkpoint: str,
    change: Callable[[DataFrame], DataFrame] | None = None,
    mode: str = "append",
) -> StreamingQuery:
    """Drain what has arrived into the table, batch by batch, each changed by ``change`` first."""

    def take(rows: DataFrame, batch: int) -> None:
        table.write(lambda: rows if change is None else change(rows), batch)

    return (
        stream.writeStream.outputMode(mode)
        .foreachBatch(take)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


# ------------------------------------------------------------------ static sides


class VersionedTable:
    """A static table that streams join with, written once for each version and never changed in place."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def versions(self) -> list[int]:
        return _numbered(self.spark, self.path, "version")

    def publish(self, rows: DataFrame, version: int | None = None) -> int:
        """Write the rows as the given version, or the next one. A version that is there stays as it is."""
        number = max(self.versions(), default=-1) + 1 if version is None else version
        if number not in self.versions():
            rows.write.mode("overwrite").parquet(f"{self.path}/version={number}")
        return number

    def read(self, version: int | None = None) -> DataFrame:
        """A version, the latest by default, with its number as ``version``."""
        found = self.versions()
        if not found:
            raise ValueError(f"no version of {self.path} was published")
        number = found[-1] if version is None else version
        rows = self.spark.read.parquet(f"{self.path}/version={number}")
        return rows.withColumn("version", F.lit(number).cast("long"))


def enrich_batches(
    bids: DataFrame,
    static: VersionedTable,
    table: BatchTable,
    checkpoint: str,
    on: tuple[str, ...] = ("auction_id",),
    limit: int = KEY_LIMIT,
) -> StreamingQuery:
    """Join each batch of bids with the latest version of a static table, into a table that takes a batch once.

    The static side is read as it was written and computed for no batch, and
    every row tells the version it met. A key with more than ``limit`` bids of a
    batch is spread over several tasks.
    """
    return into_table(bids, table, checkpoint, lambda rows: left_join(rows, static.read(), list(on), limit))


# ------------------------------------------------------------------ late rows


class LateRows(StreamingQueryListener):
    """Rows that arrived and rows dropped as later than the watermark, by query and batch.

    Register it with ``spark.streams.addListener`` before the queries start; a
    query itself keeps only its last progress reports. Reports come on a thread
    of their own, a little after the batch.
    """

    SCHEMA = "query string, batch long, arrived long, dropped long"

    def __init__(self):
        self.counts: dict[tuple[str, int], tuple[int, int]] = {}

    @property
    def dropped(self) -> dict[str, int]:
        """Rows dropped by each query so far."""
        out: dict[str, int] = {}
        for (query, _), (_, late) in list(self.counts.items()):
            out[query] = out.get(query, 0) + late
        return out

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        progress = event.progress
        late = sum(op.numRowsDroppedByWatermark for op in progress.stateOperators)
        if progress.numInputRows or late:
            self.counts[str(progress.id), progress.batchId] = (progress.numInputRows, late)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass

    def write(self, spark: SparkSession, path: str) -> None:
        """Add the counts so far, a row for each query and batch with rows, to a table."""
        rows = [(query, batch, *counts) for (query, batch), counts in sorted(self.counts.items())]
        spark.createDataFrame(rows, self.SCHEMA).coalesce(1).write.mode("append").parquet(path)
