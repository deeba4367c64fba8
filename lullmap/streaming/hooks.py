"""Where user code meets a running stream: per batch of results, and on its progress."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQueryListener
from pyspark.sql.types import StructType


def on_intervals(stream: DataFrame, handle: Callable[[DataFrame, int], None]) -> DataStreamWriter:
    """Writer that hands every micro-batch of closed intervals to ``handle(batch, number)``."""
    return stream.writeStream.outputMode("append").foreachBatch(handle)


def written_once(
    stream: DataFrame, folder: str, name: str, before_commit: Callable[[DataFrame, int], None] | None = None
) -> DataStreamWriter:
    """Writer that stores every micro-batch below ``folder`` exactly once, however often it is tried.

    A batch has one place, by query name and number, so a second try replaces what the first
    left behind, and it counts from the moment the ledger has it. ``before_commit`` is user
    code on the stored batch; where it fails, the batch does not count and is tried again.
    Start it with a checkpoint of its own; ``read_once`` gives the rows.
    """

    def handle(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        place = f"query={name}/batch={number}"
        batch.write.mode("overwrite").parquet(f"{folder}/rows/{place}")
        stored = spark.read.schema(batch.schema).parquet(f"{folder}/rows/{place}")
        if before_commit is not None:
            before_commit(stored, number)
        stored.agg(F.count(F.lit(1)).alias("rows")).write.mode("overwrite").parquet(f"{folder}/ledger/{place}")

    return stream.writeStream.outputMode("append").foreachBatch(handle)


def read_once(spark: SparkSession, folder: str, schema: StructType) -> DataFrame:
    """Rows of the batches in the ledger of ``folder``, with ``query`` and ``batch``."""
    place = StructType().add("query", "string").add("batch", "long")
    rows = spark.read.schema(StructType([*schema.fields, *place.fields])).parquet(f"{folder}/rows")
    ledger = spark.read.schema(place).parquet(f"{folder}/ledger").distinct()
    return rows.join(ledger, ["query", "batch"], "left_semi")


class ProgressListener(StreamingQueryListener):
    """Calls ``on_progress(query name, batch, input rows)`` after every micro-batch.

    When ``cancelled()`` turns true the query is stopped.
    """

    def __init__(
        self,
        on_progress: Callable[[str | None, int, int], None],
        cancelled: Callable[[], bool] = lambda: False,
    ) -> None:
        self.on_progress, self.cancelled = on_progress, cancelled

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        self.on_progress(p.name, p.batchId, p.numInputRows)
        if self.cancelled():
            query = self.spark.streams.get(str(p.id))
            if query is not None:
                query.stop()

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass
