"""Streaming bronze ingest, restarts and progress.

A checkpoint holds the log offsets and the sink's commits, which makes the file
sink exactly-once. Micro-batches are serial, so there is one commit at a time.
"""

from __future__ import annotations

import threading
import time
from collections.abc import Callable

from pyspark.errors import StreamingQueryException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from tidewarden.operators.ingest import to_bronze

COMMIT_INTERVAL = "30 seconds"
RESTART_ATTEMPTS = 3
RESTART_DELAY = 10.0
LATENESS = "5 seconds"


def with_watermark(df: DataFrame, column: str, lateness: str = LATENESS) -> DataFrame:
    """Bounded out-of-orderness; needs a TIMESTAMP column. Rows without an
    event time must be routed away first."""
    return df.withWatermark(column, lateness)


def triggered(writer, once: bool, interval: str = COMMIT_INTERVAL):
    return writer.trigger(availableNow=True) if once else writer.trigger(processingTime=interval)


def start_bronze(arrivals: DataFrame, path: str, checkpoint: str, once: bool = False,
                 ingested: Column | None = None) -> StreamingQuery:
    """Continuous bronze ingest into a folder of Parquet files; one map-only
    pass from the log to the files."""
    writer = (to_bronze(arrivals, ingested).writeStream.format("parquet").outputMode("append")
              .option("path", path).option("checkpointLocation", checkpoint))
    return triggered(writer, once).start()


def supervise(start: Callable[[], StreamingQuery], attempts: int = RESTART_ATTEMPTS,
              delay: float = RESTART_DELAY, sleep: Callable[[float], None] = time.sleep) -> int:
    """Runs a query to its end and starts it again after a failure.

    Gives up when it failed ``attempts`` + 1 times; returns the restarts used.
    """
    for used in range(attempts + 1):
        query = start()
        try:
            query.awaitTermination()
            return used
        except StreamingQueryException:
            if used == attempts:
                raise
            sleep(delay)
    return attempts


PROGRESS = ("query STRING, batch_id BIGINT, at STRING, input_rows BIGINT, rows_per_second DOUBLE, "
            "batch_ms BIGINT, dropped_late BIGINT")


class ProgressLog(StreamingQueryListener):
    """Appends the progress of every batch of all queries of a session to a table.

    A query itself remembers its last batches only. Rows are written in portions
    and when a query ends, or by :meth:`flush`.
    """

    PORTION = 100

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.rows, self.lock = spark, path, [], threading.Lock()

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        rate = p.processedRowsPerSecond
        with self.lock:
            self.rows.append((p.name, int(p.batchId), p.timestamp, int(p.numInputRows), None if rate is None else float(rate),
                              int(p.durationMs.get("triggerExecution", 0)),
                              sum(int(op.numRowsDroppedByWatermark) for op in p.stateOperators)))
            full = len(self.rows) >= self.PORTION
        if full:
            self.flush()

    def onQueryTerminated(self, event) -> None:
        self.flush()

    def flush(self) -> None:
        with self.lock:
            rows, self.rows = self.rows, []
        if rows:
            self.spark.createDataFrame(rows, PROGRESS).coalesce(1).write.mode("append").parquet(self.path)

    def table(self) -> DataFrame:
        """Rate, duration and rows dropped as late, one row per batch."""
        self.flush()
        return self.spark.read.schema(PROGRESS).parquet(self.path).withColumn("at", F.try_to_timestamp("at"))


def commit_counts(progress: DataFrame) -> DataFrame:
    """Commits, rows and mean duration per query."""
    return progress.groupBy("query").agg(
        F.countDistinct("batch_id").alias("commits"), F.sum("input_rows").alias("rows"),
        F.avg("batch_ms").alias("avg_batch_ms"))
