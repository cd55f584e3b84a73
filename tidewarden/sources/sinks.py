"""Table writers: append, batches with a ledger, day partitions, compaction.

A ledgered table is a folder ``data/batch_id=n`` per committed batch and a
``ledger`` of what was committed. Writing a batch again replaces it, so a
retried micro-batch leaves no duplicates, and rows of a batch that was never
committed are not visible. The ledger also serves as snapshot list.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidewarden.operators import quality


def append(df: DataFrame, identifier: str) -> None:
    """Appends rows to a catalog table by column position."""
    df.select(*df.sparkSession.table(identifier).columns).write.insertInto(identifier)


def write_batch(df: DataFrame, path: str, batch_id: int) -> None:
    """Writes and commits one batch of a ledgered table, replacing a former try."""
    spark = df.sparkSession
    data = f"{path}/data/batch_id={batch_id}"
    df.write.mode("overwrite").parquet(data)
    rows = spark.read.schema(df.schema).parquet(data).agg(F.count(F.lit(1)).alias("rows"))
    (rows.select("rows", F.current_timestamp().alias("committed_at"))
     .coalesce(1).write.mode("overwrite").parquet(f"{path}/ledger/batch_id={batch_id}"))


def snapshots(spark: SparkSession, path: str) -> DataFrame:
    """Committed batches: batch_id, committed_at, rows."""
    return spark.read.schema("rows BIGINT, committed_at TIMESTAMP, batch_id BIGINT") \
        .parquet(f"{path}/ledger").select("batch_id", "committed_at", "rows")


def newest_batch(spark: SparkSession, path: str) -> int | None:
    """The last committed batch; None before the first."""
    ledger = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/ledger")
    if not ledger.getFileSystem(spark._jsc.hadoopConfiguration()).exists(ledger):
        return None
    return snapshots(spark, path).agg(F.max("batch_id")).first()[0]


def read_table(spark: SparkSession, path: str, as_of: int | None = None) -> DataFrame:
    """Rows of the committed batches, up to ``as_of`` for an earlier state."""
    done = snapshots(spark, path).select("batch_id")
    data = spark.read.parquet(f"{path}/data")
    if as_of is not None:
        data, done = data.where(F.col("batch_id") <= as_of), done.where(F.col("batch_id") <= as_of)
    return data.join(done, "batch_id", "left_semi")


def write_by_day(df: DataFrame, path: str, time_column: str, mode: str = "append") -> None:
    """Writes day partitions. Days are gathered, and a day is shared by as many
    tasks as its size needs (spark.sql.adaptive.advisoryPartitionSizeInBytes)."""
    (df.withColumn("day", F.to_date(F.col(time_column))).hint("rebalance", "day")
     .write.mode(mode).partitionBy("day").parquet(path))


def compact_day(spark: SparkSession, path: str, day: str, files: int, staging: str) -> None:
    """Rewrites one day partition into ``files`` files.

    The new files are complete in ``staging`` before the old ones are replaced.
    """
    rows = spark.read.parquet(path).where(F.col("day") == F.lit(day).cast("date"))
    rows.repartition(files).write.mode("overwrite").partitionBy("day").parquet(staging)
    (spark.read.parquet(staging).coalesce(files).write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(path))


def write_routes(assessed: DataFrame, root: str, batch_id: int, clock=None) -> None:
    """Valid, invalid and dead-letter rows of one batch to their tables.

    The batch is kept for the three passes, so the rules run once; if an
    executor with cached rows is lost, Spark computes them again.
    """
    kept = assessed.persist()
    try:
        write_batch(quality.silver_rows(kept, clock), f"{root}/silver", batch_id)
        write_batch(quality.quarantine_rows(kept, detected_at=clock), f"{root}/quarantine", batch_id)
        write_batch(quality.dead_letters(kept), f"{root}/dlq", batch_id)
        write_batch(quality.audit_rows(kept, observed_at=clock), f"{root}/audit", batch_id)
    finally:
        kept.unpersist()
