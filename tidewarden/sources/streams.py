"""Log sources and keyed sinks: a broker, or files in its place.

All readers give the same columns: partition, offset, arrived_at, value. The
broker formats need the connector jar on the cluster.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from pyspark.sql.types import StructType

from tidewarden import model


def from_broker_rows(df: DataFrame) -> DataFrame:
    """Broker records in the arrival layout."""
    return df.select("partition", "offset", F.col("timestamp").alias("arrived_at"),
                     F.col("value").cast("string").alias("value"))


def broker_stream(spark: SparkSession, servers: str, topic: str = model.TOPICS["raw"][0],
                  start: str = "latest", max_offsets: int | None = None,
                  min_partitions: int | None = None) -> DataFrame:
    """Unbounded read of a topic; ``start`` is latest or earliest.

    Offsets live in the query's checkpoint, so a restart needs no reset.
    ``min_partitions`` splits large topic partitions over more tasks.
    """
    reader = (spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers)
              .option("subscribe", topic).option("startingOffsets", _start(start)))
    if max_offsets:
        reader = reader.option("maxOffsetsPerTrigger", max_offsets)
    if min_partitions:
        reader = reader.option("minPartitions", min_partitions)
    return from_broker_rows(reader.load())


def broker_batch(spark: SparkSession, servers: str, topic: str) -> DataFrame:
    """Bounded read of all a topic holds."""
    return from_broker_rows(spark.read.format("kafka").option("kafka.bootstrap.servers", servers)
                            .option("subscribe", topic).option("startingOffsets", "earliest").load())


def _start(start: str) -> str:
    if start not in ("latest", "earliest"):
        raise ValueError("start must be latest or earliest")
    return start


def parquet_stream(spark: SparkSession, path: str, files_per_trigger: int | None = None, more: str = "") -> DataFrame:
    """Stream of arrival files; ``more`` declares columns beyond those of an arrival."""
    declared = StructType.fromDDL(more).fields if more else []
    reader = spark.readStream.schema(StructType([*model.ARRIVAL.fields, *declared]))
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def text_stream(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """Stream of JSON lines; a line has no log position, only an arrival time."""
    reader = spark.readStream
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.text(path).select(
        F.lit(None).cast("int").alias("partition"), F.lit(None).cast("bigint").alias("offset"),
        F.current_timestamp().alias("arrived_at"), "value")


def write_broker(frame: DataFrame, servers: str, topic: str) -> None:
    """Appends (key, value) rows to a topic."""
    frame.write.format("kafka").option("kafka.bootstrap.servers", servers).option("topic", topic).save()


def write_text(df: DataFrame, path: str) -> None:
    """Raw text lines."""
    df.select(F.col("value").cast("string")).write.mode("append").text(path)
