"""Streaming validation: every rule, three routes, exactly once.

Each micro-batch runs the batch operators. What must be known from earlier
batches is small or narrow and lies in ledgered tables next to the output: the
newest credible event time per log partition, and the ids seen within the
dedupe window, in the order of their hours. Writing batch n again reads the state of the
batches before n, so a retried batch gives the same rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from tidewarden.operators import quality
from tidewarden.operators.dedupe import flag_duplicates
from tidewarden.operators.skew import attach
from tidewarden.sources import sinks
from tidewarden.streaming.ingest import triggered

MARKS = "partition INT, mark TIMESTAMP, batch_id BIGINT"
SEEN = "event_id STRING, batch_id BIGINT, hour BIGINT"


def _hour(ts: Column) -> Column:
    return F.floor(F.unix_micros(ts) / 3_600_000_000).cast("long")


class StreamRouter:
    """foreachBatch target that assesses and routes arrivals under ``root``."""

    def __init__(self, root: str, contract_rows: list[tuple],
                 options: quality.RuleOptions = quality.RuleOptions(),
                 dedupe_hours: int = 24, clock: Callable[[], Column] | None = None):
        self.root, self.contract_rows, self.options = root, contract_rows, options
        self.dedupe_hours, self.clock = dedupe_hours, clock

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        newest = sinks.newest_batch(batch.sparkSession, f"{self.root}/audit")
        if newest is not None and newest > batch_id:   # the audit is written last
            raise ValueError(f"batch {batch_id} under {self.root} is followed by batch {newest}: a new checkpoint needs a new root")
        kept = batch.persist()
        try:
            narrow = quality.positions(kept, self.options).persist()
            assessed = self._assess(kept, narrow, batch_id)
            sinks.write_routes(assessed, self.root, batch_id, self.clock() if self.clock else None)
            self._write_state(narrow, batch_id)
            narrow.unpersist()
        finally:
            kept.unpersist()

    def _state(self, spark: SparkSession, name: str, schema: str, batch_id: int) -> DataFrame:
        """Rows written by the batches before this one; none at the start."""
        if batch_id == 0:
            return spark.createDataFrame([], schema)
        return spark.read.schema(schema).parquet(f"{self.root}/state/{name}") \
            .where(F.col("batch_id") < batch_id)

    def _assess(self, batch: DataFrame, narrow: DataFrame, batch_id: int) -> DataFrame:
        spark = batch.sparkSession
        marks = self._state(spark, "marks", MARKS, batch_id).groupBy("partition") \
            .agg(F.max("mark").alias("_old"))
        run = quality.with_marks(narrow, self.options)
        # One row per log partition of the topic: a fixed, small number.
        run = attach(run, marks, ["partition"], None)
        late = run.where(quality.is_late(F.greatest("_old", "mark"), self.options)) \
            .select("partition", "offset", F.lit("LATE_EVENT").alias("code"))

        flagged = flag_duplicates(narrow.where(F.col("event_id").isNotNull()), "event_id",
                                  list(self.options.dedupe_order))
        again = flagged.where("is_duplicate").select("partition", "offset")
        first = flagged.where("NOT is_duplicate")
        oldest = narrow.agg(F.min("arrived_at").alias("t")).first().t
        seen = self._state(spark, "seen", SEEN, batch_id)
        if oldest is not None:
            seen = seen.where(F.col("hour") >= _hour(F.lit(oldest)) - self.dedupe_hours)
        known = first.join(seen.select("event_id"), "event_id", "left_semi").select("partition", "offset")
        again = again.unionByName(known).select("partition", "offset", F.lit("DUPLICATE_EVENT_ID").alias("code"))

        flags = late.unionByName(again).groupBy("partition", "offset") \
            .agg(F.array_sort(F.collect_set("code")).alias("_codes"))
        # Written down, so that their size is known: while they are few, they go to the payloads and not the payloads to them.
        path = f"{self.root}/state/flags/batch_id={batch_id}"
        flags.write.mode("overwrite").parquet(path)
        flags = spark.read.schema(flags.schema).parquet(path)
        checked = quality.check(batch, self.contract_rows, self.options)
        joined = checked.join(flags, ["partition", "offset"], "left")
        ordered = F.reverse(F.coalesce("_codes", F.array().cast("array<string>")))
        return joined.withColumn("failures", F.concat("failures", ordered)).drop("_codes")

    def _write_state(self, narrow: DataFrame, batch_id: int) -> None:
        marks = narrow.groupBy("partition").agg(F.max("credible").alias("mark"))
        marks.coalesce(1).write.mode("overwrite").parquet(f"{self.root}/state/marks/batch_id={batch_id}")
        ids = narrow.where(F.col("event_id").isNotNull()) \
            .groupBy("event_id").agg(_hour(F.min("arrived_at")).alias("hour"))
        # Sorted, so that hours out of reach are skipped by the files' own bounds. A folder per hour would make hours x tasks files.
        ids.sortWithinPartitions("hour").write.mode("overwrite").parquet(f"{self.root}/state/seen/batch_id={batch_id}")


def start_routing(arrivals: DataFrame, router: StreamRouter, checkpoint: str,
                  once: bool = False) -> StreamingQuery:
    writer = arrivals.writeStream.foreachBatch(router).option("checkpointLocation", checkpoint)
    return triggered(writer, once).start()
