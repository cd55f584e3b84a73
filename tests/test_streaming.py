"""Streams against the batch operators, with restarts."""

import time
from types import SimpleNamespace

import pytest
from conftest import SF
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from tidewarden.operators import breaker, quality
from tidewarden.operators.ingest import to_bronze
from tidewarden.plans import queries as Q
from tidewarden.session import shared_dir
from tidewarden.sources import sinks, streams
from tidewarden.streaming import ingest, routing, stateful

LOG = ["partition", "offset", "arrived_at", "value"]


def land(raw, path, part):
    raw.where(f"offset div 400 = {part}").select(*LOG).coalesce(1).write.mode("append").parquet(path)


def same(a, b):
    return a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_bronze_stream_equals_batch_across_a_restart(spark):
    raw, box = Q.raw_log(spark, SF), shared_dir(spark, "stream")
    clock = F.lit("2024-02-01").cast("timestamp")
    log = ingest.ProgressLog(spark, f"{box}/progress")
    spark.streams.addListener(log)
    for parts in ([0, 1], [2]):
        for p in parts:
            land(raw, f"{box}/in", p)
        source = streams.parquet_stream(spark, f"{box}/in", 1)
        q = ingest.start_bronze(source, f"{box}/out", f"{box}/ck", once=True, ingested=clock)
        q.awaitTermination()
    out = spark.read.parquet(f"{box}/out")
    assert same(out, to_bronze(raw, clock))
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(10_000)
    time.sleep(2)
    spark.streams.removeListener(log)
    progress = log.table()
    assert progress.agg(F.sum("input_rows")).first()[0] == raw.count()
    assert ingest.commit_counts(progress).first().commits >= 3


def test_progress_of_all_batches_is_kept(spark):
    """More batches than a query remembers (100)."""
    log = ingest.ProgressLog(spark, shared_dir(spark, "progress"))
    for i in range(250):
        p = SimpleNamespace(name="q", batchId=i, timestamp="2024-01-01T00:00:00.000Z", numInputRows=2, processedRowsPerSecond=None,
                            durationMs={"triggerExecution": 4}, stateOperators=[SimpleNamespace(numRowsDroppedByWatermark=1)])
        log.onQueryProgress(SimpleNamespace(progress=p))
    assert tuple(ingest.commit_counts(log.table()).first()) == ("q", 250, 500, 4.0)
    assert log.table().agg(F.sum("dropped_late"), F.count("at")).first()[:] == (250, 250)


def test_router_equals_batch_across_a_restart(spark):
    raw, box = Q.raw_log(spark, SF), shared_dir(spark, "route")
    router = routing.StreamRouter(f"{box}/out", Q.ROWS, Q.OPTIONS, dedupe_hours=24 * 60,
                                  clock=lambda: F.lit("2024-02-01").cast("timestamp"))
    for parts in ([0], [1, 2]):
        for p in parts:
            land(raw, f"{box}/in", p)
        source = streams.parquet_stream(spark, f"{box}/in", 2)
        routing.start_routing(source, router, f"{box}/ck", once=True).awaitTermination()
    clock = F.lit("2024-02-01").cast("timestamp")
    a = quality.assess(raw.select(*LOG), Q.ROWS, Q.OPTIONS).persist()
    for name, want in {"silver": quality.silver_rows(a, clock), "dlq": quality.dead_letters(a),
                       "quarantine": quality.quarantine_rows(a, detected_at=clock),
                       "audit": quality.audit_rows(a, observed_at=clock)}.items():
        assert same(sinks.read_table(spark, f"{box}/out/{name}").drop("batch_id"), want), name
    # The last batch again, as after a crash before its commit: nothing changes.
    last = sinks.snapshots(spark, f"{box}/out/silver").agg(F.max("batch_id")).first()[0]
    router(raw.where("offset div 400 > 0").select(*LOG), last)
    assert same(sinks.read_table(spark, f"{box}/out/silver").drop("batch_id"), quality.silver_rows(a, clock))
    a.unpersist()
    # A new checkpoint starts at batch 0 again; what is landed is not overwritten.
    with pytest.raises(ValueError):
        router(raw.select(*LOG), 0)


def test_breaker_stream_equals_batch(spark):
    raw, box = Q.raw_log(spark, SF).select(*LOG), shared_dir(spark, "breaker")
    with_source = lambda df: quality.check(df, Q.ROWS, Q.OPTIONS).withColumn("source", F.concat(F.lit("p"), "partition"))
    for p in range(3):
        land(raw, f"{box}/in", p)
    source = streams.parquet_stream(spark, f"{box}/in", 1)
    sliced = stateful.stream_slices(with_source(source), Q.BREAKER, "0 seconds")
    q = (stateful.breaker_stream(sliced, Q.BREAKER).writeStream.format("parquet").option("path", f"{box}/out")
         .option("checkpointLocation", f"{box}/ck").trigger(availableNow=True).start())
    q.awaitTermination()
    got = spark.read.parquet(f"{box}/out")
    want = breaker.breaker_states(Q.windows.slices(with_source(raw), ["source"], "arrived_at", Q.BAD, Q.HOUR), Q.BREAKER)
    assert got.exceptAll(want).count() == 0
    assert want.count() - got.count() <= 3          # slices the watermark has not closed yet


def test_keep_first_stream(spark):
    box = shared_dir(spark, "first")
    raw = Q.raw_log(spark, SF)
    raw.select(*LOG).coalesce(1).write.parquet(f"{box}/in")
    source = streams.parquet_stream(spark, f"{box}/in")
    ids = source.select("arrived_at", F.get_json_object("value", "$.event_id").alias("event_id")) \
        .where("event_id IS NOT NULL")
    q = (stateful.keep_first_stream(ids, "arrived_at", "60 days").writeStream.format("memory").queryName("firsts")
         .outputMode("append").trigger(availableNow=True).start())
    q.awaitTermination()
    assert spark.table("firsts").count() == ids_of(raw).distinct().count()


def ids_of(raw):
    return raw.select(F.get_json_object("value", "$.event_id").alias("e")).where("e IS NOT NULL")


class _Query:
    def __init__(self, fails):
        self.fails = fails

    def awaitTermination(self):
        if self.fails:
            raise StreamingQueryException("stopped")


def test_supervised_restarts():
    plan, naps = [True, True, False], []
    assert ingest.supervise(lambda: _Query(plan.pop(0)), sleep=naps.append) == 2 and naps == [10.0, 10.0]
    starts = []
    with pytest.raises(StreamingQueryException):
        ingest.supervise(lambda: starts.append(1) or _Query(True), sleep=naps.append)
    assert len(starts) == 4


def test_watermark_needs_a_timestamp(spark):
    df = ingest.with_watermark(spark.readStream.format("rate").load(), "timestamp")
    assert "EventTimeWatermark" in df._jdf.queryExecution().logical().toString()


def test_state_of_the_router_does_not_split_by_hour(spark):
    """Ids of many hours lie in as many files as there are tasks; one that comes again after days is still found."""
    root = shared_dir(spark, "router-hours")
    router = routing.StreamRouter(root, Q.ROWS, Q.OPTIONS, dedupe_hours=24 * 60, clock=lambda: F.col("arrived_at"))
    hours = spark.range(200).selectExpr("0 AS partition", "id AS offset", "timestamp_seconds(1700000000 + id * 3600) AS arrived_at",
                                        "concat('{\"event_id\":\"e', id % 150, '\"}') AS value").coalesce(1)
    router(hours.where("offset < 150"), 0)
    router(hours.where("offset >= 150"), 1)
    files = [f for f in spark.read.parquet(f"{root}/state/seen").inputFiles()]
    assert len(files) <= 2 * 8
    again = sinks.read_table(spark, f"{root}/audit").where("check_name = 'DUPLICATE_EVENT_ID' AND status = 'FAILED'")
    assert again.count() == 50
