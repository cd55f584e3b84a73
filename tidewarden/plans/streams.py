"""Streaming jobs as queries: the log arrives in slices, and the query is stopped and started again between them.

Their results are those of the batch operators, so they share their oracle SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidewarden.functions import times
from tidewarden.operators import quality
from tidewarden.operators.ingest import decode
from tidewarden.operators.ordered import BLOCK
from tidewarden.plans import oracle
from tidewarden.plans.feed import raw_log
from tidewarden.plans.queries import BREAKER, HOUR, OPTIONS, ROWS, printable
from tidewarden.session import shared_dir
from tidewarden.sources import sinks, streams
from tidewarden.streaming import gate, ingest, live, routing
from tidewarden.streaming.stateful import fine_splits, narrow_state

LOG = ["partition", "offset", "arrived_at", "value"]
SLICES = 3
_ROUTED: dict[tuple[str, str], str] = {}


HEARTBEAT = "heartbeat"    # the source of rows that only carry the time on
_CONTROLLED: dict[tuple[str, str], tuple[str, list[int]]] = {}
_GATED: dict[tuple[str, str], str] = {}


def _landed(spark: SparkSession, box: str, newest: int, more: list[str] = []) -> DataFrame:
    """The slices landed up to the ``newest`` one, as a stream. Each has a folder, so a second query can be given the same slices, one by one."""
    return streams.parquet_stream(spark, f"{box}/in/{{{','.join(map(str, range(newest + 1)))}}}", more=", ".join(f"{c} STRING" for c in more))


def arriving(spark: SparkSession, sf_dir: str, box: str, start, more: list[str] = [], timed: bool = False) -> None:
    """Lands the log slice by slice, in the order of its offsets; ``start`` is run to its end after each.

    ``timed`` lands it in the order of arrival: a query that closes windows behind the newest arrival would drop as late
    what lies further on in a log whose offsets do not follow time.
    """
    raw = raw_log(spark, sf_dir).select(*LOG, *more)
    at = F.unix_micros("arrived_at") if timed else F.col("offset")
    first, last = raw.agg(F.min(at), F.max(at)).first()
    first = (first or 0) if timed else 0
    nth = F.coalesce(F.floor((at - first) * SLICES / ((last or 0) - first + 1)), F.lit(0))
    with fine_splits(spark):
        for i in range(SLICES):
            raw.where(nth == i).write.option("maxRecordsPerFile", BLOCK).parquet(f"{box}/in/{i}")
            start(_landed(spark, box, i, more)).awaitTermination()


def stream_bronze(spark: SparkSession, sf_dir: str) -> DataFrame:
    box = shared_dir(spark, "stream-bronze")
    arriving(spark, sf_dir, box, lambda source: ingest.start_bronze(
        source, f"{box}/out", f"{box}/checkpoint", once=True, ingested=F.col("arrived_at")))
    return printable(spark.read.parquet(f"{box}/out"))


def routed(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the tables that the router writes; it runs once per session and log."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _ROUTED:
        box = shared_dir(spark, "stream-routes")
        us = F.unix_micros("arrived_at")   # copies are found over the log's whole span, as the batch queries do
        hours = raw_log(spark, sf_dir).agg(F.ceil((F.max(us) - F.min(us)) / (HOUR * 1_000_000)).cast("int")).first()[0]
        router = routing.StreamRouter(f"{box}/out", ROWS, OPTIONS, dedupe_hours=(hours or 0) + 1, clock=lambda: F.col("arrived_at"))
        arriving(spark, sf_dir, box, lambda source: routing.start_routing(source, router, f"{box}/checkpoint", once=True))
        _ROUTED[key] = box
    return printable(sinks.read_table(spark, f"{_ROUTED[key]}/out/{name}").drop("batch_id"))


def stream_silver(spark: SparkSession, sf_dir: str) -> DataFrame:
    return routed(spark, sf_dir, "silver").withColumn("unit_price", F.round("unit_price", 2))


def stream_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return routed(spark, sf_dir, "quarantine")


def stream_dead_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return routed(spark, sf_dir, "dlq")


def stream_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return routed(spark, sf_dir, "audit")


def _beat(spark: SparkSession, sf_dir: str, box: str, start) -> None:
    """A row of a source of its own, two days after the log's end: it closes all windows of the log."""
    raw_log(spark, sf_dir).agg((F.max("arrived_at") + F.expr("interval 2 days")).alias("arrived_at")).select(
        F.lit(-1).alias("partition"), F.lit(-1).cast("bigint").alias("offset"), "arrived_at", F.lit("{}").alias("value"),
        F.lit(HEARTBEAT).alias("source")).write.parquet(f"{box}/in/{SLICES}")
    start(_landed(spark, box, SLICES, ["source"])).awaitTermination()


def controlled(spark: SparkSession, sf_dir: str) -> tuple[str, list[int]]:
    """Runs the breaker over the arriving log; gives its folder and the newest batch of states after each start. It runs once per
    session and log, and without the gate: no control table needs that."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _CONTROLLED:
        box, newest = shared_dir(spark, "stream-breaker"), []

        def start(source):
            query = gate.start_breaker(quality.check(source, ROWS, OPTIONS), f"{box}/out", f"{box}/breaker", BREAKER, "0 seconds", once=True)
            query.awaitTermination()
            newest.append(sinks.newest_batch(spark, f"{box}/out/states"))
            return query
        arriving(spark, sf_dir, box, start, more=["source"], timed=True)
        _beat(spark, sf_dir, box, start)
        _CONTROLLED[key] = box, newest
    return _CONTROLLED[key]


def _control(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return sinks.read_table(spark, f"{controlled(spark, sf_dir)[0]}/out/{name}").drop("batch_id").where(F.col("source") != HEARTBEAT)


def stream_breaker_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _control(spark, sf_dir, "states")


def stream_incidents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return printable(_control(spark, sf_dir, "incidents").withColumn("error_rate", F.round("error_rate", 6)))


def stream_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return printable(_control(spark, sf_dir, "alerts"))


def stream_control_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return printable(_control(spark, sf_dir, "pipeline_control"))


def _gated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs the gate over the slices that the breaker was given, each with the states known by then; it runs once per session and log."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _GATED:
        box, newest = controlled(spark, sf_dir)
        for i, known in enumerate(newest):
            gate.start_gate(_landed(spark, box, i, ["source"]), gate.state_stream(spark, f"{box}/out", known), f"{box}/gated", f"{box}/gate",
                            BREAKER, "0 seconds", keep=24 * HOUR, once=True, shards=4).awaitTermination()
        _GATED[key] = f"{box}/gated"
    return spark.read.schema(gate.GATED).parquet(_GATED[key]).where(F.col("source") != HEARTBEAT)


def stream_gated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _gated(spark, sf_dir).where("gate <> 'release'").select("source", "offset", "gate")


def stream_released(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Held events and the slice in which their source closed again."""
    return _gated(spark, sf_dir).where("gate = 'release'").select("source", "offset", "slice", "released_at")


def stream_error_rate_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    box = shared_dir(spark, "stream-sliding")

    def start(source):
        rates = gate.sliding_rate_stream(quality.check(source, ROWS, OPTIONS), 6 * HOUR, HOUR, "0 seconds")
        writer = rates.writeStream.format("parquet").option("path", f"{box}/out").option("checkpointLocation", f"{box}/checkpoint")
        with narrow_state(spark):
            return ingest.triggered(writer, once=True).start()
    arriving(spark, sf_dir, box, start, more=["source"], timed=True)
    _beat(spark, sf_dir, box, start)
    return spark.read.parquet(f"{box}/out").where(F.col("source") != HEARTBEAT).withColumn("error_rate", F.round("error_rate", 6))


def stream_live_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows, latency quantiles and backlog of each batch of a bronze ingest that watches itself."""
    box, progress = shared_dir(spark, "stream-live"), []

    def start(source):
        timed = decode(source, ["event_time"]).select("*", times.latency_ms(F.col("arrived_at"), times.prefix_time(F.col("event.event_time"))).alias("latency"))
        writer = live.observed(timed, "latency").select("partition", "offset", "latency").writeStream.format("parquet") \
            .option("path", f"{box}/out").option("checkpointLocation", f"{box}/checkpoint")
        query = ingest.triggered(writer, once=True).start()
        query.awaitTermination()
        progress.extend(query.recentProgress)
        return query
    arriving(spark, sf_dir, box, start)
    out = live.table(spark, progress)
    return out.select("batch_id", "input_rows", "timed_rows", F.round("p50_ms", 4).alias("p50_ms"), F.round("p95_ms", 4).alias("p95_ms"), "behind")


STREAMS = {f.__name__: f for f in (stream_bronze, stream_silver, stream_quarantine, stream_dead_letters, stream_audit, stream_breaker_states,
                                   stream_incidents, stream_alerts, stream_control_signals, stream_gated, stream_released,
                                   stream_error_rate_sliding, stream_live_metrics)}
STREAM_ORACLE = {"stream_bronze": oracle.ORACLE["bronze_ingest"], "stream_silver": oracle.ORACLE["silver_rows"],
                 "stream_quarantine": oracle.ORACLE["quarantine_rows"], "stream_dead_letters": oracle.ORACLE["dead_letters"],
                 "stream_audit": oracle.ORACLE["audit_rows"], "stream_breaker_states": oracle.ORACLE["breaker_states"],
                 "stream_incidents": oracle.ORACLE["incidents"], "stream_alerts": oracle.ORACLE["alert_feed"],
                 "stream_control_signals": oracle.ORACLE["control_signals"], "stream_gated": oracle.ORACLE["gated_events"],
                 "stream_released": oracle.ORACLE["released_events"], "stream_error_rate_sliding": oracle.ORACLE["error_rate_sliding"],
                 "stream_live_metrics": oracle.LIVE_METRICS}
