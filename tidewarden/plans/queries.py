"""Queries over the given tables, one per operator of the survey.

Each takes (spark, sf_dir) and reads whole tables: the checkout log derived
from ``events``, or ``lineitem`` and ``orders`` where volume or a large join is
the point. Timestamps are returned as text and money as double, so that other
engines can be compared value by value.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from tidewarden import model
from tidewarden.functions import payload as P
from tidewarden.functions import times
from tidewarden.functions.draws import digest, draw
from tidewarden.operators import (breaker, chaos, compatibility, dedupe, ingest, metrics, ordered,
                                  quality, replay, windows)
from tidewarden.plans.feed import RATES, checkouts, raw_log, table
from tidewarden.session import settled, shared_dir
from tidewarden.sources import contracts as registry, sinks, streams as sinks_streams

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

ROWS = registry.document_rows(registry.checkout_documents())
OPTIONS = quality.RuleOptions()
ORDER = list(OPTIONS.dedupe_order)      # offsets repeat between the partitions of a log
HOUR = 3600
# The log is thin (minutes between events), so windows are hours here.
BREAKER = breaker.BreakerOptions(step=HOUR, window=6 * HOUR, threshold=0.05, min_events=20,
                                 cooldown=12 * HOUR, sample=10)


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def stamp(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS")


def dbl(name: str, digits: int | None = None) -> Column:
    c = F.col(name).cast("double")
    return (F.round(c, digits) if digits is not None else c).alias(name)


def printable(df: DataFrame) -> DataFrame:
    """Timestamps as text, decimals as double."""
    out = []
    for f in df.schema.fields:
        kind = f.dataType.typeName()
        c = F.col(f.name)
        out.append(stamp(c).alias(f.name) if kind.startswith("timestamp")
                   else c.cast("double").alias(f.name) if kind == "decimal" else c)
    return df.select(*out)


def assessed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.assess(raw_log(spark, sf_dir), ROWS, OPTIONS)


def bronze(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.to_bronze(raw_log(spark, sf_dir), F.col("arrived_at"))


def failed_slices(spark: SparkSession, sf_dir: str, seconds: int = HOUR) -> DataFrame:
    """Hourly totals per source; an event is bad when any stateless rule fails."""
    return windows.slices(checked(spark, sf_dir), ["source"], "arrived_at", BAD, seconds)


def checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.check(raw_log(spark, sf_dir), ROWS, OPTIONS)


BAD = "size(failures) > 0"


# --- ingest ------------------------------------------------------------------

@query
def bronze_ingest(spark, sf):
    return printable(bronze(spark, sf))


@query
def bronze_completeness(spark, sf):
    return metrics.completeness(bronze(spark, sf), ["event_id", "event_time", "customer_id", "amount"])


@query
def bronze_null_presence(spark, sf):
    return metrics.null_presence(bronze(spark, sf), model.BRONZE.fieldNames())


@query
def bronze_duplicate_count(spark, sf):
    return dedupe.duplicate_count(bronze(spark, sf))


@query
def projection_limit(spark, sf):
    return bronze(spark, sf).select("event_id", "customer_id").orderBy("event_id", "customer_id").limit(10)


@query
def required_enforced(spark, sf):
    kept = ingest.enforce_required(bronze(spark, sf), ["event_id", "event_time", "customer_id", "amount"])
    return kept.groupBy("payment_status").agg(F.count(F.lit(1)).alias("events"))


@query
def producer_records(spark, sf):
    """All payload fields; the prices as double, as every JSON writer prints these alike."""
    rows = checkouts(table(spark, sf, "events")).withColumns({c: F.col(c).cast("double") for c in ("unit_price", "amount")})
    return ingest.producer_frame(rows, [*model.EVENT_FIELDS, "coupon_code"])


@query
def corrupted_payloads(spark, sf):
    return raw_log(spark, sf).select("partition", "offset", "source", "fault_mode", "value",
                                     stamp(F.col("arrived_at")).alias("arrived_at"))


@query
def mixed_stream_counts(spark, sf):
    raw = raw_log(spark, sf)
    clean = raw.where(F.col("fault_mode").isNull()).select("partition", "offset", F.lit("clean").alias("kind"))
    faulty = raw.where(F.col("fault_mode").isNotNull()).select("partition", "offset", F.lit("faulty").alias("kind"))
    return clean.unionByName(faulty).groupBy("partition", "kind").agg(F.count(F.lit(1)).alias("events"))


# --- sinks ---------------------------------------------------------------------

@query
def stored_by_day(spark, sf):
    """Bronze written in day partitions by two appends, the first day compacted into one file, and read back."""
    path, rows = shared_dir(spark, "by-day"), bronze(spark, sf).withColumn("_half", F.pmod(F.xxhash64("event_id"), F.lit(2)))
    for half in (0, 1):
        sinks.write_by_day(rows.where(F.col("_half") == half).drop("_half"), path, "ingestion_time")
    first = spark.read.parquet(path).agg(F.date_format(F.min("day"), "yyyy-MM-dd")).first()[0]
    sinks.compact_day(spark, path, first, 1, shared_dir(spark, "by-day-staging"))
    return printable(spark.read.parquet(path).drop("day"))


def ledgered(spark, sf) -> str:
    """The log as a table of three committed batches, in the order of its offsets; the second one was written twice."""
    path, raw = shared_dir(spark, "ledgered"), raw_log(spark, sf)
    nth = F.floor(F.col("offset") * 3 / (raw.agg(F.max("offset")).scalar() + 1))
    for batch in (0, 1, 1, 2):
        sinks.write_batch(raw.where(nth == batch).select("partition", "offset", "value"), path, batch)
    return path


@query
def snapshot_list(spark, sf):
    return sinks.snapshots(spark, ledgered(spark, sf)).select("batch_id", "rows")


@query
def snapshot_rows(spark, sf):
    """The table as of its second snapshot."""
    return sinks.read_table(spark, ledgered(spark, sf), as_of=1).select("batch_id", "partition", "offset", "value")


@query
def text_lines(spark, sf):
    """Payloads written as text lines and read back."""
    path = shared_dir(spark, "text-lines")
    sinks_streams.write_text(raw_log(spark, sf), path)
    return spark.read.text(path).select("value")


# --- rules and routes -----------------------------------------------------------

@query
def event_failures(spark, sf):
    v = quality.with_verdict(assessed(spark, sf))
    return v.select("partition", "offset", "event_id", "route", "failure_reason", "failure_type",
                    dbl("quality_score", 6))


@query
def failures_by_rule(spark, sf):
    counts = assessed(spark, sf).agg(*[F.count_if(F.array_contains("failures", c)).alias(c) for c in model.RULES])
    rules = F.explode(F.array(*[F.struct(F.lit(c).alias("rule"), F.lit(s).alias("severity"), F.col(c).alias("events"))
                                for c, s in model.RULES.items()])).alias("r")
    return counts.select(rules).select("r.*")


@query
def route_counts(spark, sf):
    return quality.route_counts(assessed(spark, sf))


@query
def silver_rows(spark, sf):
    rows = quality.silver_rows(assessed(spark, sf), F.col("arrived_at"))
    return printable(rows.withColumn("unit_price", F.round("unit_price", 2)))


@query
def quarantine_rows(spark, sf):
    return printable(quality.quarantine_rows(assessed(spark, sf), detected_at=F.col("arrived_at")))


@query
def dead_letters(spark, sf):
    return printable(quality.dead_letters(assessed(spark, sf)))


@query
def audit_rows(spark, sf):
    return printable(quality.audit_rows(assessed(spark, sf), observed_at=F.col("arrived_at")))


@query
def quality_score_by_source(spark, sf):
    v = assessed(spark, sf).withColumn("quality_score", quality.quality_score())
    return v.groupBy("source").agg(F.round(F.avg("quality_score"), 6).alias("avg_score"),
                                   F.round(F.min("quality_score"), 6).alias("min_score"))


@query
def fault_detection(spark, sf):
    return metrics.fault_detection(assessed(spark, sf))


@query
def invalid_currencies(spark, sf):
    """Legacy faults looked up in the currency reference list."""
    dirty = chaos.corrupt_legacy(checkouts(table(spark, sf, "events")), percent=40.0, seed=3,
                                 error_types=["invalid_currency"])
    found = dirty.select(F.get_json_object("value", "$.currency").alias("currency"))
    reference = spark.createDataFrame([(c,) for c in model.CURRENCIES], "currency string")
    return found.join(F.broadcast(reference), "currency", "left_anti").groupBy("currency") \
        .agg(F.count(F.lit(1)).alias("events"))


@query
def legacy_errors(spark, sf):
    dirty = chaos.corrupt_legacy(checkouts(table(spark, sf, "events")), percent=60.0, seed=5)
    return dirty.select("partition", F.col("pos").alias("offset"), "error_type", "value")


@query
def typed_probe(spark, sf):
    return compatibility.kind_counts(raw_log(spark, sf))


@query
def amount_check(spark, sf):
    c = checked(spark, sf)
    product = F.round(F.col("quantity").try_cast("double") * F.col("unit_price").try_cast("double"), 2)
    off = F.abs(F.col("amount").try_cast("double") - product) >= 0.001
    return c.groupBy("source").agg(F.count_if(off).alias("off"), F.count_if(~off).alias("exact"),
                                   F.count_if(off.isNull()).alias("unknown"))


# --- duplicates and lateness ----------------------------------------------------

@query
def duplicates_flagged(spark, sf):
    e = ingest.decode(raw_log(spark, sf), ["event_id"]).select("partition", "offset", "arrived_at", "event.event_id")
    return dedupe.flag_duplicates(e, "event_id", ORDER).select("offset", "event_id", "is_duplicate")


@query
def first_arrivals(spark, sf):
    e = ingest.decode(raw_log(spark, sf), ["event_id"]).select("partition", "offset", "arrived_at", "event.*", "value")
    return dedupe.keep_first(e, "event_id", ORDER).select("offset", "event_id", "value")


@query
def lineitem_first_per_line(spark, sf):
    """Keep-first on a table whose natural key repeats."""
    li = table(spark, sf, "lineitem").select(
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("line_id"), "l_shipdate", "l_partkey",
        "l_suppkey", "l_extendedprice")
    kept = dedupe.keep_first(li, "line_id", ["l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice"])
    return printable(kept)


@query
def lineitem_duplicate_count(spark, sf):
    li = table(spark, sf, "lineitem").select(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("line_id"))
    return dedupe.duplicate_count(li, "line_id")


@query
def new_since_landed(spark, sf):
    """What arrives after the middle of the log against the ids landed before."""
    e = ingest.decode(raw_log(spark, sf), ["event_id"]).select("offset", "arrived_at", "event.event_id") \
        .where(F.col("event_id").isNotNull())
    cut = F.timestamp_seconds(middle(raw_log(spark, sf)))
    landed = e.where(F.col("arrived_at") < cut).select("event_id").distinct()
    return dedupe.not_landed(e.where(F.col("arrived_at") >= cut), landed).select("event_id", "offset")


@query
def late_events(spark, sf):
    marked = quality.with_marks(quality.positions(raw_log(spark, sf), OPTIONS), OPTIONS)
    return marked.select("partition", "offset", stamp(F.col("mark")).alias("mark"),
                         quality.is_late(F.col("mark"), OPTIONS).alias("is_late"))


@query
def arrival_index(spark, sf):
    raw = raw_log(spark, sf).select("source", "offset")
    return ordered.row_index(raw, ["source"], "offset", "idx")


@query
def newest_samples(spark, sf):
    raw = raw_log(spark, sf).select("source", "offset", stamp(F.col("arrived_at")).alias("arrived_at"))
    return ordered.newest(raw, ["source"], "offset", 1000)


@query
def probe_sample(spark, sf):
    raw = raw_log(spark, sf).select("source", *ORDER)
    return breaker.probe_sample(raw, ["source"], ORDER, 50).select("source", "offset")


# --- error rates, breaker, incidents ---------------------------------------------

@query
def error_rate_tumbling(spark, sf):
    return windows.tumbling_error_rate(checked(spark, sf), ["source"], "arrived_at", BAD, 6 * HOUR) \
        .withColumn("error_rate", F.round("error_rate", 6))


@query
def error_rate_sliding(spark, sf):
    return windows.sliding_error_rate(checked(spark, sf), ["source"], "arrived_at", BAD, 6 * HOUR, HOUR) \
        .withColumn("error_rate", F.round("error_rate", 6))


@query
def error_rate_moving(spark, sf):
    return windows.moving_sums(failed_slices(spark, sf), ["source"], 6 * HOUR, HOUR) \
        .withColumn("window_rate", F.round("window_rate", 6))


@query
def breaker_states(spark, sf):
    return breaker.breaker_states(failed_slices(spark, sf), BREAKER)


@query
def incidents(spark, sf):
    rows = breaker.incidents(breaker.breaker_states(failed_slices(spark, sf), BREAKER))
    return printable(rows.withColumn("error_rate", F.round("error_rate", 6)))


@query
def alert_feed(spark, sf):
    return printable(breaker.alerts(breaker.incidents(
        breaker.breaker_states(failed_slices(spark, sf), BREAKER))))


@query
def control_signals(spark, sf):
    return printable(breaker.control_signals(breaker.breaker_states(failed_slices(spark, sf), BREAKER)))


@query
def incident_context(spark, sf):
    sliced = failed_slices(spark, sf)
    rows = breaker.incidents(breaker.breaker_states(sliced, BREAKER))
    return printable(breaker.incident_context(rows, sliced).withColumn("error_rate", F.round("error_rate", 6)))


@query
def gated_events(spark, sf):
    c = checked(spark, sf)
    states = breaker.breaker_states(windows.slices(c, ["source"], "arrived_at", BAD, HOUR), BREAKER)
    gated = breaker.gate(c.select("source", "offset", "arrived_at"), states, "arrived_at", options=BREAKER,
                         spread_by=["offset"])
    return gated.select("source", "offset", "gate")


@query
def released_events(spark, sf):
    """Events diverted while their source was open, and when it closed."""
    c = checked(spark, sf)
    states = breaker.breaker_states(windows.slices(c, ["source"], "arrived_at", BAD, HOUR), BREAKER)
    return breaker.released(raw_log(spark, sf).select("source", "offset", "arrived_at"), states, "arrived_at", options=BREAKER,
                            spread_by=["offset"]).select("source", "offset", "slice", "released_at")


@query
def volume_anomalies(spark, sf):
    out = windows.volume_anomalies(raw_log(spark, sf), ["source"], "arrived_at", HOUR, history=24, threshold=2.5)
    return out.withColumn("z_score", F.round("z_score", 6))


@query
def value_anomalies(spark, sf):
    li = table(spark, sf, "lineitem").select("l_partkey", "l_orderkey", "l_linenumber", "l_extendedprice")
    out = windows.value_anomalies(li, ["l_partkey"], "l_extendedprice", 2.0, 10,
                                  spread_by=["l_orderkey", "l_linenumber"])
    return out.withColumn("z_score", F.round("z_score", 5))


# --- metrics ---------------------------------------------------------------------

@query
def fault_statistics(spark, sf):
    out = metrics.fault_statistics(raw_log(spark, sf), RATES.resolved())
    return out.select("fault_mode", "events", dbl("observed_pct", 6), "configured_pct", "total_events",
                      "clean_events", "faulty_events", dbl("overall_faulty_pct", 6))


@query
def faults_by_type(spark, sf):
    return metrics.faults_by_type(raw_log(spark, sf))


def latencies(spark, sf, more: list[Column] = []) -> DataFrame:
    e = ingest.decode(raw_log(spark, sf), ["event_time"])
    ts = times.prefix_time(F.col("event.event_time"))
    return e.select("source", "offset", *more, times.latency_ms(F.col("arrived_at"), ts).alias("latency"))


@query
def latency_percentiles(spark, sf):
    out = metrics.latency_summary(latencies(spark, sf), "latency")
    return out.select("samples", *[dbl(c, 6) for c in ("avg", "p50", "p95", "p99", "max")])


@query
def latency_by_source(spark, sf):
    return metrics.exact_percentiles(latencies(spark, sf), "latency", [0.5, 0.95, 0.99], ["source"]) \
        .withColumn("value", F.round("value", 6))


@query
def shipping_delay_percentiles(spark, sf):
    """Days from order to shipment by order priority: a join of two large
    tables on the order key, then exact percentiles per group."""
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_shipdate")
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderdate", "o_orderpriority")
    joined = li.join(o, li.l_orderkey == o.o_orderkey)
    days = joined.select("o_orderpriority", F.datediff("l_shipdate", "o_orderdate").cast("double").alias("days"))
    return metrics.exact_percentiles(days, "days", [0.05, 0.5, 0.95], ["o_orderpriority"]) \
        .withColumn("value", F.round("value", 6))


@query
def latency_histogram(spark, sf):
    seconds = latencies(spark, sf).withColumn("seconds", F.col("latency") / 1000.0)
    out = metrics.histogram(seconds, "seconds", metrics.CONSUMER_BOUNDS)
    return out.select(F.col("le").cast("string").alias("le"), "cumulative")


@query
def producer_histogram(spark, sf):
    seconds = latencies(spark, sf).withColumn("seconds", F.col("latency") / 1000.0)
    out = metrics.histogram(seconds, "seconds", metrics.PRODUCER_BOUNDS, ["source"])
    return out.withColumn("le", F.when(F.col("le") == float("inf"), None).otherwise(F.col("le")))


@query
def histogram_quantiles(spark, sf):
    seconds = latencies(spark, sf).withColumn("seconds", F.col("latency") / 1000.0)
    buckets = metrics.histogram(seconds, "seconds", metrics.CONSUMER_BOUNDS, ["source"])
    return metrics.histogram_quantile(buckets, [0.5, 0.95, 0.99], ["source"]) \
        .withColumn("value", F.round("value", 4))


def polled_buckets(spark, sf) -> DataFrame:
    """Latency buckets per source as an hourly poll would see them; the counters start anew every day, and hours without
    latencies were not polled."""
    seconds = latencies(spark, sf, [windows.slice_start(F.col("arrived_at"), HOUR).alias("at")]) \
        .where(F.col("latency").isNotNull()).withColumn("seconds", F.col("latency") / 1000.0)
    hourly = metrics.histogram(seconds, "seconds", metrics.CONSUMER_BOUNDS, ["source", "at"])
    w = W.partitionBy("source", "le", F.floor(F.col("at") / 86400)).orderBy("at").rowsBetween(W.unboundedPreceding, 0)
    return hourly.select("source", "le", "at", F.sum("cumulative").over(w).alias("count"))


@query
def bucket_increases(spark, sf):
    out = metrics.counter_increase(polled_buckets(spark, sf), ["source", "le"], 6 * HOUR, 3 * HOUR)
    return out.select("source", F.when(F.col("le") < float("inf"), F.col("le")).alias("le"), "at", dbl("increase", 6))


@query
def quantiles_over_time(spark, sf):
    """Latency quantiles of all sources over the last six hours, every three hours."""
    out = metrics.quantiles_of_increase(polled_buckets(spark, sf), [0.5, 0.95, 0.99], [], 6 * HOUR, 3 * HOUR, per=["source"])
    return out.withColumn("value", F.round("value", 4))


@query
def ingestion_delay(spark, sf):
    b = bronze(spark, sf)
    delay = times.delay_ms(F.col("ingestion_time").cast("timestamp"), F.col("event_time").cast("timestamp"))
    return b.groupBy("payment_status").agg(
        F.count(delay).alias("events"), F.round(F.min(delay), 4).alias("min_ms"),
        F.round(F.max(delay), 4).alias("max_ms"))


def middle(raw: DataFrame) -> Column:
    """The full hour (epoch seconds) in the middle of the log's time range."""
    us = F.unix_micros("arrived_at")
    return raw.agg((F.floor((F.min(us) + F.max(us)) / F.lit(2 * HOUR * 1_000_000)) * HOUR).alias("cut")).scalar()


def committed_offsets(spark, sf) -> tuple[DataFrame, DataFrame]:
    """High watermarks per log partition; commits of a reader that stopped in
    the middle of the log and never committed partition 2."""
    raw = raw_log(spark, sf)
    read = F.unix_micros("arrived_at") < middle(raw) * 1_000_000
    high = raw.groupBy("partition").agg((F.max("offset") + 1).alias("high"))
    seen = raw.where(read & (F.col("partition") < 2))
    return high, seen.groupBy("partition").agg((F.max("offset") + 1).alias("committed"))


@query
def lag_report(spark, sf):
    return metrics.consumer_lag(*committed_offsets(spark, sf))


@query
def lag_totals(spark, sf):
    return metrics.lag_totals(metrics.consumer_lag(*committed_offsets(spark, sf)))


TOPIC = "checkout-events"
GROUPS = {"bronze-writer": 3, "audit-reader": 7, "idle-reader": 0}   # hours between commits; 0: never commits


def offsets_over_time(spark, sf) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Hourly high watermarks per partition, the commits of the groups, and which group reads the topic.

    A group commits what it saw up to an hour before; the audit reader does not read partition 2.
    """
    hour = windows.slice_start(F.col("arrived_at"), HOUR) + HOUR
    hourly = raw_log(spark, sf).groupBy("partition", hour.alias("at")).agg((F.max("offset") + 1).alias("high"))
    upto = W.partitionBy("partition").orderBy("at").rowsBetween(W.unboundedPreceding, 0)
    polls = hourly.select(F.lit(TOPIC).alias("topic"), "partition", "at", F.max("high").over(upto).alias("high"))
    takes = [(F.col("at") % (every * HOUR) == 0) & (F.lit(group != "audit-reader") | (F.col("partition") < 2))
             for group, every in GROUPS.items() if every]
    who = F.explode(F.array_compact(F.array(*[F.when(t, F.lit(g)) for t, (g, every) in zip(takes, (x for x in GROUPS.items() if x[1]))])))
    commits = polls.select("topic", "partition", who.alias("group"), (F.col("at") + HOUR).alias("at"), F.col("high").alias("committed"))
    members = polls.select("topic").distinct().select("topic", F.explode(F.array(*map(F.lit, GROUPS))).alias("group"))
    return polls, commits, members


@query
def lag_over_time(spark, sf):
    return metrics.lag_over_time(*offsets_over_time(spark, sf))


@query
def throughput(spark, sf):
    out = windows.throughput(raw_log(spark, sf), "arrived_at", F.col("fault_mode").isNotNull(), HOUR)
    return out.select("slice", "total", "generated", "errors", dbl("current_rate", 8),
                      dbl("average_rate", 8), dbl("error_pct", 6))


def polls(spark, sf) -> DataFrame:
    """Row counts per source as an hourly poll would see them, also in hours without rows."""
    per = raw_log(spark, sf).groupBy("source", windows.slice_start(F.col("arrived_at"), HOUR).alias("slice")) \
        .agg(F.count(F.lit(1)).alias("n"))
    per = windows.fill_slices(per, ["source"], HOUR, "n").withColumnRenamed("slice", "at")
    w = W.partitionBy("source").orderBy("at").rowsBetween(W.unboundedPreceding, 0)
    return per.select("source", "at", F.sum("n").over(w).alias("count"))


@query
def count_monitor(spark, sf):
    return windows.count_monitor(polls(spark, sf), ["source"]).withColumn("rate", F.round("rate", 8))


@query
def overall_trend(spark, sf):
    return windows.overall_trend(polls(spark, sf), ["source"])


@query
def interval_rate(spark, sf):
    """Rates of a counter that restarts every day."""
    daily = raw_log(spark, sf).groupBy("source", windows.slice_start(F.col("arrived_at"), HOUR).alias("at")) \
        .agg(F.count(F.lit(1)).alias("n"))
    day = F.floor(F.col("at") / 86400)
    w = W.partitionBy("source", day).orderBy("at").rowsBetween(W.unboundedPreceding, 0)
    samples = daily.select("source", "at", F.sum("n").over(w).alias("count"))
    return windows.counter_rate(samples, ["source"]).withColumn("rate", F.round("rate", 8))


@query
def recovery_continuity(spark, sf):
    """Counts of each source and hour of day before a stop in the middle of the
    log, one hour and twelve hours after it; hours of the other half day do not grow."""
    raw = raw_log(spark, sf)
    cut, at = middle(raw), F.unix_micros("arrived_at")
    hour = F.hour("arrived_at").cast("long").alias("hour")
    upto = lambda hours: F.count_if(at < (cut + F.lit(hours * HOUR)) * 1_000_000)
    counts = raw.groupBy("source", hour).agg(upto(0).alias("b"), upto(1).alias("a"), upto(12).alias("l"))
    samples = counts.select("source", "hour", F.expr(
        "stack(3, 'before', b, 'after', a, 'later', l) as (phase, count)"))
    return windows.recovery_continuity(samples, ["source", "hour"])


@query
def gold_metrics(spark, sf):
    b = bronze(spark, sf).where(F.col("event_time").isNotNull())
    out = windows.gold_metrics(b, "event_time", ["product_id", "payment_status"], "amount", "customer_id")
    return printable(out)


@query
def gold_line_revenue(spark, sf):
    """The same roll-up over line items, by ship day and line status."""
    li = table(spark, sf, "lineitem").withColumn("money", F.col("l_extendedprice").cast(model.MONEY))
    out = windows.gold_metrics(li, "l_shipdate", ["l_returnflag", "l_linestatus"], "money", "l_suppkey")
    return printable(out)


@query
def flexible_timestamps(spark, sf):
    """Event times written in six forms by row, parsed back."""
    e = table(spark, sf, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"))
    form = F.col("event_id") % 8
    secs = F.floor(F.unix_micros("ts") / 1_000_000)
    iso = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    text = (F.when(form == 0, secs.cast("string")).when(form == 1, (secs * 1000 + 250).cast("string"))
            .when(form == 2, F.concat(F.lit('"'), iso, F.lit('Z"')))
            .when(form == 3, F.concat(F.lit('"'), iso, F.lit('+05:30"')))
            .when(form == 4, F.concat(F.lit('"'), iso, F.lit('.125"')))
            .when(form == 5, F.lit('"soon"')).when(form == 6, F.lit("null")).otherwise(F.lit('""')))
    fallback = F.when(form == 6, secs.cast("string")).otherwise(F.lit("null"))
    parsed = times.flexible_time(F.try_parse_json(text), F.try_parse_json(fallback))
    return e.select("event_id", stamp(parsed).alias("parsed"))


@query
def synthetic_events(spark, sf):
    ids = table(spark, sf, "events").select(F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("ts"))
    return printable(chaos.synthesize(ids, seed=1).drop("id", "ts"))


@query
def extracted_digits(spark, sf):
    c = table(spark, sf, "customer")
    return c.select("c_custkey", P.digits_as_long(F.col("c_name"), 123).alias("digits"),
                    P.negated(F.col("c_acctbal"), 1499.0).alias("negated"))


# --- contracts ---------------------------------------------------------------------

def daily_contracts(spark, sf) -> DataFrame:
    """Written down, a row per day and field, as the comparison of versions needs it several times."""
    day = F.date_format("arrived_at", "yyyy-MM-dd")
    return settled(compatibility.observed_contracts(raw_log(spark, sf), day, ["payment_method", "payment_status"]), "daily-contracts")


@query
def observed_contracts(spark, sf):
    out = daily_contracts(spark, sf)
    return out.select("schema_version", "field", "type", "required",
                      F.array_join("enum", ",").alias("enum"))


@query
def contract_changes(spark, sf):
    daily = daily_contracts(spark, sf)
    return compatibility.compare(daily, compatibility.consecutive_pairs(daily))


@query
def field_lifetimes(spark, sf):
    return compatibility.lifetimes(daily_contracts(spark, sf)).withColumn("enum", F.array_join("enum", ","))


@query
def contract_changes_any(spark, sf):
    """Changes between each day and every later one."""
    daily = daily_contracts(spark, sf)
    return compatibility.compare_any(daily, compatibility.all_pairs(daily))


@query
def contract_verdicts(spark, sf):
    daily = daily_contracts(spark, sf)
    pairs = compatibility.consecutive_pairs(daily)
    return compatibility.verdicts(pairs, compatibility.compare(daily, pairs))


@query
def contract_breaks_published(spark, sf):
    daily = daily_contracts(spark, sf)
    changes = compatibility.compare(daily, compatibility.consecutive_pairs(daily))
    return compatibility.breaking_events(changes).drop("published_at")


@query
def contract_drift(spark, sf):
    observed = compatibility.observed_fields(raw_log(spark, sf))
    return compatibility.drift(observed, registry.checkout_contracts(spark))


@query
def contract_lint(spark, sf):
    """Contract documents derived from parts, with one defect in most of them."""
    p = table(spark, sf, "part").select("p_partkey", digest(F.col("p_partkey"), "doc").alias("d"))
    n = draw(F.col("d"), 0) % 10
    version = F.when(n == 0, '""').otherwise(F.concat(F.lit('"p'), F.col("p_partkey").cast("string"), F.lit('"')))
    kind = F.when(n == 1, '"money"').when(n == 2, "7").otherwise('"float"')
    required = F.when(n == 3, '"yes"').otherwise("true")
    enum = F.when(n == 4, ',"enum":[]').when(n == 5, ',"enum":["A",1]').when(n == 6, ',"enum":["A","B"]').otherwise("")
    definition = F.when(n == 7, "null").otherwise(
        F.concat(F.lit('{"type":'), kind, F.lit(',"required":'), required, enum, F.lit("}")))
    text = F.concat(F.lit('{"schema_version":'), version, F.lit(',"fields":{"id":{"type":"string"},"amount":'),
                    definition, F.lit("}}"))
    text = F.when(n == 8, "[1]").when(n == 9, F.substring(text, 1, 12)).otherwise(text)
    return registry.lint(p.select(F.col("p_partkey").cast("string").alias("document"), text.alias("text")))


# --- replay ------------------------------------------------------------------------

@query
def replayed_events(spark, sf):
    a = assessed(spark, sf)
    rejected = settled(a.where(quality.route() == "invalid").withColumnRenamed("value", "raw_payload")
                       .select("partition", "offset", "arrived_at", "raw_payload"), "quarantined")   # as a quarantine table holds them
    landed = a.where(F.size("failures") == 0).select("event_id")
    fresh, _ = replay.replay(rejected, landed, ROWS, order=ORDER)
    return fresh.select("event_id", "offset", "customer_id", F.round(F.col("amount").cast("double"), 2).alias("amount"))
