"""Live figures of a stream: rate, latency and what it is behind, one row per micro-batch.

The latency of a batch is counted in buckets while its rows pass by (observed metrics, no extra pass and no state); the
quantiles come from the buckets. How far a source is behind is the difference between its latest offsets and the batch's end.
"""

from __future__ import annotations

import ast
import json

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidewarden.operators.metrics import CONSUMER_BOUNDS, histogram_quantile

NAME = "live"
LIVE = "query STRING, batch_id BIGINT, input_rows BIGINT, rows_per_second DOUBLE, timed_rows BIGINT, buckets ARRAY<BIGINT>, behind BIGINT"


def observed(df: DataFrame, latency_ms: str, bounds: list[float] = CONSUMER_BOUNDS) -> DataFrame:
    """The stream, with its latencies counted per batch; rows without a latency count in none."""
    seconds = F.col(latency_ms) / 1000.0
    return df.observe(NAME, F.count(seconds).alias("timed"),
                      *[F.count_if(seconds <= b).alias(f"le_{i}") for i, b in enumerate(bounds)])


def _numbers(offset) -> list[int]:
    """All numbers of an offset in JSON, in order: those of topic partitions, or the one of a file log."""
    if isinstance(offset, dict):
        return [n for _, v in sorted(offset.items()) for n in _numbers(v)]
    return [int(offset)] if isinstance(offset, int) else []


def _offset(text: str | None):
    """An offset as reported: JSON, the same as a Python dict, or none."""
    if not text or text in ("null", "None"):
        return None
    try:
        return json.loads(text)
    except json.JSONDecodeError:
        return ast.literal_eval(text)


def behind(source) -> int:
    """Offsets of a source that the batch did not reach yet: messages of a log, or landed batches of a file source.

    A source that does not report its latest offset counts as reached.
    """
    latest, end = (_numbers(_offset(text)) for text in (source.latestOffset, source.endOffset))
    return sum(max(0, a - b) for a, b in zip(latest, end)) if len(latest) == len(end) else 0


def live_rows(progress: list, bounds: list[float] = CONSUMER_BOUNDS) -> list[tuple]:
    """Rows of ``LIVE`` from progress reports, of ``recentProgress`` or a listener; batches without rows have none."""
    rows = []
    for p in progress:
        seen = p.observedMetrics.get(NAME)
        if seen is None or not p.numInputRows:
            continue
        rate = p.processedRowsPerSecond
        rows.append((p.name, int(p.batchId), int(p.numInputRows), None if rate is None else float(rate), int(seen["timed"]),
                     [int(seen[f"le_{i}"]) for i in range(len(bounds))], sum(behind(s) for s in p.sources)))
    return rows


def live_metrics(rows: DataFrame, bounds: list[float] = CONSUMER_BOUNDS) -> DataFrame:
    """``LIVE`` rows with the batch's p50 and p95 in milliseconds; both are null where no row had a latency."""
    every = F.array(*[F.lit(b) for b in [*bounds, float("inf")]])
    counts = F.concat("buckets", F.array("timed_rows"))
    buckets = rows.select("query", "batch_id", F.explode(F.arrays_zip(every.alias("le"), counts.alias("cumulative"))).alias("b")) \
        .select("query", "batch_id", "b.le", "b.cumulative")
    points = histogram_quantile(buckets, [0.5, 0.95], ["query", "batch_id"]).groupBy("query", "batch_id").agg(
        *[F.max(F.when(F.col("quantile") == q, F.col("value"))).alias(n) for q, n in ((0.5, "p50_ms"), (0.95, "p95_ms"))])
    same = F.col("l.query").eqNullSafe(F.col("r.query")) & (F.col("l.batch_id") == F.col("r.batch_id"))
    return rows.alias("l").join(points.alias("r"), same, "left").select("l.*", "r.p50_ms", "r.p95_ms").drop("buckets")


def table(spark: SparkSession, progress: list) -> DataFrame:
    return live_metrics(spark.createDataFrame(live_rows(progress), LIVE))
