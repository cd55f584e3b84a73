"""Time-window operators: error rates, anomalies, trends over counters.

Rows are always summed into fixed time slices first. A slice table has one row
per key and slice, however many events a key has, so what follows scales with
the time range and not with the volume.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tidewarden.operators.ordered import running_sums
from tidewarden.operators.skew import attach


def slice_start(ts: Column, seconds: int) -> Column:
    """Start of the slice a timestamp falls in, as epoch seconds."""
    return F.floor(F.unix_micros(ts) / F.lit(1_000_000 * seconds)).cast("long") * seconds


def slices(df: DataFrame, keys: list[str], ts: str, bad: Column | str, seconds: int = 10) -> DataFrame:
    """(keys, slice, total, bad): counts per fixed time slice.

    ``bad`` is a condition, as a column or as SQL text.
    """
    bad = F.expr(bad) if isinstance(bad, str) else bad
    return (df.groupBy(*keys, slice_start(F.col(ts), seconds).alias("slice"))
            .agg(F.count(F.lit(1)).alias("total"),
                 F.sum(F.when(bad, 1).otherwise(0)).cast("long").alias("bad")))


def _rated(df: DataFrame) -> DataFrame:
    return df.withColumn("error_rate", F.col("bad") / F.col("total"))


def tumbling_error_rate(df: DataFrame, keys: list[str], ts: str, bad: Column | str,
                        seconds: int = 60) -> DataFrame:
    """Failed / total per key and tumbling window."""
    return _rated(slices(df, keys, ts, bad, seconds).withColumnRenamed("slice", "window_start"))


def sliding_error_rate(df: DataFrame, keys: list[str], ts: str, bad: Column | str,
                       seconds: int = 60, step: int = 10) -> DataFrame:
    """Failed / total per key and sliding window; ``step`` divides the window.

    A window covers [start, start + seconds). Windows without events are absent.
    """
    if seconds % step:
        raise ValueError("the step must divide the window length")
    base = slices(df, keys, ts, bad, step)
    starts = F.sequence(F.col("slice") - (seconds - step), F.col("slice"), F.lit(step).cast("long"))
    return _rated(base.select(*keys, "total", "bad", F.explode(starts).alias("window_start"))
                  .groupBy(*keys, "window_start")
                  .agg(F.sum("total").alias("total"), F.sum("bad").alias("bad")))


def moving_sums(sliced: DataFrame, keys: list[str], seconds: int = 60, step: int = 10) -> DataFrame:
    """Per slice: the totals of the ``seconds`` that end with it."""
    w = W.partitionBy(*keys).orderBy("slice").rangeBetween(-(seconds - step), 0)
    return (sliced.withColumn("window_total", F.sum("total").over(w))
            .withColumn("window_bad", F.sum("bad").over(w))
            .withColumn("window_rate", F.col("window_bad") / F.col("window_total")))


def fill_slices(counts: DataFrame, keys: list[str], seconds: int, count: str) -> DataFrame:
    """One row per key and slice from the key's first slice to the newest of all keys; silent slices count zero."""
    newest = counts.agg(F.max("slice")).scalar()
    every = counts.groupBy(*keys).agg(F.min("slice").alias("_first")).select(
        *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)],
        F.explode(F.sequence("_first", newest, F.lit(seconds).cast("long"))).alias("_at"))
    same = F.col("_at") == F.col("slice")
    for i, k in enumerate(keys):
        same &= F.col(f"_k{i}").eqNullSafe(F.col(k))
    return every.join(counts, same, "left").select(
        *[F.col(f"_k{i}").alias(k) for i, k in enumerate(keys)], F.col("_at").alias("slice"),
        F.coalesce(count, F.lit(0)).alias(count))


def volume_anomalies(df: DataFrame, keys: list[str], ts: str, seconds: int = 60,
                     history: int = 30, threshold: float = 3.0, min_history: int = 5) -> DataFrame:
    """Slices whose count lies far off the trailing slices of their key.

    A slice without rows counts zero, so a key that falls silent is seen.
    ``z_score`` uses the mean and the sample deviation of up to ``history``
    earlier slices. It is NULL before ``min_history`` slices or when those do
    not vary, and such a slice is no anomaly.
    """
    counts = df.groupBy(*keys, slice_start(F.col(ts), seconds).alias("slice")) \
        .agg(F.count(F.lit(1)).alias("events"))
    counts = fill_slices(counts, keys, seconds, "events")
    w = W.partitionBy(*keys).orderBy("slice").rowsBetween(-history, -1)
    scored = (counts.withColumn("_n", F.count(F.lit(1)).over(w))
              .withColumn("_mean", F.avg("events").over(w))
              .withColumn("_std", F.stddev_samp("events").over(w)))
    z = F.when((F.col("_n") >= min_history) & (F.col("_std") > 0),
               (F.col("events") - F.col("_mean")) / F.col("_std"))
    return scored.withColumn("z_score", z).withColumn(
        "is_anomaly", F.coalesce(F.abs("z_score") > threshold, F.lit(False))) \
        .drop("_n", "_mean", "_std")


def value_anomalies(df: DataFrame, keys: list[str], value: str, threshold: float = 3.0,
                    min_rows: int = 10, spread_by: list[str] | None = None) -> DataFrame:
    """Rows whose value lies outside mean +- threshold * deviation of their key."""
    stats = df.groupBy(*keys).agg(F.count(value).alias("_n"), F.avg(value).alias("_mean"),
                                  F.stddev_samp(value).alias("_std"))
    scored = attach(df, stats, keys, "_n", spread_by=spread_by)
    z = F.when((F.col("_n") >= min_rows) & (F.col("_std") > 0),
               (F.col(value) - F.col("_mean")) / F.col("_std"))
    return scored.withColumn("z_score", z).drop("_n", "_mean", "_std") \
        .where(F.abs("z_score") > threshold)


def count_monitor(samples: DataFrame, keys: list[str], ts: str = "at", count: str = "count") -> DataFrame:
    """Growth, rate and status between successive samples of a counter.

    ``samples`` holds one row per key and poll; ``at`` is in epoch seconds.
    """
    w = W.partitionBy(*keys).orderBy(ts)
    last, then = F.lag(count).over(w), F.lag(ts).over(w)
    delta = F.col(count) - last
    status = (F.when(last.isNull(), "INITIAL").when(delta > 0, "INCREASING")
              .when(delta == 0, "STABLE").otherwise("DECREASING"))
    rate = F.when(F.col(ts) > then, delta / (F.col(ts) - then))
    return samples.withColumn("delta", delta).withColumn("rate", rate).withColumn("status", status)


def overall_trend(samples: DataFrame, keys: list[str], ts: str = "at", count: str = "count") -> DataFrame:
    """First, last and growth of a counter, and whether it grew at any time."""
    agg = samples.groupBy(*keys).agg(
        F.min_by(count, ts).alias("initial_count"), F.max_by(count, ts).alias("final_count"),
        (F.max(count) > F.min(count)).alias("_varied"))
    grew = (F.col("final_count") > F.col("initial_count")) | F.col("_varied")
    return agg.withColumn("growth", F.col("final_count") - F.col("initial_count")) \
        .withColumn("trend", F.when(grew, "INCREASING").otherwise("NOT INCREASING")).drop("_varied")


def counter_rate(samples: DataFrame, keys: list[str], ts: str = "at", count: str = "count") -> DataFrame:
    """Per-second rate of a growing counter; a reset counts from zero."""
    w = W.partitionBy(*keys).orderBy(ts)
    last, then = F.lag(count).over(w), F.lag(ts).over(w)
    grown = F.when(F.col(count) >= last, F.col(count) - last).otherwise(F.col(count))
    return samples.withColumn("rate", F.when(F.col(ts) > then, grown / (F.col(ts) - then)))


def recovery_continuity(samples: DataFrame, keys: list[str], ts: str = "at",
                        count: str = "count") -> DataFrame:
    """Whether a counter never fell and grew after its last restart.

    ``samples`` has a ``phase``: before, after, later.
    """
    pick = {p: F.max(F.when(F.col("phase") == p, F.col(count))) for p in ("before", "after", "later")}
    agg = samples.groupBy(*keys).agg(*[c.alias(p) for p, c in pick.items()])
    return agg.withColumn("continuous", (F.col("after") >= F.col("before"))
                          & (F.col("later") > F.col("after")))


THROUGHPUT_BLOCK = 1 << 16   # intervals that are added up by one task


def throughput(df: DataFrame, ts: str, bad: Column | str, seconds: int = 1, block: int = THROUGHPUT_BLOCK) -> DataFrame:
    """Per interval: current rate, average rate since the start, error percent.

    The running sums go over the interval table, one row per interval, in two
    levels: ``block`` intervals at a time, and one row per block.
    """
    base = slices(df, [], ts, bad, seconds)
    first = base.agg(F.min("slice").alias("_start"))
    base = attach(base.withColumn("_one", F.lit(1)), first.withColumn("_one", F.lit(1)), ["_one"], None)
    run = running_sums(base, [], "slice", {"generated": "total", "errors": "bad"}, block * seconds)
    elapsed = F.greatest(F.lit(0.001), (F.col("slice") + seconds - F.col("_start")).cast("double"))
    return run.select(
        "slice", "total", "generated", "errors",
        (F.col("total") / F.lit(float(seconds))).alias("current_rate"),
        (F.col("generated") / elapsed).alias("average_rate"),
        (F.col("errors") / F.col("generated") * 100.0).alias("error_pct"))


def gold_metrics(df: DataFrame, ts: str, keys: list[str], amount: str, customer: str) -> DataFrame:
    """Hourly business totals per key combination.

    Distinct customers are counted from (hour, keys, customer) groups, so a
    busy hour is first collapsed by the partial aggregate.
    """
    hour = F.date_trunc("hour", F.col(ts)).alias("hour")
    per_customer = df.groupBy(hour, *keys, customer).agg(
        F.count(F.lit(1)).alias("_events"), F.sum(amount).alias("_revenue"),
        F.count(amount).alias("_paid"))
    return per_customer.groupBy("hour", *keys).agg(
        F.sum("_events").alias("events"), F.count(customer).alias("customers"),
        F.sum("_revenue").alias("revenue"),
        (F.sum("_revenue").cast("double") / F.sum("_paid")).alias("avg_amount"))
