"""Operational metrics as tables: fault rates, latencies, histograms, lag."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tidewarden import model
from tidewarden.operators.ordered import asof
from tidewarden.operators.skew import attach

# Histogram bounds in seconds.
PRODUCER_BOUNDS = [0.0005, 0.001, 0.0025, 0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5]
CONSUMER_BOUNDS = [0.001, 0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0]


def completeness(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Row count and non-null count per column, one row."""
    return df.agg(F.count(F.lit(1)).alias("total"),
                  *[F.count(c).alias(f"{c}_count") for c in columns or df.columns])


def null_presence(df: DataFrame, columns: list[str]) -> DataFrame:
    """Whether each column holds a NULL anywhere."""
    return df.agg(*[F.coalesce(F.max(F.col(c).isNull()), F.lit(False)).alias(f"{c}_has_null")
                    for c in columns])


def fault_statistics(labelled: DataFrame, rates: dict[str, float], mode: str = "fault_mode") -> DataFrame:
    """Observed against configured percent per fault mode.

    One pass of conditional counts, then one row per mode; a mode that never
    fired shows zero. All shares are 0.0 on an empty input.
    """
    modes = list(rates)
    agg = labelled.agg(F.count(F.lit(1)).alias("total_events"),
                       F.count(mode).alias("faulty_events"),
                       *[F.count(F.when(F.col(mode) == m, 1)).alias(m) for m in modes])
    per_mode = F.explode(F.array(*[F.struct(F.lit(m).alias("fault_mode"), F.col(m).alias("events"),
                                            F.lit(float(rates[m])).alias("configured_pct"))
                                   for m in modes])).alias("m")

    def percent(part: Column) -> Column:
        return F.when(F.col("total_events") > 0, part / F.col("total_events") * 100.0).otherwise(0.0)

    return agg.select("total_events", "faulty_events", per_mode).select(
        "m.fault_mode", "m.events", percent(F.col("m.events")).alias("observed_pct"), "m.configured_pct",
        "total_events", (F.col("total_events") - F.col("faulty_events")).alias("clean_events"),
        "faulty_events", percent(F.col("faulty_events")).alias("overall_faulty_pct"))


def faults_by_type(labelled: DataFrame, mode: str = "fault_mode") -> DataFrame:
    return labelled.where(F.col(mode).isNotNull()).groupBy(F.col(mode).alias("fault_type")) \
        .agg(F.count(F.lit(1)).alias("faults"))


# The 64 bits of a value are read from the top: 24 bits, 20 more, and the rest. A digit has at most 2^24 values.
DIGITS = (40, 20)


def ordered_bits(value: Column) -> Column:
    """The bits of a double as a long that sorts like it; NaN comes last."""
    bits = F.call_function("java_method", F.lit("java.lang.Double"), F.lit("doubleToLongBits"), value + F.lit(0.0)).cast("long")
    return F.when(bits < 0, bits.bitwiseXOR(F.lit(2 ** 63 - 1))).otherwise(bits)


def _holding(sums: DataFrame, by: list[str]) -> DataFrame:
    """The digits ``_p`` in which wanted ranks ``_t`` lie, each with its ranks counted from the digit's first value."""
    before = F.coalesce(F.sum("_s").over(W.partitionBy(*by).orderBy("_p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    inside = F.transform(F.filter("_t", lambda t: (t["r"] >= F.col("_before")) & (t["r"] < F.col("_before") + F.col("_s"))),
                         lambda t: F.struct(t["i"].alias("i"), t["quantile"].alias("quantile"), (t["r"] - F.col("_before")).alias("r"),
                                            t["share"].alias("share")))
    return sums.withColumn("_before", before).withColumn("_t", inside).where(F.size("_t") > 0)


def _within(counts: DataFrame, wanted: DataFrame, keys: list[str], shift: int) -> DataFrame:
    """The counted values whose bits from ``shift`` on are wanted, with the wanted ranks."""
    names = [f"_w{j}" for j in range(len(keys))]
    right = wanted.select(*[F.col(k).alias(n) for k, n in zip(keys, names)], F.col("_p").alias("_in"), "_t")
    same = F.shiftright("_b", shift) == F.col("_in")
    for k, n in zip(keys, names):
        same &= F.col(k).eqNullSafe(F.col(n))
    return counts.join(right, same).drop(*names)


def exact_percentiles(df: DataFrame, value: str, quantiles: list[float], keys: list[str] | None = None) -> DataFrame:
    """Exact percentiles with linear interpolation: (keys, quantile, value).

    An exact percentile aggregate would hold every distinct value of a group in
    one task. Here the values are counted, so a tied group is one row, and the
    wanted ranks are found by radix selection: the counts are summed by the
    values' first bits, then, only where a wanted rank lies, by the next bits,
    and only the values that share these are ranked. Which bits a value has
    depends on nothing but the value, so each step may be computed anew.
    """
    keys = keys or []
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).cast("double").alias("_v")) \
        .agg(F.count(F.lit(1)).alias("_k")).withColumn("_b", ordered_bits(F.col("_v")))
    rank = lambda q: F.lit(float(q)) * (F.col("_n") - 1)
    ranks = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(float(q)).alias("quantile"), end(rank(q)).alias("r"),
                               (rank(q) - F.floor(rank(q))).alias("share"))
                      for i, q in enumerate(quantiles) for end in (F.floor, F.ceil)])
    sums = counts.groupBy(*keys, F.shiftright("_b", DIGITS[0]).alias("_p")).agg(F.sum("_k").alias("_s"))
    wanted = _holding(sums.withColumn("_n", F.sum("_s").over(W.partitionBy(*keys))).withColumn("_t", ranks), keys)
    for above, shift in zip(DIGITS, DIGITS[1:]):
        sums = _within(counts, wanted, keys, above).groupBy(*keys, "_in", F.shiftright("_b", shift).alias("_p")) \
            .agg(F.sum("_k").alias("_s"), F.first("_t").alias("_t"))
        wanted = _holding(sums, [*keys, "_in"])
    values = _within(counts, wanted, keys, DIGITS[-1]).select(*keys, "_in", F.col("_v").alias("_p"), F.col("_k").alias("_s"), "_t")
    hit = _holding(values, [*keys, "_in"])
    found = hit.select(*keys, F.col("_p").alias("_v"), F.explode("_t").alias("_t")).groupBy(*keys, "_t.i", "_t.quantile", "_t.share") \
        .agg(F.min("_v").alias("_l"), F.max("_v").alias("_h"))
    return found.select(*keys, "quantile", (F.col("_l") + (F.col("_h") - F.col("_l")) * F.col("share")).alias("value"))


def latency_summary(df: DataFrame, latency: str) -> DataFrame:
    """avg, p50, p95, p99 and max in one row; all 0.0 on an empty input."""
    per = exact_percentiles(df, latency, [0.5, 0.95, 0.99])
    points = per.agg(*[F.max(F.when(F.col("quantile") == q, F.col("value"))).alias(n)
                       for n, q in [("p50", 0.5), ("p95", 0.95), ("p99", 0.99)]])
    plain = df.agg(F.count(latency).alias("samples"), F.avg(latency).alias("avg"), F.max(latency).alias("max"))
    both = attach(plain.withColumn("_one", F.lit(1)), points.withColumn("_one", F.lit(1)), ["_one"], None)
    return both.select("samples", *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c)
                                    for c in ("avg", "p50", "p95", "p99", "max")])


def histogram(df: DataFrame, value: str, bounds: list[float], keys: list[str] | None = None) -> DataFrame:
    """Cumulative buckets (keys, le, cumulative); the last bound is infinity.

    One pass of conditional counts: rows are not multiplied by the buckets.
    """
    keys = keys or []
    every = [*bounds, float("inf")]
    agg = df.groupBy(*keys).agg(*[F.count(F.when(F.col(value) <= b, 1)).alias(f"_b{i}")
                                  for i, b in enumerate(every)])
    return agg.select(*keys, F.explode(F.array(*[
        F.struct(F.lit(b).alias("le"), F.col(f"_b{i}").alias("cumulative"))
        for i, b in enumerate(every)])).alias("_x")).select(*keys, "_x.*")


def histogram_quantile(buckets: DataFrame, quantiles: list[float], keys: list[str] | None = None,
                       scale: float = 1000.0) -> DataFrame:
    """Quantiles estimated from cumulative buckets by linear interpolation.

    A quantile in the infinite bucket gives the highest finite bound; an empty
    histogram gives NULL.
    """
    keys = keys or []
    one = buckets.withColumn("_one", F.lit(1))
    on = keys + ["_one"]
    w = W.partitionBy(*on).orderBy("le")
    whole = W.partitionBy(*on)
    b = (one.withColumn("_prev", F.coalesce(F.lag("cumulative").over(w), F.lit(0)))
         .withColumn("_from", F.coalesce(F.lag("le").over(w), F.lit(0.0)))
         .withColumn("_total", F.max("cumulative").over(whole)))
    wanted = b.select("*", F.explode(F.array(*[F.lit(float(q)) for q in quantiles])).alias("quantile"))
    rank = F.col("quantile") * F.col("_total")
    hit = wanted.where((F.col("cumulative") >= rank) & (F.col("_total") > 0))
    first = hit.groupBy(*on, "quantile").agg(F.min_by(
        F.struct("le", "cumulative", "_prev", "_from", "_total"), "le").alias("_f")).select(*on, "quantile", "_f.*")
    share = (rank - F.col("_prev")) / (F.col("cumulative") - F.col("_prev"))
    inner = F.when(F.col("cumulative") == F.col("_prev"), F.col("le")).otherwise(
        F.col("_from") + (F.col("le") - F.col("_from")) * share)
    value = F.when(F.col("le") == float("inf"), F.col("_from")).otherwise(inner)
    return first.select(*keys, "quantile", (value * scale).alias("value"))


def counter_increase(samples: DataFrame, keys: list[str], seconds: int, step: int, ts: str = "at", count: str = "count") -> DataFrame:
    """Increase of counters over windows: (keys, at, increase), one row per key and window end.

    ``samples`` has one row per key and poll, with the epoch second ``ts``. A window holds the samples after ``at - seconds`` up
    to ``at``, a multiple of ``step``. Where a counter falls it was reset, and what it had before is added. The increase between the first and the last
    sample is extended to the window's edges: by the distance to the edge, or by half the mean distance of samples where the edge
    is 1.1 such distances away or more; at the front not beyond the point where the counter would be zero. A
    window with fewer than two samples has no row.
    """
    series = W.partitionBy(*keys).orderBy(ts)
    last = F.lag(count).over(series)
    steps = samples.select(*keys, F.col(ts).alias("_ts"), F.col(count).cast("double").alias("_c"), F.lag(ts).over(series).alias("_prev"),
                           F.when(F.col(count) < last, last.cast("double")).otherwise(0.0).alias("_lost"))
    first_end = F.ceil(F.col("_ts") / step).cast("long") * step
    last_end = (F.ceil((F.col("_ts") + seconds) / step).cast("long") - 1) * step     # a sample is in no window from ts + seconds on
    windows = steps.where(first_end <= last_end).withColumn("at", F.explode(F.sequence(first_end, last_end, F.lit(step).cast("long"))))
    lost = F.sum(F.when(F.col("_prev") > F.col("at") - seconds, F.col("_lost")).otherwise(0.0))
    w = windows.groupBy(*keys, "at").agg(
        F.count(F.lit(1)).alias("_n"), F.min("_ts").alias("_from"), F.max("_ts").alias("_to"), F.min_by("_c", "_ts").alias("_first"),
        F.max_by("_c", "_ts").alias("_last"), lost.alias("_lost")).where(F.col("_n") > 1)
    grown = F.col("_last") - F.col("_first") + F.col("_lost")
    length = (F.col("_to") - F.col("_from")).cast("double")
    mean = length / (F.col("_n") - 1)

    def reach(to_edge: Column) -> Column:
        return F.when(to_edge < mean * 1.1, to_edge.cast("double")).otherwise(mean / 2)

    front = reach(F.col("_from") - (F.col("at") - seconds))
    to_zero = F.when((grown > 0) & (F.col("_first") >= 0), length * F.col("_first") / grown)
    front = F.least(front, F.coalesce(to_zero, front))
    return w.select(*keys, "at", (grown * (length + front + reach(F.col("at") - F.col("_to"))) / length).alias("increase"))


def quantiles_of_increase(buckets: DataFrame, quantiles: list[float], keys: list[str], seconds: int, step: int,
                          per: list[str]) -> DataFrame:
    """Quantiles over time, (keys, at, quantile, value), from polled bucket counters (per, keys, le, at, count).

    Each counter's increase over the window is taken first, then the counters of all ``per`` are added, then the quantile is
    read from the buckets. A window without increase has no row.
    """
    grown = counter_increase(buckets, [*per, *[k for k in keys if k not in per], "le"], seconds, step)
    summed = grown.groupBy(*keys, "at", "le").agg(F.sum("increase").alias("cumulative"))
    return histogram_quantile(summed, quantiles, [*keys, "at"])


def consumer_lag(partitions: DataFrame, committed: DataFrame) -> DataFrame:
    """Lag per (topic, partition): high watermark minus committed offset.

    A partition without a commit, or with a negative one, has lag 0.
    """
    on = [c for c in ("topic", "partition") if c in partitions.columns]
    joined = partitions.join(committed, on, "left")
    offset = F.coalesce(F.col("committed"), F.lit(-1))
    lag = F.when(offset < 0, F.lit(0)).otherwise(F.greatest(F.lit(0), F.col("high") - offset))
    return joined.select(*on, "high", "committed", lag.cast("long").alias("lag"))


def lag_over_time(watermarks: DataFrame, commits: DataFrame, members: DataFrame, block: int = 86_400) -> DataFrame:
    """Lag of each group at each poll: (topic, partition, group, at, high, committed, lag).

    ``watermarks`` are polls (topic, partition, at, high), ``commits`` (topic, partition, group, at, committed), times in epoch
    seconds, and ``members`` (topic, group) the groups that read a topic. A poll counts the newest commit not after it; a group
    that has not committed yet, or a negative offset, has lag 0. Time is cut into blocks of ``block`` seconds, so that a busy
    partition's polls and commits are dealt out.
    """
    polls = watermarks.join(members, "topic").select("topic", "partition", "group", "at", "high")
    joined = asof(polls, commits, ["topic", "partition", "group"], "at", ["committed"], block)
    lag = F.when(F.coalesce("committed", F.lit(-1)) < 0, F.lit(0)).otherwise(F.greatest(F.lit(0), F.col("high") - F.col("committed")))
    return joined.select("topic", "partition", "group", "at", "high", "committed", lag.cast("long").alias("lag"))


def lag_totals(lags: DataFrame) -> DataFrame:
    return lags.agg(F.coalesce(F.sum("lag"), F.lit(0)).alias("total_lag"),
                    F.coalesce(F.max("lag"), F.lit(0)).alias("max_lag"))


def fault_detection(assessed: DataFrame) -> DataFrame:
    """Injected fault modes, which the arrivals carry, against the rules that caught them."""
    return assessed.select("fault_mode", F.explode_outer("failures").alias("rule")) \
        .groupBy("fault_mode", "rule").agg(F.count(F.lit(1)).alias("events"))
