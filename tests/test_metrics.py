"""Percentiles, histograms, lag, fault statistics, trends, timestamps."""

import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewarden.functions import payload, times
from tidewarden.operators import metrics, windows


@pytest.mark.parametrize("seed", [10, 100])
def test_exact_percentiles(spark, seed):
    rnd = random.Random(seed)
    data = [("a", round(rnd.expovariate(0.1), rnd.choice([0, 3]))) for _ in range(3000)]
    data += [("b", 5.0)] * 700 + [("b", float(i)) for i in range(50)] + [("c", 1.5), ("a", None)]
    df = spark.createDataFrame(data, "k string, v double").repartition(6)
    qs = [0.0, 0.01, 0.5, 0.95, 0.99, 1.0]
    for keys in (["k"], []):
        out = metrics.exact_percentiles(df, "v", qs, keys).collect()
        groups = {k: [v for g, v in data if v is not None and (g == k or not keys)] for k in ({"a", "b", "c"} if keys else {None})}
        assert len(out) == len(qs) * len(groups)
        for r in out:
            values = groups[r.k if keys else None]
            assert r.value == pytest.approx(np.percentile(values, r.quantile * 100), abs=1e-9)


def test_percentiles_count_a_tied_group_once(spark):
    """Half a million equal values are one row after the partial aggregate; the input is read once."""
    df = spark.range(500_000).selectExpr("CAST(IF(id < 499000, 7, id) AS DOUBLE) AS v")
    out = metrics.exact_percentiles(df, "v", [0.5, 0.999])
    got = {r.quantile: r.value for r in out.collect()}
    assert got[0.5] == 7.0 and got[0.999] == pytest.approx(np.percentile([7.0] * 499_000 + list(range(499_000, 500_000)), 99.9))
    final = out._jdf.queryExecution().executedPlan().toString()
    assert "_salt" not in final


def test_latency_summary_of_nothing(spark):
    empty = spark.createDataFrame([], "v double")
    assert tuple(metrics.latency_summary(empty, "v").first()) == (0, 0.0, 0.0, 0.0, 0.0, 0.0)


def test_histogram_and_quantile(spark):
    df = spark.createDataFrame([(0.001,), (0.004,), (0.004,), (0.2,), (20.0,)], "v double")
    rows = metrics.histogram(df, "v", metrics.CONSUMER_BOUNDS).collect()
    assert len(rows) == 13 and rows[0].cumulative == 1 and rows[-1].cumulative == 5
    q = {r.quantile: r.value for r in metrics.histogram_quantile(
        metrics.histogram(df, "v", metrics.CONSUMER_BOUNDS), [0.2, 0.5, 0.99]).collect()}
    assert q[0.2] == pytest.approx(1.0)
    assert q[0.5] == pytest.approx((0.001 + 0.004 * (2.5 - 1) / 2) * 1000)
    assert q[0.99] == pytest.approx(10_000.0)
    assert metrics.histogram_quantile(metrics.histogram(df.limit(0), "v", [1.0]), [0.5]).count() == 0


def test_consumer_lag(spark):
    high = spark.createDataFrame([(0, 100), (1, 50), (2, 10), (3, 5)], "partition int, high bigint")
    done = spark.createDataFrame([(0, 90), (1, 60), (2, -1)], "partition int, committed bigint")
    lags = metrics.consumer_lag(high, done)
    assert [r.lag for r in lags.orderBy("partition").collect()] == [10, 0, 0, 0]
    assert tuple(metrics.lag_totals(lags).first()) == (10, 10)
    assert tuple(metrics.lag_totals(lags.limit(0)).first()) == (0, 0)


def test_fault_statistics(spark):
    rates = {"NULL": 10.0, "NEGATIVE": 5.0}
    df = spark.createDataFrame([("NULL",), (None,), (None,), (None,)], "fault_mode string")
    rows = {r.fault_mode: r for r in metrics.fault_statistics(df, rates).collect()}
    assert rows["NULL"].observed_pct == 25.0 and rows["NEGATIVE"].events == 0
    assert rows["NULL"].clean_events == 3 and rows["NULL"].overall_faulty_pct == 25.0
    assert all(r.observed_pct == 0.0 for r in metrics.fault_statistics(df.limit(0), rates).collect())


def test_count_monitor_and_trend(spark):
    s = spark.createDataFrame([("t", 0, 5), ("t", 10, 25), ("t", 20, 25), ("t", 30, 20)], "k string, at bigint, count bigint")
    rows = windows.count_monitor(s, ["k"]).orderBy("at").collect()
    assert [r.status for r in rows] == ["INITIAL", "INCREASING", "STABLE", "DECREASING"]
    assert [r.rate for r in rows] == [None, 2.0, 0.0, -0.5]
    t = windows.overall_trend(s, ["k"]).first()
    assert (t.initial_count, t.final_count, t.growth, t.trend) == (5, 20, 15, "INCREASING")
    flat = windows.overall_trend(s.where("at in (10, 20)"), ["k"]).first()
    assert flat.trend == "NOT INCREASING"
    assert [r.rate for r in windows.counter_rate(s, ["k"]).orderBy("at").collect()] == [None, 2.0, 0.0, 2.0]


def test_recovery_continuity(spark):
    s = spark.createDataFrame([("x", "before", 10), ("x", "after", 10), ("x", "later", 12),
                               ("y", "before", 10), ("y", "after", 9), ("y", "later", 12)], "k string, phase string, count bigint")
    assert {r.k: r.continuous for r in windows.recovery_continuity(s, ["k"]).collect()} == {"x": True, "y": False}


def test_flexible_time(spark):
    cases = [({"event_time": 1700000000}, 1700000000.0), ({"event_time": 1700000000250}, 1700000000.25),
             ({"event_time": "2024-01-01T00:00:00Z"}, 1704067200.0),
             ({"event_time": "2024-01-01T05:30:00+05:30"}, 1704067200.0),
             ({"event_time": "2024-01-01T00:00:00.5"}, 1704067200.5), ({"event_time": "2024-01-01"}, 1704067200.0),
             ({"event_time": "1700000000"}, None), ({"event_time": "soon"}, None), ({}, None),
             ({"event_time": None, "timestamp": 1700000000}, 1700000000.0),
             ({"event_time": "", "timestamp": "2024-01-01T00:00:00Z"}, 1704067200.0),
             ({"event_time": 0, "timestamp": 1700000000}, 1700000000.0)]
    df = spark.createDataFrame([(i, json.dumps(c[0])) for i, c in enumerate(cases)], "i int, j string")
    v = F.try_parse_json("j")
    out = df.select("i", (F.unix_micros(times.flexible_time(
        F.try_variant_get(v, "$.event_time", "variant"), F.try_variant_get(v, "$.timestamp", "variant"))) / 1e6).alias("s"))
    got = {r.i: r.s for r in out.collect()}
    for i, (c, want) in enumerate(cases):
        assert got[i] == want, c


def test_small_functions(spark):
    df = spark.createDataFrame([("CUS000123", 5.0), ("none", 0.0), (None, None)], "t string, n double")
    rows = df.select(payload.digits_as_long(F.col("t"), 7).alias("d"), payload.negated(F.col("n"), 2).alias("m"),
                     payload.json_quote(F.col("t")).alias("q")).collect()
    assert [(r.d, r.m, r.q) for r in rows] == [(123, -5.0, '"CUS000123"'), (7, -2.0, '"none"'), (7, -2.0, None)]
    odd = 'a"b\\c\né'
    quoted = spark.createDataFrame([(odd,)], "t string").select(payload.json_quote(F.col("t"))).first()[0]
    assert json.loads(quoted) == odd
    t = spark.sql("SELECT timestamp'2024-01-01 00:00:00.123987' AS t").select(times.iso_millis(F.col("t"))).first()[0]
    assert t == "2024-01-01T00:00:00.123Z"
    lat = spark.sql("SELECT timestamp'2024-01-01 00:00:01' a, timestamp'2024-01-01 00:00:02' b, CAST(NULL AS timestamp) c")
    r = lat.select(times.latency_ms(F.col("b"), F.col("a")), times.latency_ms(F.col("a"), F.col("b")),
                   times.latency_ms(F.col("a"), F.col("c"))).first()
    assert tuple(r) == (1000.0, 0.0, None)


def test_sliding_window_needs_a_dividing_step(spark):
    with pytest.raises(ValueError):
        windows.sliding_error_rate(spark.range(1), [], "id", "true", 60, 7)


def test_sliding_rates_against_brute_force(spark):
    rnd = random.Random(3)
    rows = [(rnd.choice("ab"), 1_700_000_000 + rnd.randint(0, 300), rnd.random() < 0.2) for _ in range(500)]
    df = spark.createDataFrame(rows, "source string, s bigint, failed boolean").withColumn("at", F.timestamp_seconds("s"))
    got = {(r.source, r.window_start): (r.total, r.bad) for r in
           windows.sliding_error_rate(df, ["source"], "at", "failed", 60, 10).collect()}
    want = {}
    for k, s, bad in rows:
        for start in range((s // 10) * 10 - 50, s + 1, 10):
            n, b = want.get((k, start), (0, 0))
            want[k, start] = (n + 1, b + bad)
    assert got == want and not any(math.isnan(t) for t, _ in got.values())


def test_percentiles_do_not_rely_on_reused_exchanges(spark):
    """A tied hot group, negative, tiny, huge and nearly equal values, with each branch of the plan computed on its own."""
    rnd = random.Random(3)
    data = [("hot", 0.25)] * 4000 + [("hot", rnd.gauss(0, 1e3)) for _ in range(2000)]
    data += [("near", 1.0 + k * 2.0 ** -52) for k in range(500)] + [("near", -1.0 - k * 2.0 ** -40) for k in range(500)]
    data += [("odd", v) for v in (-0.0, 0.0, 5e-324, -5e-324, 1.7e308, -1.7e308, 2.5)] + [(None, 3.0), (None, 4.0)]
    df = spark.createDataFrame(data, "k string, v double").repartition(7)
    qs = [0.0, 0.1, 0.25, 0.5, 0.77, 1.0]
    spark.conf.set("spark.sql.exchange.reuse", "false")
    try:
        got = {(r.k, r.quantile): r.value for r in metrics.exact_percentiles(df, "v", qs, ["k"]).collect()}
    finally:
        spark.conf.unset("spark.sql.exchange.reuse")
    assert len(got) == 4 * len(qs)
    for (k, q), value in got.items():
        own = sorted(v for g, v in data if g == k)
        at = q * (len(own) - 1)
        low, high = own[math.floor(at)], own[math.ceil(at)]
        assert value == low + (high - low) * (at - math.floor(at))


def test_ordered_bits_sort_like_the_values(spark):
    values = [float("-inf"), -1e300, -1.5, -1.0, -5e-324, 0.0, 5e-324, 1.0, 1.0000000000000002, 1e300, float("inf"), float("nan")]
    bits = [r[0] for r in spark.createDataFrame([(v,) for v in values], "v double").select(metrics.ordered_bits(F.col("v"))).collect()]
    assert bits == sorted(bits) and len(set(bits)) == len(values)
    zero = spark.createDataFrame([(-0.0,), (0.0,)], "v double").select(metrics.ordered_bits(F.col("v"))).distinct().count()
    assert zero == 1


def plain_increase(samples, at, seconds):
    own = [(t, c) for t, c in samples if at - seconds < t <= at]
    if len(own) < 2:
        return None
    grown, length = 0.0, own[-1][0] - own[0][0]
    for (_, a), (_, b) in zip(own, own[1:]):
        grown += b - a if b >= a else b
    mean = length / (len(own) - 1)
    front, back = own[0][0] - (at - seconds), at - own[-1][0]
    front, back = (x if x < mean * 1.1 else mean / 2 for x in (front, back))
    if grown > 0:
        front = min(front, length * own[0][1] / grown)
    return grown * (length + front + back) / length


def test_counter_increase_with_resets_and_gaps(spark):
    rnd, rows = random.Random(8), []
    for k in ("a", "b", None):
        t, c = 7, rnd.randint(0, 5)
        for _ in range(120):
            t += rnd.choice([5, 5, 5, 6, 40, 200])          # 200: windows stay empty
            c = rnd.randint(0, 3) if rnd.random() < 0.1 else c + rnd.randint(0, 9)
            rows.append((k, t, c))
    df = spark.createDataFrame(rows, "k string, at bigint, count bigint").repartition(5)
    for seconds, step in ((30, 10), (30, 30), (10, 45)):
        got = {(r.k, r["at"]): r.increase for r in metrics.counter_increase(df, ["k"], seconds, step).collect()}
        want = {}
        for k in ("a", "b", None):
            own = [(t, c) for g, t, c in rows if g == k]
            for at in range(0, own[-1][0] + seconds + step, step):
                x = plain_increase(own, at, seconds)
                if x is not None:
                    want[k, at] = x
        assert got.keys() == want.keys() and all(got[x] == pytest.approx(want[x]) for x in want)


def test_quantiles_of_increase_ignore_what_was_counted_before(spark):
    """Two counters that start high; one is reset inside the window. Only the growth of the window counts."""
    rows = [("x", 1.0, 10, 1000), ("x", 1.0, 20, 1010), ("x", 1.0, 30, 1020), ("x", float("inf"), 10, 2000), ("x", float("inf"), 20, 2020), ("x", float("inf"), 30, 2040),
            ("y", 1.0, 10, 50), ("y", 1.0, 20, 0), ("y", 1.0, 30, 10), ("y", float("inf"), 10, 50), ("y", float("inf"), 20, 0), ("y", float("inf"), 30, 10)]
    df = spark.createDataFrame(rows, "source string, le double, at bigint, count bigint")
    got = metrics.quantiles_of_increase(df, [0.3], [], 30, 30, per=["source"]).collect()
    assert [(r["at"], r.quantile) for r in got] == [(30, 0.3)]
    # by 30 s: 20 + 10 of 40 + 10 are up to 1 s, each extended by 9 s at the front of 20 s (mean distance 10)
    assert got[0].value == pytest.approx(1000 * 0.3 * 50 / 30)


def test_lag_over_time(spark):
    polls = spark.createDataFrame([("t", 0, 10, 100), ("t", 0, 20, 200), ("t", 0, 99, 300), ("t", 1, 20, 5)],
                                  "topic string, partition int, at bigint, high bigint")
    commits = spark.createDataFrame([("t", 0, "g", 15, 90), ("t", 0, "g", 20, 150), ("t", 0, "g", 20, 140), ("t", 0, "g", 300, 999),
                                     ("t", 1, "g", 3, 9), ("t", 0, "h", 11, -1)],
                                    "topic string, partition int, group string, at bigint, committed bigint")
    members = spark.createDataFrame([("t", "g"), ("t", "h"), ("other", "g")], "topic string, group string")
    for block in (7, 86_400):
        got = {(r.partition, r.group, r["at"]): (r.committed, r.lag) for r in metrics.lag_over_time(polls, commits, members, block).collect()}
        assert got == {(0, "g", 10): (None, 0), (0, "g", 20): (150, 50), (0, "g", 99): (150, 150), (1, "g", 20): (9, 0),
                       (0, "h", 10): (None, 0), (0, "h", 20): (-1, 0), (0, "h", 99): (-1, 0), (1, "h", 20): (None, 0)}


def test_throughput_has_no_window_over_all_intervals(spark):
    df = spark.range(3000).selectExpr("timestamp_seconds(id * 7 % 5000) AS ts", "id % 9 = 0 AS bad")
    got = {r.slice: r for r in windows.throughput(df, "ts", F.col("bad"), 1, block=64).collect()}
    total = errors = 0
    for at in sorted(got):
        total, errors = total + got[at].total, errors + sum(1 for i in range(3000) if i * 7 % 5000 == at and i % 9 == 0)
        assert (got[at].generated, got[at].errors) == (total, errors)
        assert got[at].average_rate == pytest.approx(total / (at + 1 - min(got)))
