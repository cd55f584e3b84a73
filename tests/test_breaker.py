"""The circuit breaker: transitions, batch fold, gate, alerts."""

import random

from pyspark.sql import functions as F

from tidewarden.operators import breaker
from tidewarden.operators.breaker import CLOSED, HALF_OPEN, OPEN, BreakerOptions, BreakerState, fold_rows

O = BreakerOptions()


def walk(slices, options=O):
    return [(r[1], r[4], r[5]) for r in fold_rows("s", slices, BreakerState(), options)]


def test_threshold_is_strict_and_needs_enough_events():
    assert walk([(0, 100, 5)])[-1][2] == CLOSED
    assert walk([(0, 99, 99)])[-1][2] == CLOSED
    assert walk([(0, 100, 6)])[-1][2] == OPEN
    assert walk([(0, 50, 3), (50, 50, 3)])[-1][2] == OPEN
    assert walk([(0, 50, 3), (60, 50, 3)])[-1][2] == CLOSED


def test_full_cycle():
    states = walk([(0, 100, 50), (10, 100, 0), (110, 10, 0), (120, 10, 0), (130, 30, 0), (140, 20, 0),
                   (150, 100, 6)])
    assert [s[2] for s in states] == [OPEN, OPEN, OPEN, HALF_OPEN, HALF_OPEN, CLOSED, OPEN]
    assert all(a[2] == b[1] for a, b in zip(states, states[1:]))


def test_failed_probe_restarts_the_timer():
    states = walk([(0, 100, 50), (120, 10, 5), (130, 10, 1), (240, 10, 0), (250, 10, 0), (260, 49, 0), (270, 1, 0)])
    assert [s[2] for s in states] == [OPEN, HALF_OPEN, OPEN, OPEN, HALF_OPEN, HALF_OPEN, CLOSED]


def test_window_is_empty_after_closing():
    states = walk([(0, 100, 50), (120, 10, 0), (130, 60, 0), (140, 99, 99)])
    assert states[-1][2] == CLOSED


def slice_table(spark, n=400):
    rnd = random.Random(2)
    rows = [(s, 10 * i, rnd.randint(1, 60), rnd.choice([0, 0, 0, 1, 9])) for s in "abc" for i in range(n)
            if rnd.random() < 0.7]
    rows = [(s, t, n, min(b, n)) for s, t, n, b in rows]
    return rows, spark.createDataFrame(rows, "source string, slice bigint, total bigint, bad bigint").repartition(6)


def test_batch_fold_matches_the_step_for_any_batch_size(spark):
    rows, df = slice_table(spark)
    want = []
    for s in "abc":
        want += fold_rows(s, [r[1:] for r in sorted(rows) if r[0] == s], BreakerState(), O)
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        for size in ("7", old):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
            assert sorted(tuple(r) for r in breaker.breaker_states(df, O).collect()) == sorted(want)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    assert any(r[4] != r[5] for r in want)


def test_incidents_alerts_and_gate(spark):
    df = spark.createDataFrame([("web", 0, 100, 50), ("web", 120, 10, 0), ("web", 130, 60, 0), ("web", 140, 5, 0)],
                               "source string, slice bigint, total bigint, bad bigint")
    states = breaker.breaker_states(df)
    inc = breaker.incidents(states).orderBy("opened_at").collect()
    assert [(r.from_state, r.to_state) for r in inc] == [(CLOSED, OPEN), (OPEN, HALF_OPEN), (HALF_OPEN, CLOSED)]
    assert inc[0].error_rate == 0.5
    feed = breaker.alerts(breaker.incidents(states))
    assert {r.severity for r in feed.collect()} == {"CRITICAL", "WARNING", "INFO"}
    assert "web: CLOSED -> OPEN, 50 of 100 events failed" in {r.message for r in feed.collect()}
    assert [r.signal for r in breaker.control_signals(states).orderBy("issued_at").collect()] == \
        ["PAUSE", "PROBE", "RESUME"]
    events = spark.createDataFrame([("web", 5), ("web", 125), ("web", 135), ("web", 145)], "source string, s bigint") \
        .withColumn("at", F.timestamp_seconds("s"))
    gated = {r.s: r.gate for r in breaker.gate(events, states, "at").collect()}
    assert gated == {5: "pass", 125: "divert", 135: "probe", 145: "pass"}
    context = breaker.incident_context(breaker.incidents(states), df)
    assert context.count() == 3


def test_probe_sample(spark):
    df = spark.range(300).selectExpr("id % 2 AS k", "id AS offset")
    out = breaker.probe_sample(df, ["k"], ["offset"], 50)
    assert out.count() == 100 and out.agg(F.max("offset")).first()[0] == 99
