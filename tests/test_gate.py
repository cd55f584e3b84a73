"""The stream's gate by itself, with states in memory; and its control tables when a batch is run again."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidewarden.operators import breaker
from tidewarden.plans import streams
from tidewarden.session import shared_dir
from tidewarden.sources import sinks
from tidewarden.streaming import gate
from tidewarden.streaming.stateful import SPLITS, WIDTH, fine_splits, narrow_state

OPTIONS = breaker.BreakerOptions(step=10)


class _State:
    def __init__(self):
        self.value = None

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value if self.value is not None else iter(())

    def put(self, rows):
        assert rows
        self.value = list(rows)

    def update(self, value):
        self.value = value

    def clear(self):
        self.value = None


class _Handle:
    def __init__(self):
        self.timers = []

    def getListState(self, name, schema):
        return _State()

    getValueState = getListState

    def registerTimer(self, at):
        self.timers.append(at)


class _Timer:
    def __init__(self, at):
        self.at = at

    def getExpiryTimeInMs(self):
        return self.at


def started(keep=100):
    handle, g = _Handle(), gate._Gate(OPTIONS, keep)
    g.init(handle)
    return handle, g


def give(g, events=(), states=()):
    rows = [{"slice": s, "offset": o, "state_before": None, "state": None} for s, o in events]
    rows += [{"slice": s, "offset": None, "state_before": b, "state": a} for s, b, a in states]
    out = next(iter(g.handleInputRows(("web", 0), iter([pd.DataFrame(rows)]), None)))
    return [(r.offset, r.slice, r.gate, None if pd.isna(r.released_at) else int(r.released_at)) for r in out.itertuples()]


def test_events_wait_are_held_and_released():
    _, g = started()
    assert give(g, [(0, 1), (10, 2), (20, 3)]) == []
    assert give(g, states=[(0, "CLOSED", "OPEN")]) == [(1, 0, "pass", None)]
    assert give(g, states=[(10, "OPEN", "HALF_OPEN")]) == [(2, 10, "divert", None)]
    assert give(g, [(10, 4)]) == [(4, 10, "divert", None)]                           # a straggler of a known slice
    assert give(g, states=[(20, "HALF_OPEN", "OPEN"), (30, "OPEN", "HALF_OPEN")]) == [(3, 20, "probe", None)]
    assert give(g, [(30, 5)], [(40, "HALF_OPEN", "CLOSED")]) == [(5, 30, "divert", None), (2, 10, "release", 40), (4, 10, "release", 40),
                                                                 (5, 30, "release", 40)]
    assert give(g, states=[(40, "HALF_OPEN", "CLOSED")]) == []                       # the same state again, as after a retried batch
    assert give(g, [(20, 6), (30, 7)]) == [(6, 20, "probe", None), (7, 30, "divert", None), (7, 30, "release", 40)]


def test_nothing_is_released_twice_when_a_source_opens_again():
    _, g = started()
    give(g, [(0, 1)], [(0, "OPEN", "HALF_OPEN"), (10, "HALF_OPEN", "CLOSED")])
    assert give(g, [(20, 2)], [(20, "CLOSED", "OPEN"), (30, "OPEN", "OPEN")]) == [(2, 20, "pass", None)]
    assert give(g, [(30, 3)]) == [(3, 30, "divert", None)]
    assert give(g, states=[(150, "OPEN", "HALF_OPEN"), (160, "HALF_OPEN", "CLOSED")]) == [(3, 30, "release", 160)]


def test_a_state_that_never_comes():
    handle, g = started(keep=100)
    give(g, [(50, 1), (70, 2)], [(40, "CLOSED", "OPEN")])
    assert handle.timers == [(50 + 10 + 100) * 1000]
    out = next(iter(g.handleExpiredTimer(("web", 0), None, _Timer(handle.timers[-1]))))
    assert out[["offset", "gate"]].values.tolist() == [[1, "divert"]]                # open since slice 40
    assert handle.timers[-1] == (70 + 10 + 100) * 1000                               # the next one waiting


def test_old_states_are_forgotten():
    _, g = started(keep=100)
    for at in range(0, 2000, 10):
        give(g, states=[(at, "CLOSED", "CLOSED")])
    assert len(g.known.value[0]) <= 11


def test_a_batch_run_again_leaves_the_control_tables_as_they_were(spark):
    sliced = spark.range(400).selectExpr("if(id % 2 = 0, 'web', 'app') AS source", "id div 2 * 10 AS slice", "60L AS total",
                                         "if(id div 2 % 40 < 6, 9L, 0L) AS bad")
    states = breaker.breaker_states(sliced, OPTIONS)
    root = shared_dir(spark, "control")
    write = gate.write_control(root)
    first, second = states.where("slice % 20 = 0"), states.where("slice % 20 <> 0")
    write(first, 0)
    write(second.where(F.rand(1) < 0.5), 1)      # broke off: not all its rows
    write(second, 1)
    for name, of in gate.CONTROL_TABLES.items():
        got = sinks.read_table(spark, f"{root}/{name}").drop("batch_id")
        want = of(states)
        assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0 and want.count() > 0, name


def test_released_events_against_brute_force(spark):
    states = spark.createDataFrame([("a", 0, 5, "CLOSED", "OPEN"), ("a", 10, 5, "OPEN", "HALF_OPEN"), ("a", 20, 5, "HALF_OPEN", "CLOSED"),
                                    ("a", 30, 5, "CLOSED", "OPEN"), ("a", 40, 5, "OPEN", "OPEN"), ("b", 10, 5, "OPEN", "OPEN")],
                                   "source string, slice bigint, total bigint, state_before string, state string")
    events = spark.range(60).selectExpr("if(id % 2 = 0, 'a', 'b') AS source", "id AS offset", "timestamp_seconds(id) AS at")
    got = {(r.offset, r.slice, r.released_at) for r in breaker.released(events, states, "at", options=OPTIONS, spread_by=["offset"], block=1).collect()}
    assert got == {(i, 10, 20) for i in range(10, 20, 2)}


def test_sliding_stream_needs_a_dividing_step(spark):
    with pytest.raises(ValueError):
        gate.sliding_rate_stream(spark.readStream.format("rate").load(), 60, 7)


def test_breaker_and_gate_run_whatever_store_the_session_names(spark):
    """The driver's session does not name RocksDB; the queries take it by themselves and leave the session as it was."""
    box, name = shared_dir(spark, "any-store"), "spark.sql.streaming.stateStore.providerClass"
    rows = [("web", i, 1000 + 5 * i, ["X"] if i < 4 else []) for i in range(8)]
    spark.createDataFrame(rows, "source string, offset bigint, at bigint, failures array<string>") \
        .selectExpr("source", "offset", "timestamp_seconds(at) AS arrived_at", "failures").coalesce(1).write.parquet(f"{box}/in")
    events = spark.readStream.schema("source string, offset bigint, arrived_at timestamp, failures array<string>").parquet(f"{box}/in")
    before, plain = spark.conf.get(name), "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider"
    spark.conf.set(name, plain)
    try:
        gate.start_breaker(events, f"{box}/out", f"{box}/breaker", OPTIONS, "0 seconds", once=True).awaitTermination()
        states = gate.state_stream(spark, f"{box}/out")
        gate.start_gate(events, states, f"{box}/gated", f"{box}/gate", OPTIONS, "0 seconds", once=True, shards=1).awaitTermination()
        assert spark.conf.get(name) == plain
    finally:
        spark.conf.set(name, before)
    assert [r.slice for r in sinks.read_table(spark, f"{box}/out/states").orderBy("slice").collect()] == [1000, 1010, 1020]
    gated = spark.read.schema(gate.GATED).parquet(f"{box}/gated").where("gate <> 'release'")
    assert sorted(r.offset for r in gated.collect()) == list(range(6))


def test_state_by_slices_is_no_wider_than_the_cores(spark):
    before, cores = spark.conf.get(WIDTH), spark.sparkContext.defaultParallelism
    try:
        for asked, given in ((10 * cores, cores), (1, 1)):
            spark.conf.set(WIDTH, asked)
            with narrow_state(spark):
                assert int(spark.conf.get(WIDTH)) == given
            assert int(spark.conf.get(WIDTH)) == asked
    finally:
        spark.conf.set(WIDTH, before)


def test_log_whose_offsets_do_not_follow_time_is_counted_whole(spark, tmp_path, monkeypatch):
    """The same hours twice, one after the other by offset; landed in files of few rows."""
    raw = spark.range(240).selectExpr(
        "0 AS partition", "id AS offset", "timestamp_seconds(1704067200 + 600 * (id % 120)) AS arrived_at", "'web' AS source",
        "CASE WHEN id % 5 = 0 THEN 'x' ELSE '{}' END AS value")
    monkeypatch.setattr(streams, "raw_log", lambda spark, sf: raw)
    monkeypatch.setattr(streams, "BLOCK", 10)
    got = streams.stream_error_rate_sliding(spark, str(tmp_path)).agg(F.sum("total"), F.max("total")).first()
    assert tuple(got) == (6 * 240, 2 * 36)


def test_control_tables_do_not_wait_for_the_gate(spark, tmp_path, monkeypatch):
    """States and alerts come from the breaker alone; the gate is run later, over the same slices and the states known by each."""
    raw = spark.range(2400).selectExpr(
        "0 AS partition", "id AS offset", "timestamp_seconds(1704067200 + 150 * id) AS arrived_at", "'web' AS source",
        "CASE WHEN id % 300 < 40 THEN 'x' ELSE '{}' END AS value")
    monkeypatch.setattr(streams, "raw_log", lambda spark, sf: raw)
    monkeypatch.setattr(streams.quality, "check", lambda df, *_: df.withColumn("failures", F.array_compact(F.array(F.when(F.col("value") == "x", "X")))))
    asked = []
    with monkeypatch.context() as patch:
        patch.setattr(gate, "start_gate", lambda *_, **__: pytest.fail("the gate was started"))
        states = streams.stream_breaker_states(spark, str(tmp_path)).cache()
        raised = streams.stream_alerts(spark, str(tmp_path)).count()
    assert states.agg(F.sum("total"), F.sum("bad")).first()[:] == (2400, 320)
    assert raised == states.where("state <> state_before").count() > 2
    start = gate.start_gate
    monkeypatch.setattr(gate, "start_gate", lambda events, *more, **named: asked.append(1) or start(events, *more, **named))
    want = breaker.gate(raw, states, "arrived_at", options=streams.BREAKER, spread_by=["offset"]).select("source", "offset", "gate")
    got = streams.stream_gated(spark, str(tmp_path))
    assert got.count() == 2400 and got.exceptAll(want).count() == 0
    held = streams.stream_released(spark, str(tmp_path)).select("source", "offset", "slice", "released_at")
    freed = breaker.released(raw, states, "arrived_at", options=streams.BREAKER, spread_by=["offset"]).select("source", "offset", "slice", "released_at")
    assert held.count() == freed.count() > 0 and held.exceptAll(freed).count() == 0
    assert len(asked) == streams.SLICES + 1


def test_slices_are_read_in_more_tasks_than_cores(spark):
    """Few large splits would leave cores waiting for the last one; a number that the session names is kept."""
    box, cores, seen = shared_dir(spark, "splits"), spark.sparkContext.defaultParallelism, []
    spark.range(0, 640, 1, 8 * cores).selectExpr("0 AS partition", "id AS offset", "timestamp_seconds(id) AS arrived_at", "'{}' AS value").write.parquet(f"{box}/in/0")
    with fine_splits(spark):
        streams._landed(spark, box, 0).writeStream.option("checkpointLocation", f"{box}/ck").trigger(availableNow=True) \
            .foreachBatch(lambda batch, _: seen.append((batch.rdd.getNumPartitions(), batch.count()))).start().awaitTermination()
    assert len(seen) == 1 and seen[0][0] > 2 * cores and seen[0][1] == 640
    assert spark.conf.get(SPLITS, None) is None
    spark.conf.set(SPLITS, 3)
    try:
        with fine_splits(spark):
            assert spark.conf.get(SPLITS) == "3"
        assert spark.conf.get(SPLITS) == "3"
    finally:
        spark.conf.unset(SPLITS)
