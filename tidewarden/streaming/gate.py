"""The breaker on the stream: its control tables, and a gate that holds events while a source is open.

Two queries share the log. The first one closes slices, folds them into the breaker's state and appends, per micro-batch, the states
and what follows from a change: incidents, alerts and control signals. The second one reads the log again together with
the states. An event waits until the state of its slice is known; in an open slice it is diverted and held, and released when its source
closes. Held events live in the state store, so a restart neither loses nor doubles one.

A source can own a large share of all events, so its events are dealt over shards; only the states, one row per slice, are copied
to each shard.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from tidewarden.operators.breaker import CLOSED, HALF_OPEN, OPEN, BreakerOptions, alerts, control_signals, incidents
from tidewarden.operators.windows import slice_start
from tidewarden.sources import sinks
from tidewarden.streaming.ingest import triggered
from tidewarden.streaming.stateful import breaker_stream, narrow_state, processor_store, stream_slices

SHARDS = 16
GATED = "source string, offset bigint, slice bigint, gate string, released_at bigint"
STATE_ROWS = "source STRING, slice BIGINT, total BIGINT, bad BIGINT, state_before STRING, state STRING, seen BIGINT, failed BIGINT"
CONTROL_TABLES = {"states": lambda s: s, "incidents": incidents, "alerts": lambda s: alerts(incidents(s)), "pipeline_control": control_signals}
_GATES = {CLOSED: "pass", HALF_OPEN: "probe", OPEN: "divert"}


def write_control(root: str):
    """foreachBatch target: the states of one batch and the rows that follow from them, each to its own table."""
    def write(batch: DataFrame, batch_id: int) -> None:
        kept = batch.persist()
        try:
            for name, of in CONTROL_TABLES.items():
                sinks.write_batch(of(kept), f"{root}/{name}", batch_id)
        finally:
            kept.unpersist()
    return write


def start_breaker(checked: DataFrame, root: str, checkpoint: str, options: BreakerOptions = BreakerOptions(), lateness: str = "5 seconds",
                  once: bool = False) -> StreamingQuery:
    """Breaker states, incidents, alerts and control signals under ``root``, from a stream of checked events.

    The fold of a batch depends on the state store and the batch alone, so a batch that is run again writes the same rows,
    in place of those of the first try.
    """
    states = breaker_stream(stream_slices(checked, options, lateness), options)
    writer = states.writeStream.foreachBatch(write_control(root)).option("checkpointLocation", checkpoint)
    with processor_store(checked.sparkSession), narrow_state(checked.sparkSession):
        return triggered(writer, once).start()


def state_stream(spark: SparkSession, root: str, newest: int | None = None) -> DataFrame:
    """The states that ``start_breaker`` appends, as a stream, or those of its batches up to the ``newest`` one. A batch that was written
    twice shows its rows twice; the gate takes the same state once."""
    some = "" if newest is None else f"/batch_id={{{','.join(map(str, range(newest + 1)))}}}"
    return spark.readStream.schema(STATE_ROWS).parquet(f"{root}/states/data{some}")


class _Gate(StatefulProcessor):
    """Events and breaker states of one shard of a source."""

    def __init__(self, options: BreakerOptions, keep: int):
        self.options, self.keep = options, keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        event = "slice bigint, offset bigint"
        self.waiting = handle.getListState("waiting", event)
        self.held = handle.getListState("held", event)
        self.known = handle.getValueState("known", "slices array<bigint>, befores array<string>, afters array<string>, alarm bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        given = pd.concat(list(rows), ignore_index=True)
        is_state = given["state"].notna()
        events = given.loc[~is_state, ["slice", "offset"]].astype("int64").itertuples(index=False, name=None)
        states = given.loc[is_state, ["slice", "state_before", "state"]].itertuples(index=False, name=None)
        yield self._moved(key[0], list(events), {int(at): (before, after) for at, before, after in states}, None)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """Decides the events of slices long over whose state did not come."""
        yield self._moved(key[0], [], {}, expiredTimerInfo.getExpiryTimeInMs() // 1000 - self.options.step - self.keep)

    def _moved(self, source: str, events: list[tuple], states: dict, over: int | None) -> pd.DataFrame:
        """What can be decided now; the rest goes on waiting, and what is held stays until its source closes."""
        slices, befores, afters, alarm = self.known.get() if self.known.exists() else ([], [], [], None)
        known = {**dict(zip(slices, zip(befores, afters))), **states}
        ordered = sorted(known)
        closed = [at for at in ordered if known[at][1] == CLOSED and known[at][0] != CLOSED]
        waiting = [*((r[0], r[1]) for r in self.waiting.get()), *events]
        held, still, out = [(r[0], r[1]) for r in self.held.get()], [], []
        for at, offset in waiting:
            if at in known:
                state = known[at][0]
            elif over is not None and at <= over:   # the state that was in force when the slice began
                state = next((known[s][1] for s in reversed(ordered) if s < at), CLOSED)
            else:
                still.append((at, offset))
                continue
            out.append((source, offset, at, _GATES[state], None))
            if state == OPEN:
                held.append((at, offset))
        stay = []
        for at, offset in held:
            nth = bisect_right(closed, at)
            if nth == len(closed):
                stay.append((at, offset))
            else:
                out.append((source, offset, at, "release", closed[nth]))
        for state, rows in ((self.waiting, still), (self.held, stay)):
            if rows:
                state.put(rows)
            else:   # an empty list is no value
                state.clear()
        due = (min(still)[0] + self.options.step + self.keep) * 1000 if still else None
        if due is not None and (due != alarm or over is not None):
            self.handle.registerTimer(due)
        # Old states are only of use to events that late; the newest one stays in force.
        kept = [at for at in ordered if at >= ordered[-1] - self.keep]
        self.known.update((kept, [known[at][0] for at in kept], [known[at][1] for at in kept], due))
        return pd.DataFrame(out, columns=["source", "offset", "slice", "gate", "released_at"]).astype({"released_at": "Int64"})

    def close(self) -> None:
        pass


def gate_stream(events: DataFrame, states: DataFrame, options: BreakerOptions = BreakerOptions(), lateness: str = "5 seconds",
                keep: int = 3600, shards: int = SHARDS) -> DataFrame:
    """(source, offset, slice, gate, released_at) of a stream of events (source, offset, arrived_at) and one of breaker states.

    Each event comes out once with the gate pass, probe or divert, by the state in force in its slice; a diverted one comes out once
    more as ``release`` when its source closes, with the slice that closed it. If a slice's state has not come ``keep``
    seconds after the slice is over for both streams, the newest state before it that is still known decides; states are
    kept for ``keep`` seconds. Events without a source are left out.
    """
    keyed = events.where(F.col("source").isNotNull()).select(
        "source", F.pmod(F.xxhash64("offset"), F.lit(shards)).cast("int").alias("shard"), slice_start(F.col("arrived_at"), options.step).alias("slice"),
        F.col("offset").cast("bigint").alias("offset"), F.col("arrived_at").alias("at"),
        F.lit(None).cast("string").alias("state_before"), F.lit(None).cast("string").alias("state")).withWatermark("at", lateness)
    copied = states.select(
        "source", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), "slice", F.lit(None).cast("bigint").alias("offset"),
        F.timestamp_seconds(F.col("slice") + options.step).alias("at"), "state_before", "state").withWatermark("at", "0 seconds")
    return keyed.unionByName(copied).groupBy("source", "shard").transformWithStateInPandas(
        _Gate(options, keep), outputStructType=GATED, outputMode="Append", timeMode="EventTime")


def start_gate(events: DataFrame, states: DataFrame, path: str, checkpoint: str, options: BreakerOptions = BreakerOptions(),
               lateness: str = "5 seconds", keep: int = 3600, once: bool = False, shards: int = SHARDS) -> StreamingQuery:
    """Gated and released events, appended to a folder of Parquet files."""
    writer = gate_stream(events, states, options, lateness, keep, shards).writeStream.format("parquet").outputMode("append") \
        .option("path", path).option("checkpointLocation", checkpoint)
    with processor_store(events.sparkSession), narrow_state(events.sparkSession):
        return triggered(writer, once).start()


def sliding_rate_stream(checked: DataFrame, seconds: int = 60, step: int = 10, lateness: str = "5 seconds", ts: str = "arrived_at",
                        source: str = "source") -> DataFrame:
    """Failed / total per source and closed sliding window: (source, window_start, total, bad, error_rate).

    Two windows in a chain: events become slices of ``step`` seconds, and the slices, by the time of their window, sliding windows;
    an event is counted once however many windows hold it.
    """
    if seconds % step:
        raise ValueError("the step must divide the window length")
    sliced = checked.withWatermark(ts, lateness).groupBy(F.col(source).alias("source"), F.window(F.col(ts), f"{step} seconds").alias("w")).agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.size("failures") > 0).alias("bad"))
    wide = F.window(F.window_time("w"), f"{seconds} seconds", f"{step} seconds")
    return sliced.groupBy("source", wide.alias("wide")).agg(F.sum("total").alias("total"), F.sum("bad").alias("bad")).select(
        "source", F.unix_timestamp("wide.start").alias("window_start"), "total", "bad", (F.col("bad") / F.col("total")).alias("error_rate"))
