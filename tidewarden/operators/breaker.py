"""Circuit breaker over error-rate slices.

CLOSED opens when the last 60 s hold at least 100 events of which more than 5 %
failed. OPEN turns HALF_OPEN at the first slice that starts 120 s or more after
the opening slice. HALF_OPEN lets whole slices through until 50 events are
seen: any failure opens again (and restarts the timer), none closes and starts
with an empty window. A transition is decided at the end of a slice and holds
from the next one, so there is at most one per slice.

The state of a source depends on all its earlier slices, which no relational
operator expresses. The fold is a short Python step on slices, one row per ten
seconds and source, never on events. Slices are sorted by Spark and streamed
through the step batch by batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import asdict, dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F

from tidewarden.operators.ordered import asof
from tidewarden.operators.skew import attach
from tidewarden.operators.windows import slice_start

CLOSED, OPEN, HALF_OPEN = "CLOSED", "OPEN", "HALF_OPEN"


@dataclass(frozen=True)
class BreakerOptions:
    """All times in seconds."""

    step: int = 10
    window: int = 60
    threshold: float = 0.05
    min_events: int = 100
    cooldown: int = 120
    sample: int = 50


@dataclass
class BreakerState:
    """What a source carries from slice to slice."""

    state: str = CLOSED
    opened_at: int = 0
    sample_total: int = 0
    window: list = field(default_factory=list)   # [slice, total, bad] of the last minute

    def to_dict(self) -> dict:
        return asdict(self)


def step(s: BreakerState, at: int, total: int, bad: int, o: BreakerOptions) -> tuple[int, int]:
    """Advances the state by one slice; returns the window's total and bad."""
    if s.state == CLOSED:
        s.window = [x for x in s.window if x[0] > at - o.window] + [[at, total, bad]]
        seen, failed = sum(x[1] for x in s.window), sum(x[2] for x in s.window)
        if seen >= o.min_events and failed > o.threshold * seen:
            s.state, s.opened_at, s.window = OPEN, at, []
        return seen, failed
    if s.state == OPEN:
        if at >= s.opened_at + o.cooldown:
            s.state, s.sample_total = HALF_OPEN, 0
        return total, bad
    s.sample_total += total
    if bad:
        s.state, s.opened_at = OPEN, at
    elif s.sample_total >= o.sample:
        s.state, s.window = CLOSED, []
    return s.sample_total, bad


STATES = ("source string, slice bigint, total bigint, bad bigint, state_before string, "
          "state string, seen bigint, failed bigint")


def fold_rows(source: str, rows, state: BreakerState, o: BreakerOptions) -> list[tuple]:
    """Runs the step over ordered (slice, total, bad) rows of one source."""
    out = []
    for at, total, bad in rows:
        before = state.state
        seen, failed = step(state, int(at), int(total), int(bad), o)
        out.append((source, int(at), int(total), int(bad), before, state.state, seen, failed))
    return out


def breaker_states(sliced: DataFrame, options: BreakerOptions = BreakerOptions(),
                   source: str = "source") -> DataFrame:
    """State before and after each slice, from (source, slice, total, bad)."""
    columns = [c.split()[0] for c in STATES.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, state = None, BreakerState()
        for batch in batches:
            out: list[tuple] = []
            for name, part in batch.groupby("source", sort=False):
                if name != current:
                    current, state = name, BreakerState()
                out += fold_rows(name, zip(part["slice"], part["total"], part["bad"]), state, options)
            yield pd.DataFrame(out, columns=columns)

    ordered = (sliced.select(F.col(source).alias("source"), "slice", "total", "bad")
               .where(F.col("source").isNotNull())
               .repartition("source").sortWithinPartitions("source", "slice"))
    return ordered.mapInPandas(run, STATES)


def transitions(states: DataFrame) -> DataFrame:
    """Slices at which the state changed."""
    return states.where(F.col("state") != F.col("state_before"))


def incidents(states: DataFrame) -> DataFrame:
    """One incident row per state change."""
    return transitions(states).select(
        F.md5(F.concat_ws("|", "source", "slice", "state")).alias("incident_id"), "source",
        F.col("state_before").alias("from_state"), F.col("state").alias("to_state"),
        F.timestamp_seconds("slice").cast("timestamp_ntz").alias("opened_at"),
        (F.col("failed") / F.col("seen")).alias("error_rate"),
        F.col("seen").alias("total"), F.col("failed").alias("bad"))


def alerts(incident_rows: DataFrame) -> DataFrame:
    """Alert feed of the incidents, with the recommended next step."""
    severity = F.when(F.col("to_state") == OPEN, "CRITICAL").when(
        F.col("to_state") == HALF_OPEN, "WARNING").otherwise("INFO")
    message = F.format_string("%s: %s -> %s, %d of %d events failed", "source", "from_state",
                              "to_state", "bad", "total")
    return incident_rows.select(
        F.md5(F.concat("incident_id", F.lit("|alert"))).alias("alert_id"), "incident_id", "source",
        F.col("opened_at").alias("raised_at"), severity.alias("severity"), message.alias("message"))


def control_signals(states: DataFrame) -> DataFrame:
    """Pause, probe and resume signals of the state changes."""
    signal = F.when(F.col("state") == OPEN, "PAUSE").when(F.col("state") == HALF_OPEN, "PROBE") \
        .otherwise("RESUME")
    return transitions(states).select(
        "source", signal.alias("signal"),
        F.timestamp_seconds("slice").cast("timestamp_ntz").alias("issued_at"),
        F.concat(F.col("state_before"), F.lit("->"), F.col("state")).alias("reason"))


def gate(events: DataFrame, states: DataFrame, ts: str, source: str = "source",
         options: BreakerOptions = BreakerOptions(), spread_by: list[str] | None = None) -> DataFrame:
    """Adds ``gate``: pass, probe or divert, by the state in force in the
    event's slice.

    Every slice with events has a state row, so this is an equality join on
    (source, slice) and not a range join on open intervals.
    """
    at = events.withColumn("_slice", slice_start(F.col(ts), options.step))
    per_slice = states.select(F.col("source").alias(source), F.col("slice").alias("_slice"),
                              "state_before", F.col("total").alias("_total"))
    joined = attach(at, per_slice, [source, "_slice"], "_total", spread_by=spread_by)
    verdict = F.when(F.col("state_before") == OPEN, "divert") \
        .when(F.col("state_before") == HALF_OPEN, "probe").otherwise("pass")
    return joined.withColumn("gate", verdict).drop("_slice", "state_before", "_total")


def released(events: DataFrame, states: DataFrame, ts: str, source: str = "source", options: BreakerOptions = BreakerOptions(),
             spread_by: list[str] | None = None, block: int = 1 << 12) -> DataFrame:
    """Diverted events, with their ``slice`` and ``released_at``: the slice at which their source closed next.

    The end of an open time is looked up per open slice, not per event. Events whose source has not closed since are left out.
    """
    at = lambda c: (-F.col(c)).alias("_at")   # the next closing is the last one, seen backwards
    open_slices = states.where(F.col("state_before") == OPEN).select("source", "slice", "total", at("slice"))
    closings = states.where((F.col("state") == CLOSED) & (F.col("state_before") != CLOSED)).select(
        "source", F.col("slice").alias("released_at"), at("slice"))
    until = asof(open_slices, closings, ["source"], "_at", ["released_at"], block * options.step).select(
        F.col("source").alias(source), "slice", F.col("total").alias("_total"), "released_at")
    placed = events.withColumn("slice", slice_start(F.col(ts), options.step))
    return attach(placed, until, [source, "slice"], "_total", spread_by=spread_by).where(F.col("released_at").isNotNull()).drop("_total")


def incident_context(incident_rows: DataFrame, sliced: DataFrame) -> DataFrame:
    """Incidents with the slice totals at which they happened."""
    at = F.timestamp_seconds("slice").cast("timestamp_ntz")
    return incident_rows.join(
        sliced.select("source", at.alias("opened_at"), F.col("total").alias("slice_total"),
                      F.col("bad").alias("slice_bad")), ["source", "opened_at"])


def probe_sample(events: DataFrame, keys: list[str], order: list[str], n: int = 50) -> DataFrame:
    """First n rows per key by arrival: the sample a half-open breaker tests.

    Spark keeps n rows per key and task before the shuffle.
    """
    w = W.partitionBy(*keys).orderBy(*order)
    return events.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= n).drop("_rank")
