"""Stateful streams: dropping duplicates, and the circuit breaker."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidewarden.operators.breaker import STATES, BreakerOptions, BreakerState, fold_rows
from tidewarden.session import DEFAULTS

STORE = "spark.sql.streaming.stateStore.providerClass"
WIDTH = "spark.sql.shuffle.partitions"
SPLITS = "spark.sql.files.minPartitionNum"


@contextmanager
def processor_store(spark: SparkSession) -> Iterator[None]:
    """For starting queries with stateful processors: only one state store of Spark's has the column families they need, and a
    session may name the other one. A query copies the session's settings when it starts, so the setting is put back after that."""
    before = spark.conf.get(STORE)
    spark.conf.set(STORE, DEFAULTS[STORE])
    try:
        yield
    finally:
        spark.conf.set(STORE, before)


@contextmanager
def narrow_state(spark: SparkSession) -> Iterator[None]:
    """For starting queries whose state is kept by slices, sources or shards: few keys, however many events. Each state partition is opened
    and committed in each batch, with rows or without, so there are no more of them than cores. A later start keeps the first one's number."""
    before = spark.conf.get(WIDTH)
    spark.conf.set(WIDTH, min(int(before), spark.sparkContext.defaultParallelism))
    try:
        yield
    finally:
        spark.conf.set(WIDTH, before)


@contextmanager
def fine_splits(spark: SparkSession) -> Iterator[None]:
    """For reading payloads that are checked row by row: some splits a core. By size alone there is about one, and one more keeps all cores
    but its own waiting for as long as the first ones took. The setting holds while plans are made, so until a query is over."""
    before = spark.conf.get(SPLITS, None)
    if before is None:
        spark.conf.set(SPLITS, 4 * spark.sparkContext.defaultParallelism)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(SPLITS)


def keep_first_stream(rows: DataFrame, ts: str, window: str = "1 hour", id_col: str = "event_id") -> DataFrame:
    """First row of each id within a time window; later copies are dropped.

    Runs in the JVM on the state store. To keep the copies for quarantine, use
    the router in ``routing``, which looks ids up in bulk: a Python processor
    per id would cost a call per id, and ids hardly repeat. Rows without an
    event time must be routed away first.
    """
    return rows.withWatermark(ts, window).dropDuplicatesWithinWatermark([id_col])


class _Breaker(StatefulProcessor):
    """Carries the breaker of one source from batch to batch."""

    def __init__(self, options: BreakerOptions):
        self.options = options

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.saved = handle.getValueState(
            "breaker", "state string, opened_at bigint, sample_total bigint, slices array<bigint>, "
            "totals array<bigint>, bads array<bigint>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        state = BreakerState()
        if self.saved.exists():
            s, opened, sampled, at, total, bad = self.saved.get()
            state = BreakerState(s, opened, sampled, [list(x) for x in zip(at, total, bad)])
        # Slices of one source that closed since the last batch: a few rows.
        new = pd.concat(list(rows), ignore_index=True).sort_values("slice")
        out = fold_rows(key[0], zip(new["slice"], new["total"], new["bad"]), state, self.options)
        w = state.window
        self.saved.update((state.state, state.opened_at, state.sample_total, [int(x[0]) for x in w],
                           [int(x[1]) for x in w], [int(x[2]) for x in w]))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in STATES.split(", ")])

    def close(self) -> None:
        pass


def stream_slices(checked: DataFrame, options: BreakerOptions, lateness: str, ts: str = "arrived_at",
                  source: str = "source") -> DataFrame:
    """Closed slices of a stream of checked events: (source, slice, total, bad)."""
    w = F.window(F.col(ts), f"{options.step} seconds")
    return (checked.withWatermark(ts, lateness).groupBy(F.col(source).alias("source"), w)
            .agg(F.count(F.lit(1)).alias("total"),
                 F.sum(F.when(F.size("failures") > 0, 1).otherwise(0)).cast("long").alias("bad"))
            .select("source", F.unix_timestamp("window.start").alias("slice"), "total", "bad"))


def breaker_stream(sliced: DataFrame, options: BreakerOptions = BreakerOptions()) -> DataFrame:
    """Breaker state per closed slice, as in the batch operator."""
    return sliced.where(F.col("source").isNotNull()).groupBy("source").transformWithStateInPandas(
        _Breaker(options), outputStructType=STATES, outputMode="Append", timeMode="None")
