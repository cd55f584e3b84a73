"""Running computations over a log, without sorting a whole log in one task.

A log is a set of rows with a position that is unique within its keys, such as
the offset in a topic partition. Positions are cut into blocks of fixed length,
so a block never holds more than ``block`` rows, however many rows a key has.
Blocks are summed up first (a partial aggregate and a small table of one row
per block), each block receives what came before it, and only then are the rows
of one block ordered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

BLOCK = 1 << 17   # a task of some seconds; there is one carried row per block


def _blocked(df: DataFrame, pos: str, block: int) -> DataFrame:
    return df.withColumn("_block", F.floor(F.col(pos) / F.lit(block)).cast("long"))


def _carried(blocked: DataFrame, keys: list[str], summary: Column, fold) -> DataFrame:
    """Per block: the fold of the summaries of all earlier blocks."""
    before = W.partitionBy(*keys).orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    sums = blocked.groupBy(*keys, "_block").agg(summary.alias("_sum"))
    return sums.select(*keys, "_block", fold(F.col("_sum")).over(before).alias("_carry"))


def _join_blocks(blocked: DataFrame, carried: DataFrame, keys: list[str]) -> DataFrame:
    on = keys + ["_block"]   # a row without a position has a block of its own, null
    small = carried.select(*[F.col(c).alias(f"_b_{c}") for c in on], "_carry")
    cond = None
    for c in on:
        part = F.col(c).eqNullSafe(F.col(f"_b_{c}"))
        cond = part if cond is None else cond & part
    return blocked.join(small, cond).drop(*[f"_b_{c}" for c in on])


def row_index(df: DataFrame, keys: list[str], pos: str, out: str, block: int = BLOCK) -> DataFrame:
    """1-based dense index of each row within its keys, by position."""
    blocked = _blocked(df, pos, block)
    carried = _carried(blocked, keys, F.count(F.lit(1)), F.sum)
    inside = W.partitionBy(*keys, "_block").orderBy(pos)
    return (_join_blocks(blocked, carried, keys)
            .withColumn(out, F.coalesce(F.col("_carry"), F.lit(0)) + F.row_number().over(inside))
            .drop("_block", "_carry"))


def running_max_before(df: DataFrame, keys: list[str], pos: str, value: Column, out: str,
                       block: int = BLOCK) -> DataFrame:
    """Largest ``value`` among the rows before this one; NULL for the first."""
    blocked = _blocked(df, pos, block).withColumn("_value", value)
    carried = _carried(blocked, keys, F.max("_value"), F.max)
    inside = (W.partitionBy(*keys, "_block").orderBy(pos)
              .rowsBetween(W.unboundedPreceding, -1))
    return (_join_blocks(blocked, carried, keys)
            .withColumn(out, F.greatest(F.col("_carry"), F.max("_value").over(inside)))
            .drop("_block", "_carry", "_value"))


def running_sums(df: DataFrame, keys: list[str], pos: str, values: dict[str, str], block: int = BLOCK) -> DataFrame:
    """Adds per entry ``out: column`` the sum of the column up to and with this row; nulls count zero.

    A block receives the sums of all earlier blocks, one row per block, and adds its own rows up.
    """
    blocked = _blocked(df, pos, block)
    before = W.partitionBy(*keys).orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    sums = blocked.groupBy(*keys, "_block").agg(*[F.sum(c).alias(f"_s_{out}") for out, c in values.items()])
    carried = sums.select(*keys, "_block", F.struct(*[F.sum(f"_s_{out}").over(before).alias(out) for out in values]).alias("_carry"))
    inside = W.partitionBy(*keys, "_block").orderBy(pos).rowsBetween(W.unboundedPreceding, 0)
    out = _join_blocks(blocked, carried, keys)
    for name, c in values.items():
        out = out.withColumn(name, F.coalesce(F.col("_carry")[name], F.lit(0)) + F.coalesce(F.sum(c).over(inside), F.lit(0)))
    return out.drop("_block", "_carry")


def asof(left: DataFrame, right: DataFrame, keys: list[str], at: str, values: list[str], block: int) -> DataFrame:
    """Left join with the newest right row of the same keys that is not later: ``left`` and the ``values``.

    Of right rows of one key and time the largest values count. Time is cut into blocks of ``block`` units: each block
    receives the newest right row of all earlier ones, and only the rows of one block and key are ordered together. Rows
    without a time match nothing.
    """
    kinds = {f.name: f.dataType for f in right.schema.fields}
    row = F.struct(at, *values)
    none = F.lit(None)
    sides = left.select(*keys, at, F.struct(*left.columns).alias("_left"), none.cast(right.select(row.alias("r")).schema["r"].dataType).alias("_right")) \
        .unionByName(right.where(F.col(at).isNotNull()).select(
            *keys, F.col(at).cast(left.schema[at].dataType).alias(at), none.cast(left.select(F.struct(*left.columns).alias("l")).schema["l"].dataType)
            .alias("_left"), row.alias("_right")))
    blocked = _blocked(sides, at, block)
    carried = _carried(blocked, keys, F.max("_right"), F.max)
    inside = W.partitionBy(*keys, "_block").orderBy(at).rangeBetween(W.unboundedPreceding, 0)
    met = _join_blocks(blocked, carried, keys).withColumn("_met", F.coalesce(F.max("_right").over(inside), "_carry")) \
        .where(F.col("_left").isNotNull())
    timed = F.col("_left")[at].isNotNull()
    return met.select("_left.*", *[F.when(timed, F.col("_met")[v]).cast(kinds[v]).alias(v) for v in values])


def newest(df: DataFrame, keys: list[str], pos: str, n: int, block: int = BLOCK) -> DataFrame:
    """The n rows with the highest positions of each key.

    Blocks that lie wholly behind the newest n rows are dropped by their
    counts; the ranking sees at most n rows plus one block per key.
    """
    blocked = _blocked(df, pos, block)
    after = W.partitionBy(*keys).orderBy(F.desc("_block")).rowsBetween(W.unboundedPreceding, -1)
    counts = blocked.groupBy(*keys, "_block").agg(F.count(F.lit(1)).alias("_sum"))
    kept = counts.withColumn("_carry", F.coalesce(F.sum("_sum").over(after), F.lit(0))) \
        .where(F.col("_carry") < n)
    newest_first = W.partitionBy(*keys).orderBy(F.desc(pos))
    return (_join_blocks(blocked, kept, keys)
            .withColumn("_rank", F.row_number().over(newest_first))
            .where(F.col("_rank") <= n)
            .drop("_block", "_carry", "_rank"))
