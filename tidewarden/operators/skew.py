"""Joins that stay balanced when one key owns a large share of the rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

HOT_KEYS = 1024          # rows broadcast at most, whatever the data size
HOT_MIN_ROWS = 100_000   # keys with fewer rows are never worth special care
SALTS = 256


def _same(left: str, right: str, keys: list[str]) -> Column:
    """Null-safe equality of two aliased frames on the same-named keys."""
    return reduce(lambda a, b: a & b, [F.col(f"{left}.{k}").eqNullSafe(F.col(f"{right}.{k}")) for k in keys])


def attach(df: DataFrame, per_key: DataFrame, keys: list[str], weight: str | None,
           spread_by: list[str] | None = None, hot_keys: int = HOT_KEYS, hot_min_rows: int = HOT_MIN_ROWS) -> DataFrame:
    """Left join of rows with a table holding one row per key.

    ``weight`` names the column of ``per_key`` with the row count of the key in
    ``df``. The heaviest keys, at most ``hot_keys`` of them, travel by
    broadcast, so their rows are never gathered by key. All other rows take an
    ordinary shuffle join, in which no key holds more than rows/hot_keys rows;
    the rows already served are spread over salts there, where they match
    nothing. Both ways give the same values, so the choice of hot keys affects
    speed only. ``spread_by`` names columns that differ between the rows of a
    key; the salt is hashed from them, so a retried task places rows alike.

    ``weight=None`` is for tables of a fixed small row count (a global
    aggregate, one row per rule): the whole table is broadcast.
    """
    values = [c for c in per_key.columns if c not in keys]
    left = df.alias("l")
    if weight is None:
        right = F.broadcast(per_key).alias("r")
        return left.join(right, _same("l", "r", keys), "left") \
            .select(*[F.col(f"l.{c}").alias(c) for c in df.columns], *[F.col(f"r.{c}").alias(c) for c in values])

    hot = (per_key.where(F.col(weight) >= hot_min_rows)
           .orderBy(F.desc(weight)).limit(hot_keys)
           .select(*[F.col(k).alias(f"_hk_{k}") for k in keys],
                   F.struct(*values).alias("_hot")))
    matched = left.join(F.broadcast(hot), reduce(
        lambda a, b: a & b, [F.col(f"l.{k}").eqNullSafe(F.col(f"_hk_{k}")) for k in keys]), "left")
    matched = matched.select(*[F.col(f"l.{c}").alias(c) for c in df.columns], "_hot")
    spread = F.pmod(F.xxhash64(*[F.col(c) for c in spread_by or _cheap(df)]), F.lit(SALTS)).cast("int")
    matched = matched.withColumn("_salt", F.when(F.col("_hot").isNull(), F.lit(-1)).otherwise(spread))

    cold = per_key.select(*[F.col(k).alias(f"_ck_{k}") for k in keys],
                          F.lit(-1).alias("_csalt"), F.struct(*values).alias("_cold"))
    joined = matched.join(cold, reduce(
        lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_ck_{k}")) for k in keys]
        + [F.col("_salt") == F.col("_csalt")]), "left")
    chosen = F.coalesce(F.col("_hot"), F.col("_cold"))
    return joined.select(*df.columns, *[chosen[c].alias(c) for c in values])


def _cheap(df: DataFrame) -> list[str]:
    """Columns that can seed a salt: atomic ones, ids first."""
    atomic = [f.name for f in df.schema.fields
              if f.dataType.typeName() not in ("map", "variant", "array", "struct")]
    return atomic or df.columns[:1]
