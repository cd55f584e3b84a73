"""Duplicate detection by event id: first arrival lands, the rest is flagged."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidewarden.operators.skew import HOT_MIN_ROWS, attach

ARRIVAL = ["arrived_at", "partition", "offset"]


def _rank(order: list[str]) -> Column:
    """One comparable value; a single column stays a plain, hashable number."""
    return F.col(order[0]) if len(order) == 1 else F.struct(*order)


def repeated_ids(df: DataFrame, id_col: str, order: list[str]) -> DataFrame:
    """Ids seen more than once, with their count and first position."""
    return (df.where(F.col(id_col).isNotNull()).groupBy(id_col)
            .agg(F.count(F.lit(1)).alias("_n"), F.min(_rank(order)).alias("_first"))
            .where(F.col("_n") > 1))


def flag_duplicates(df: DataFrame, id_col: str = "event_id", order: list[str] | None = None,
                    out: str = "is_duplicate", hot_min_rows: int = HOT_MIN_ROWS) -> DataFrame:
    """Flags every row but the first of its id. Rows without id are no duplicates.

    Counting collapses copies before the shuffle; only ids that do repeat are
    then attached to the rows, so no group of copies is sorted as a whole.
    """
    order = order or ARRIVAL
    joined = attach(df, repeated_ids(df, id_col, order), [id_col], "_n",
                    spread_by=order, hot_min_rows=hot_min_rows)
    later = F.col("_first").isNotNull() & (_rank(order) > F.col("_first"))
    return joined.withColumn(out, later).drop("_n", "_first")


def keep_first(df: DataFrame, id_col: str = "event_id", order: list[str] | None = None) -> DataFrame:
    """The first row of each id, and every row without an id.

    Rows whose id does not repeat are not gathered; see :func:`flag_duplicates`.
    """
    return flag_duplicates(df, id_col, order, "_again").where("NOT _again").drop("_again")


def duplicate_count(df: DataFrame, id_col: str = "event_id") -> DataFrame:
    """Rows, distinct ids and their difference; NULL counts as one id."""
    per_id = df.groupBy(id_col).agg(F.count(F.lit(1)).alias("n"))
    return per_id.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"),
                      F.count(F.lit(1)).alias("distinct_ids")) \
        .withColumn("duplicates", F.col("rows") - F.col("distinct_ids"))


def not_landed(df: DataFrame, landed: DataFrame, id_col: str = "event_id") -> DataFrame:
    """Rows whose id is not in the landed table (whose ids are unique)."""
    return df.join(landed.select(id_col), id_col, "left_anti")
