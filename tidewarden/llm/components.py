"""Connected components by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tidewarden.llm.common import settle


def components(links: DataFrame, turns: int | None = None) -> DataFrame:
    """(id, root) of each vertex in ``links`` (a, b: long): the root is the smallest vertex that links reach.

    After at most ``turns`` turns, if given, roots may still differ within a component, never be equal across two.

    Each turn points the larger neighbours of a vertex, then the smaller ones, to the smallest; paths halve. The minimum
    of a vertex is aggregated before the shuffle, and joined back to its links, so a vertex with very many links is
    never gathered; the turns end when one changes nothing.
    """
    edges = settle(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
                   .distinct(), "edges")
    before = None
    while turns is None or turns > 0:
        turns = None if turns is None else turns - 1
        state = None if turns is not None else edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state is not None and state == before:
            break
        before = state
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = large.groupBy("u").agg(F.min("v").alias("m"))
        turned = large.join(small, "u")
        edges = settle(turned.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                       .union(small.select("u", F.col("m").alias("v")))
                       .where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
                       .distinct(), "edges")
    if turns is not None:   # a vertex may still have several edges
        edges = edges.groupBy("u").agg(F.min("v").alias("v"))
    roots = edges.select(F.col("u").alias("id"), F.col("v").alias("root"))
    if turns is not None:
        return roots
    return roots.union(edges.select(F.col("v").alias("id"), F.col("v").alias("root")).distinct())
