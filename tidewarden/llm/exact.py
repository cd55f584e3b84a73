"""Exact dedup by progressive refinement: length, then a hash of the prefix, then a hash of the whole text.

Two texts are equal when they are after each run of blanks became one space. The first reading keeps a length and a
prefix hash of each text, 24 bytes a row. Rows alone with their length, then rows alone with length and prefix, are
settled by that. Only for the surviving groups does a second reading hash whole texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidewarden.llm.common import BLANKS, settle, text_of, unused

PREFIX_CHARS = 64


def normal(name: str) -> Column:
    return F.regexp_replace(text_of(name), BLANKS, " ")


def digest(name: str) -> Column:
    """sha256 of the text after its blanks became single spaces, in lower-case hex."""
    return F.sha2(F.encode(normal(name), "UTF-8"), 256)


def _shapes(docs: DataFrame, text_name: str) -> tuple[list[Column], DataFrame]:
    """The columns of a text's shape, and the shapes (_len, _prefix) that more than one text has.

    Counted by shape before anything else moves, so a hot length or a group of copies is one row.
    """
    text = normal(text_name)
    shape = [F.length(text).alias("_len"), F.xxhash64(F.substring(text, 1, PREFIX_CHARS)).alias("_prefix")]
    shapes = settle(docs.select(*shape).groupBy("_len", "_prefix").agg(F.count("*").alias("_n")), "exact-shapes")
    lengths = shapes.groupBy("_len").agg(F.sum("_n").alias("_rows")).where("_rows > 1").select("_len")
    return shape, shapes.join(lengths, "_len", "left_semi").where("_n > 1").select("_len", "_prefix")


def exact_groups(docs: DataFrame, id_name: str = "doc_id", text_name: str = "text",
                 digest_all: bool = False) -> DataFrame:
    """One row per document: (id, keep_id, group_size, kept, text_sha256).

    A null text counts as empty; empty texts equal each other. Of equal texts the smallest id stays (nulls last); rows
    that repeat an id with an equal text stand or fall together. ``text_sha256`` is null for texts that an earlier
    step found to be alone, unless ``digest_all`` asks for the digest of each. Other columns are ignored; an empty table
    gives no rows.
    """
    shape, survivors = _shapes(docs, text_name)
    rows = docs.select(F.col(id_name).alias("_id"), normal(text_name).alias("_text"), *shape)
    sha = F.sha2(F.encode("_text", "UTF-8"), 256)
    if digest_all:
        hashed = settle(rows.select("_id", "_len", "_prefix", sha.alias("_sha")), "exact-hashes")
        full = hashed.join(survivors, ["_len", "_prefix"], "left_semi")
    else:
        full = settle(rows.join(survivors, ["_len", "_prefix"], "left_semi")
                      .select("_id", "_len", "_prefix", sha.alias("_sha")), "exact-hashes")
    groups = full.groupBy("_len", "_prefix", "_sha").agg(
        F.min("_id").alias("_keep"), F.count("*").alias("_n")).where("_n > 1")
    if digest_all:
        out = hashed.join(groups, ["_len", "_prefix", "_sha"], "left")
    else:
        alone = rows.join(survivors, ["_len", "_prefix"], "left_anti").select(
            "_id", F.lit(None).cast("string").alias("_sha"), F.lit(None).cast(docs.schema[id_name].dataType).alias("_keep"),
            F.lit(None).cast("long").alias("_n"))
        out = full.join(groups, ["_len", "_prefix", "_sha"], "left").select("_id", "_sha", "_keep", "_n").unionByName(alone)
    keep = F.coalesce("_keep", "_id")
    return out.select(F.col("_id").alias(id_name), keep.alias("keep_id"),
                      F.coalesce("_n", F.lit(1)).cast("long").alias("group_size"),
                      keep.eqNullSafe(F.col("_id")).alias("kept"), F.col("_sha").alias("text_sha256"))


def distinct_rows(docs: DataFrame, id_name: str = "doc_id", text_name: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: of equal texts the one with the smallest id (nulls last).

    Of rows that repeat this id and the text one stays, any of them. A null text counts as empty. Only texts of shared
    shapes are hashed, and only narrow tables are grouped, but for rows that repeat id and text. An empty table gives
    no rows.
    """
    shape, survivors = _shapes(docs, text_name)
    survivors = settle(survivors, "exact-survivors")
    length, prefix, shared, sha, keep, times = (unused(docs, f"_exact_{x}") for x in ("len", "prefix", "shared", "sha", "keep", "times"))
    marked = docs.withColumns({length: shape[0], prefix: shape[1]}).join(
        survivors.select(F.col("_len").alias(length), F.col("_prefix").alias(prefix), F.lit(True).alias(shared)), [length, prefix], "left") \
        .withColumn(sha, F.when(F.col(shared), digest(text_name)))
    same = [length, prefix, sha]
    # Rows are counted by id first, then the smallest id is taken, so a group of copies is few rows.
    ids = marked.where(F.col(shared)).groupBy(*same, F.col(id_name).alias(keep)).agg(F.count("*").alias(times))
    first = F.min(F.struct(F.col(keep).isNull(), keep, times))
    groups = settle(ids.groupBy(*same).agg(first.alias("_first"), F.sum(times).alias("_n")).where("_n > 1")
                    .select(*same, f"_first.{keep}", f"_first.{times}"), "exact-groups")
    kept = marked.join(groups, same, "left").where(F.col(times).isNull() | F.col(keep).eqNullSafe(F.col(id_name)))
    if not groups.where(F.col(times) > 1).isEmpty():
        once = F.coalesce(F.col(times), F.lit(1)) == 1
        kept = kept.where(once).unionByName(kept.where(~once).dropDuplicates(same))
    return kept.select(*docs.columns)
