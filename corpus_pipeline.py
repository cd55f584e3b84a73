"""Corpus pipeline: stages over ``documents``, each written as Parquet and read again by the next one.

Each stage works on all that the one before it kept. All but the last return the columns of ``documents``, whatever
these are, of the rows that stay. Rows with a null or empty text go at the first stage, as no language is found in
them; rows that repeat an id are judged each by its text: of rows with the same id and text one stays, and of near copies one,
whatever their ids. An empty table runs through to an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidewarden.llm import exact, language, neardup, packing, quality
from tidewarden.llm.common import bucket, settle, table, unused


def _only(docs: DataFrame, kept: DataFrame, keys: dict) -> DataFrame:
    """The rows of ``docs`` whose keys, columns of it by the names that ``kept`` has, occur there."""
    names = {k: unused(docs, f"_kept_{k}") for k in keys}
    kept = kept.select(*[F.col(k).alias(n) for k, n in names.items()]).distinct()
    same = [column.eqNullSafe(F.col(names[k])) for k, column in keys.items()]
    return docs.join(kept, same, "left_semi")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language ID (5): texts without a language or with a doubtful one go."""
    name = unused(docs, "_language")
    judged = language.predict(docs, language.learn(docs, bucket("doc_id", 3) != 1), as_name=name)
    return judged.where((F.col(f"{name}.lang_pred") != language.NONE) & ~F.col(f"{name}.ambiguous")).select(*docs.columns)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Quality classifier (3): documents predicted as label 0 go."""
    name = unused(docs, "_quality")
    trees = quality.learn(docs, table(spark, sf_dir, "labels"), bucket("doc_id", 5) != 0)
    return quality.predict(docs, trees, as_name=name).where(F.col(f"{name}.predicted") == 1).select(*docs.columns)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Exact dedup (7): of equal texts the smallest id stays, in one row."""
    return exact.distinct_rows(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """MinHash near-dedup (4): one document of each group stays."""
    return _only(docs, neardup.survivors(docs), {"doc_id": docs["doc_id"], "text_sha256": exact.digest("text")})


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packing (8) of what the other stages kept."""
    return packing.pack(docs)


STAGES = [("language ID", language_id), ("quality classifier", quality_classifier), ("exact dedup", exact_dedup),
          ("MinHash near-dedup", near_dedup), ("packing", packed)]

ORACLE_SQL = None   # models and tokenizers are not expressible in SQL; tests hold it against a brute-force version


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
