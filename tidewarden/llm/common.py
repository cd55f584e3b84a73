"""What the operators of this package share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tidewarden.session import shared_dir

#: White space of the contracts, as a pattern that Java, Python and DuckDB read alike.
BLANKS = "[\\x20\\x09-\\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def settle(df: DataFrame, name: str) -> DataFrame:
    """The rows, written once as Parquet to the cluster's shared folder and read from there.

    It cuts lineage: what a lost executor held is read again and not computed again.
    """
    return settle_at(df, name)[0]


def settle_at(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """As ``settle``, with the folder, for ``forget``."""
    path = shared_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def forget(spark: SparkSession, path: str) -> None:
    """Removes a folder of ``settle_at`` whose rows nothing reads any more, so that rounds do not add up on disk."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def text_of(name: str) -> Column:
    """The text, a null one as the empty one."""
    return F.coalesce(F.col(name), F.lit(""))


def unused(df: DataFrame, name: str) -> str:
    """The name, or a longer one that no column of ``df`` has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def bucket(id_name: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``: the folds of the contracts."""
    return F.crc32(F.col(id_name).cast("string").cast("binary")) % modulus


def sample_per_class(rows: DataFrame, id_name: str, class_name: str, most: int) -> DataFrame:
    """(id, class) of at most ``most`` ids of each class, chosen by a hash of the id.

    ``most`` is at most 1000, so that each task keeps only its own first rows of a class before the shuffle.
    """
    order = Window.partitionBy(class_name).orderBy(F.xxhash64(F.col(id_name), F.lit(1)), id_name)
    return (rows.where(F.col(id_name).isNotNull() & F.col(class_name).isNotNull()).select(id_name, class_name).distinct()
            .withColumn("_nth", F.row_number().over(order)).where(F.col("_nth") <= most).drop("_nth"))


def one_of_each(rows: DataFrame, keys: list[str], text_name: str) -> DataFrame:
    """One row per key, chosen by a hash of its text; each task keeps one of each before the shuffle."""
    order = Window.partitionBy(*keys).orderBy(F.xxhash64(text_name), text_name)
    return rows.withColumn("_nth", F.row_number().over(order)).where(F.col("_nth") <= 1).drop("_nth")
