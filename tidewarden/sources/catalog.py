"""Namespaces and tables: creation, introspection, conformance."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidewarden import model


def create_namespaces(spark: SparkSession, names: list[str] = model.NAMESPACES) -> None:
    for name in names:
        spark.sql(f"CREATE DATABASE IF NOT EXISTS {name}")


def create_table(spark: SparkSession, spec: model.TableSpec, fmt: str = "parquet",
                 recreate: bool = False) -> str:
    """Creates a table unless it exists; returns created, exists or recreated.

    A table whose number of columns differs is dropped and created anew only
    with ``recreate``, because that loses its rows.
    """
    if spark.catalog.tableExists(spec.identifier):
        if len(spark.table(spec.identifier).schema) == len(spec.schema):
            return "exists"
        if not recreate:
            raise ValueError(f"{spec.identifier} has another layout; pass recreate=True to drop it")
        spark.sql(f"DROP TABLE {spec.identifier}")
        status = "recreated"
    else:
        status = "created"
    columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in spec.schema)
    split = f" PARTITIONED BY ({', '.join(spec.partition_by)})" if spec.partition_by else ""
    spark.sql(f"CREATE TABLE {spec.identifier} ({columns}) USING {fmt}{split}")
    return status


def create_all(spark: SparkSession, fmt: str = "parquet", recreate: bool = False) -> dict[str, str]:
    create_namespaces(spark)
    return {t.identifier: create_table(spark, t, fmt, recreate)
            for t in model.TABLES + model.OPERATIONS_TABLES}


def namespaces(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(d.name,) for d in spark.catalog.listDatabases()], "namespace string")


def tables(spark: SparkSession, namespace: str) -> DataFrame:
    return spark.createDataFrame(
        [(namespace, t.name) for t in spark.catalog.listTables(namespace) if not t.isTemporary],
        "namespace string, name string")


def columns(spark: SparkSession, identifier: str) -> DataFrame:
    return spark.createDataFrame(
        [(i, c.name, c.dataType, c.nullable) for i, c in enumerate(spark.catalog.listColumns(identifier))],
        "position int, name string, type string, nullable boolean")


def missing_tables(spark: SparkSession, expected: list[model.TableSpec] = model.TABLES) -> DataFrame:
    """Expected tables that are not there; a missing namespace misses them all."""
    want = spark.createDataFrame([(t.namespace, t.name) for t in expected], "namespace string, name string")
    have = None
    for name in {t.namespace for t in expected}:
        if spark.catalog.databaseExists(name):
            rows = tables(spark, name)
            have = rows if have is None else have.unionByName(rows)
    return want if have is None else want.exceptAll(have)


def conformance(actual: DataFrame, expected: list[tuple[str, str]]) -> DataFrame:
    """(name, expected, actual, status) of stored columns; a type conforms when
    it contains the expected name (``decimal`` in ``decimal(18,2)``)."""
    want = actual.sparkSession.createDataFrame(expected, "name string, expected string")
    both = want.join(actual.select("name", F.col("type").alias("actual")), "name", "full_outer")
    status = (F.when(F.col("actual").isNull(), "MISSING").when(F.col("expected").isNull(), "EXTRA")
              .when(F.col("actual").contains(F.col("expected")), "OK").otherwise("WRONG_TYPE"))
    return both.withColumn("status", status)


def bronze_conformance(spark: SparkSession, identifier: str = "bronze.checkout_events") -> DataFrame:
    expected = [(f.name, f.dataType.simpleString().split("(")[0].replace("_ntz", "")) for f in model.BRONZE]
    return conformance(columns(spark, identifier), expected)


def table_format(spark: SparkSession, identifier: str) -> str:
    """Storage format of a table, in lower case."""
    rows = spark.sql(f"DESCRIBE TABLE EXTENDED {identifier}").where("col_name = 'Provider'")
    return rows.first().data_type.lower()
