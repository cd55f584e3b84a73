"""Catalog, ledgered tables, day partitions, compaction."""

import pytest
from conftest import arrivals, event
from pyspark.sql import functions as F

from tidewarden import model
from tidewarden.operators.ingest import to_bronze
from tidewarden.sources import catalog, sinks, streams
from tidewarden.session import shared_dir


def test_catalog(spark):
    assert catalog.missing_tables(spark).count() == 4
    made = catalog.create_all(spark)
    assert set(made.values()) == {"created"} and set(catalog.create_all(spark).values()) == {"exists"}
    assert catalog.missing_tables(spark).count() == 0
    assert {"bronze", "silver", "quarantine", "audit"} <= {r[0] for r in catalog.namespaces(spark).collect()}
    assert {r.status for r in catalog.bronze_conformance(spark).collect()} == {"OK"}
    assert catalog.bronze_conformance(spark).count() == 14
    assert catalog.table_format(spark, "bronze.checkout_events") == "parquet"
    wrong = catalog.conformance(catalog.columns(spark, "bronze.checkout_events"), [("event_id", "int"), ("x", "int")])
    assert {r.status for r in wrong.collect()} == {"WRONG_TYPE", "MISSING", "EXTRA"}

    rows = to_bronze(arrivals(spark, [event(1), event(2, amount=None)]))
    sinks.append(rows, "bronze.checkout_events")
    assert spark.table("bronze.checkout_events").count() == 2
    narrow = model.TableSpec("bronze", "checkout_events", model.layout("event_id STRING"))
    with pytest.raises(ValueError):
        catalog.create_table(spark, narrow)
    assert spark.table("bronze.checkout_events").count() == 2
    assert catalog.create_table(spark, narrow, recreate=True) == "recreated"
    assert spark.table("bronze.checkout_events").count() == 0


def test_values_with_typed_nulls(spark):
    spark.sql("CREATE DATABASE IF NOT EXISTS scratch")
    spark.sql("CREATE TABLE scratch.four (event_id STRING, event_time TIMESTAMP_NTZ, customer_id STRING, "
              "amount DECIMAL(18,2)) USING parquet")
    spark.sql("""INSERT INTO scratch.four VALUES
      ('a', TIMESTAMP_NTZ'2024-03-01 07:00:00', 'first buyer', 12.25), ('a', TIMESTAMP_NTZ'2024-03-01 07:00:00', 'first buyer', 12.25),
      ('b', TIMESTAMP_NTZ'2024-03-02 08:15:00', 'second buyer', 0.50),
      ('c', TIMESTAMP_NTZ'2024-03-05 23:59:59', CAST(NULL AS STRING), CAST(NULL AS DECIMAL(18,2)))""")
    t = spark.table("scratch.four")
    assert t.count() == 4 and t.limit(10).count() == 4 and t.where("amount IS NULL").count() == 1


def test_ledger_is_idempotent_and_keeps_history(spark):
    path = shared_dir(spark, "ledger")
    sinks.write_batch(spark.range(3), path, 0)
    sinks.write_batch(spark.range(3, 5), path, 1)
    sinks.write_batch(spark.range(3, 6), path, 1)
    assert sinks.read_table(spark, path).count() == 6
    assert sinks.read_table(spark, path, as_of=0).count() == 3
    assert [(r.batch_id, r.rows) for r in sinks.snapshots(spark, path).orderBy("batch_id").collect()] == [(0, 3), (1, 3)]
    spark.range(9).write.parquet(f"{path}/data/batch_id=2")   # written, never committed
    assert sinks.read_table(spark, path).count() == 6


def test_days_and_compaction(spark):
    path, staging = shared_dir(spark, "days"), shared_dir(spark, "staging")
    df = spark.range(400).select("id", F.timestamp_seconds(F.col("id") * 600).alias("at"))
    for part in (0, 1):
        sinks.write_by_day(df.where(f"id % 2 = {part}"), path, "at")
    first_day = lambda t: [f for f in t.inputFiles() if "1970-01-01" in f]
    t = spark.read.parquet(path)
    pruned = t.where("day = '1970-01-01'")
    assert "PartitionFilters: [isnotnull(day" in pruned._jdf.queryExecution().executedPlan().toString()
    assert pruned.count() == 144 and len(first_day(t)) >= 2
    sinks.compact_day(spark, path, "1970-01-01", 1, staging)
    t = spark.read.parquet(path)
    assert t.count() == 400 and len(first_day(t)) == 1


def test_a_large_day_is_shared_by_many_tasks(spark):
    """As many as the day's size needs, here far more than 32."""
    path, key = shared_dir(spark, "large-day"), "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    before = spark.conf.get(key)
    spark.conf.set(key, "8k")
    try:
        df = spark.range(0, 200_000, 1, 200).select(F.md5(F.col("id").cast("string")).alias("id"),
                                                    F.timestamp_seconds(F.col("id") % 80_000).alias("at"))
        sinks.write_by_day(df, path, "at")
    finally:
        spark.conf.set(key, before)
    t = spark.read.parquet(path)
    assert t.count() == 200_000 and t.select("day").distinct().count() == 1 and len(t.inputFiles()) > 32


def test_shared_folders_must_be_set_on_a_cluster(monkeypatch):
    class Cluster:
        conf = type("Conf", (), {"get": lambda self, key, default=None: default})()
        sparkContext = type("Context", (), {"master": "spark://host:7077"})()
    with pytest.raises(RuntimeError):
        shared_dir(Cluster(), "x")


def test_text_sink(spark):
    path = shared_dir(spark, "text")
    streams.write_text(arrivals(spark, [event(1), event(2)]), path)
    assert spark.read.text(path).count() == 2


def test_broker_options_are_checked(spark):
    with pytest.raises(ValueError):
        streams.broker_stream(spark, "x:1", start="middle")
    rows = spark.sql("SELECT 0 AS partition, 5L AS offset, current_timestamp() AS timestamp, CAST('{}' AS BINARY) AS value")
    assert streams.from_broker_rows(rows).columns == ["partition", "offset", "arrived_at", "value"]
