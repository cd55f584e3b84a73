"""Checkout events derived from the ``events`` table.

The table is clean; deterministic draws give it log positions, arrival times,
contract versions and faults, so that every operator has something to find.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidewarden import model
from tidewarden.functions.draws import choice, digest, draw
from tidewarden.functions.times import iso_millis
from tidewarden.operators.chaos import FaultRates, corrupt
from tidewarden.operators.ordered import BLOCK
from tidewarden.session import shared_dir

RATES = FaultRates(individual={"NULL": 1.0, "DUPLICATE": 0.5, "NEGATIVE": 0.5, "INVALID_ENUM": 0.5,
                               "SCHEMA_DRIFT": 0.2, "TYPE_CHANGE": 0.5, "TIMESTAMP_DRIFT": 0.5})
SEED = 7


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkouts(events: DataFrame) -> DataFrame:
    """Typed checkout rows, one per event, before any fault.

    Position in the log: partition = user_id mod 3, pos = event_id. An event
    arrives up to two seconds after its event time.
    """
    rows = events.select(
        "event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", "value",
        digest(F.col("event_id"), "shape").alias("_d"), digest(F.col("event_id"), "clock").alias("_e"))
    n0, n1, n2, n3 = (draw(F.col("_d"), i) for i in range(4))
    e0, e1 = draw(F.col("_e"), 0), draw(F.col("_e"), 1)
    version = F.when(e1 % 1000 < 2, "v9").when(e1 % 1000 < 300, "v2").otherwise("v1")
    money = F.col("value").cast(model.MONEY)
    quantity = (1 + F.floor(n2 / 16) % 5).cast("int")
    return rows.select(
        (F.col("user_id") % 3).cast("int").alias("partition"),
        F.col("event_id").alias("pos"),
        F.timestamp_micros(F.unix_micros("ts") + (e0 % 2000) * 1000).alias("arrived_at"),
        F.concat(F.lit("evt_"), F.col("event_id").cast("string")).alias("event_id"),
        iso_millis(F.col("ts")).alias("event_time"),
        F.lit("checkout").alias("event_type"),
        F.concat(F.lit("CUS"), F.lpad(F.col("user_id").cast("string"), 6, "0")).alias("customer_id"),
        F.concat(F.lit("SES"), (100000 + n0 % 900000).cast("string")).alias("session_id"),
        F.concat(F.lit("ORD"), (1000000 + n1 % 9000000).cast("string")).alias("order_id"),
        F.concat(F.lit("PROD"), F.lpad((n2 % 10 + 1).cast("string"), 3, "0")).alias("product_id"),
        quantity.alias("quantity"),
        money.alias("unit_price"),
        (money * quantity).cast(model.MONEY).alias("amount"),
        F.lit("INR").alias("currency"),
        choice(model.PAYMENT_METHODS, n3).alias("payment_method"),
        F.when(F.col("event_type") == "error", "FAILED")
         .when(F.col("event_type") == "signup", "PENDING").otherwise("SUCCESS").alias("payment_status"),
        choice(["mobile", "desktop", "tablet"], F.floor(n3 / 8)).alias("device"),
        F.lit("IN").alias("country"),
        F.when(F.col("user_id") % 10 < 5, "web").when(F.col("user_id") % 10 < 8, "app")
         .otherwise("pos").alias("source"),
        version.alias("source_version"),
        F.when(version == "v2", F.concat(F.lit("SAVE"), (e0 % 50).cast("string"))).alias("coupon_code"))


def arrivals(events: DataFrame, rates: FaultRates = RATES, seed: int = SEED,
             block: int = BLOCK) -> DataFrame:
    """The raw log: (partition, offset, arrived_at, source, fault_mode, value).

    Of 300 payloads about one is cut off in transit, one each is followed by
    other text or by a second object, or written with single quotes, and three
    hold a number that does not fit.
    """
    dirty = corrupt(checkouts(events), rates, seed, block=block)
    value = F.col("value")
    torn = draw(digest(F.col("pos"), "torn"), 0) % 300

    def put(name: str, text: str) -> Column:
        return F.regexp_replace(value, f'"{name}":[^,}}]*', f'"{name}":{text}')

    return dirty.select(
        "partition", F.col("pos").alias("offset"), "arrived_at", "source", "fault_mode",
        F.when(torn == 0, F.substr(value, F.lit(1), F.length(value) - 20))
        .when(torn == 1, F.concat(value, F.lit(" x"))).when(torn == 2, F.concat(value, value))
        .when(torn == 3, put("amount", "1e400")).when(torn == 4, put("amount", "12345678901234567890"))
        .when(torn == 5, put("quantity", "5000000000")).when(torn == 6, F.translate(value, '"', "'")).otherwise(value).alias("value"))


_LANDED: dict[tuple[str, str], str] = {}


def raw_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The raw log as a landed table, the way an engine finds it.

    It is derived from the whole ``events`` table and written once per session
    to the shared folder; all plans then read it as files. No file holds more than a block's rows: a file is read by one
    task, and what is taken from a range of offsets lies in few files.
    """
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _LANDED:
        path = shared_dir(spark, "rawlog")
        events = table(spark, sf_dir, "events")
        # A table of few splits is spread over the cores before the costly part.
        width = max(spark.sparkContext.defaultParallelism, events.rdd.getNumPartitions())
        if events.rdd.getNumPartitions() < width:
            events = events.repartition(width, "event_id")
        arrivals(events).write.mode("overwrite").option("maxRecordsPerFile", BLOCK).parquet(path)
        _LANDED[key] = path
    return spark.read.parquet(_LANDED[key])
