"""Decoding into bronze, completeness, the producer frame."""

import json
from decimal import Decimal

from conftest import SF, arrivals, event
from pyspark.sql import functions as F

from tidewarden import model
from tidewarden.operators import dedupe, ingest, metrics
from tidewarden.plans import feed


def bronze(spark, payloads):
    return ingest.to_bronze(arrivals(spark, payloads), F.col("arrived_at"))


def test_layout_and_values(spark):
    df = bronze(spark, [event(1)])
    assert df.columns == model.BRONZE.fieldNames() and all(f.nullable for f in model.BRONZE)
    row = df.first()
    assert row.event_time.isoformat() == "2026-08-20T10:30:21"
    assert row.amount == Decimal("1499.00")
    assert dict(df.dtypes)["amount"] == "decimal(18,2)" and dict(df.dtypes)["event_time"] == "timestamp_ntz"


def test_tolerant_decoding(spark):
    rows = {r.event_id: r for r in bronze(spark, [
        event(1, amount="1499.0"), event(2, customer_id=123), event(3, amount="junk", event_time="soon"),
        event(4, amount=2.675), event(5, amount=1e30), event(6, amount=...), event(7, extra={"a": 1}),
        event(None, event_id=None), event(8, event_id=...), '{"event_id":', "[1]", "text", None]).collect()}
    assert set(rows) == {f"evt_{i}" for i in range(1, 8)}
    assert rows["evt_1"].amount == Decimal("1499.00")
    assert rows["evt_2"].customer_id == "123"
    assert rows["evt_3"].amount is None and rows["evt_3"].event_time is None
    assert rows["evt_4"].amount == Decimal("2.68")
    assert rows["evt_5"].amount is None and rows["evt_6"].amount is None


def test_completeness_of_four_rows(spark):
    df = bronze(spark, [event(1), event(2), event(3, customer_id=None, amount=None), event(1)])
    out = metrics.completeness(df, ["event_id", "event_time", "customer_id", "amount"]).first()
    assert tuple(out) == (4, 4, 4, 3, 3)
    assert tuple(dedupe.duplicate_count(df).first()) == (4, 3, 1)
    nulls = metrics.null_presence(df, ["event_id", "amount"]).first()
    assert tuple(nulls) == (False, True)


def test_duplicate_count_takes_null_once(spark):
    df = spark.createDataFrame([("a",), (None,), (None,)], "event_id string")
    assert tuple(dedupe.duplicate_count(df).first()) == (3, 2, 1)


def test_required_columns(spark):
    df = bronze(spark, [event(1), event(2, amount=None)])
    assert ingest.enforce_required(df, ["amount"]).count() == 1
    assert ingest.enforce_required(df, []).count() == 2


def test_producer_frame_keeps_nulls_and_keys(spark):
    df = spark.createDataFrame([("e1", None), ("e2", "CUS1")], "event_id string, customer_id string")
    out = [(r.key, json.loads(r.value)) for r in ingest.producer_frame(df).orderBy("value").collect()]
    assert out == [("None", {"event_id": "e1", "customer_id": None}),
                   ("CUS1", {"event_id": "e2", "customer_id": "CUS1"})]
    assert ingest.producer_frame(df.select("event_id")).first().key is None


def test_one_parse_per_payload(spark):
    plan = bronze(spark, [event(1)])._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json") == 1


def test_no_file_of_the_landed_log_is_larger_than_a_block(spark, monkeypatch):
    """A file is read by one task, and a range of offsets lies in few files."""
    monkeypatch.setattr(feed, "_LANDED", {})
    monkeypatch.setattr(feed, "BLOCK", 20)
    files = feed.raw_log(spark, SF).groupBy(F.input_file_name()).count()
    assert files.agg(F.sum("count"), F.max("count")).first() == (feed.table(spark, SF, "events").count(), 20)
