"""Shared session and small inputs."""

import json
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path[:0] = [str(ROOT), str(ROOT / "tests")]

from tidewarden.session import build_session  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    home = tmp_path_factory.mktemp("spark")
    session = build_session(master="local[8]", extra={
        "spark.ui.enabled": "false", "spark.sql.shuffle.partitions": "8",
        "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "8g",
        "spark.checkpoint.dir": str(home / "shared"),
        "spark.sql.warehouse.dir": str(home / "warehouse")})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def event(i=1, **changes):
    """A valid version-1 payload as a dict; a value of ... drops the key."""
    base = {
        "event_id": f"evt_{i}", "event_time": "2026-08-20T10:30:21.123Z", "event_type": "checkout",
        "customer_id": "CUS000001", "session_id": "SES100001", "order_id": "ORD1000001",
        "product_id": "PROD001", "quantity": 2, "unit_price": 749.5, "amount": 1499.0,
        "currency": "INR", "payment_method": "UPI", "payment_status": "SUCCESS", "device": "mobile",
        "country": "IN", "source": "web", "source_version": "v1"}
    base.update(changes)
    return {k: v for k, v in base.items() if v is not ...}


def arrivals(spark, payloads, at="2026-08-20 10:30:22", partition=0):
    """Arrival rows of dicts or verbatim texts, in order."""
    rows = [(partition, i, p if isinstance(p, str) or p is None else json.dumps(p))
            for i, p in enumerate(payloads)]
    df = spark.createDataFrame(rows, "partition int, offset bigint, value string")
    return df.selectExpr("partition", "offset", f"timestamp'{at}' AS arrived_at", "value")
