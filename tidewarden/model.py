"""Table layouts, field lists and codes of the checkout data model."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T

# --- fixed values: names and numbers the results must carry unchanged -------
EVENT_FIELDS = [
    "event_id", "event_time", "event_type", "customer_id", "session_id", "order_id",
    "product_id", "quantity", "unit_price", "amount", "currency", "payment_method",
    "payment_status", "device", "country", "source", "source_version",
]
PAYMENT_METHODS = ["UPI", "CREDIT_CARD", "DEBIT_CARD", "NET_BANKING", "WALLET", "COD"]
PAYMENT_STATUSES = ["SUCCESS", "FAILED", "PENDING"]
CURRENCIES = ["INR", "USD", "EUR", "GBP", "JPY"]
FAULT_MODES = ["NULL", "DUPLICATE", "NEGATIVE", "INVALID_ENUM", "SCHEMA_DRIFT",
               "TYPE_CHANGE", "TIMESTAMP_DRIFT"]
DRIFT_TYPES = ["ADD_FIELD", "REMOVE_FIELD", "RENAME_FIELD"]
LEGACY_ERRORS = ["null_amount", "null_customer_id", "negative_amount", "duplicate_event_id",
                 "invalid_currency", "missing_required_field", "wrong_data_type",
                 "future_timestamp"]
CONTRACT_TYPES = ["array", "boolean", "float", "integer", "object", "string", "timestamp"]
NAMESPACES = ["bronze", "silver", "quarantine", "audit"]
TOPICS = {
    "raw": ("checkout-events", 3, 7),
    "valid": ("checkout-valid", 3, 7),
    "invalid": ("checkout-invalid", 3, 14),
    "dlq": ("checkout-dlq", 3, 30),
    "control": ("pipeline-control", 1, 7),
    "schema": ("schema-events", 1, 30),
}
# ----------------------------------------------------------------------------

# Rule codes by falling priority: the first failed one names the failure type.
RULES = {
    "MALFORMED_JSON": "CRITICAL",
    "UNSUPPORTED_SCHEMA_VERSION": "CRITICAL",
    "MISSING_REQUIRED_FIELD": "BREAKING",
    "NULL_REQUIRED_FIELD": "BREAKING",
    "INVALID_DATA_TYPE": "BREAKING",
    "UNEXPECTED_FIELD": "WARNING",
    "INVALID_DOMAIN_BOUNDS": "BREAKING",
    "AMOUNT_MISMATCH": "WARNING",
    "INVALID_CURRENCY": "BREAKING",
    "INVALID_ENUM_VALUE": "BREAKING",
    "FUTURE_TIMESTAMP_ANOMALY": "WARNING",
    "LATE_EVENT": "WARNING",
    "DUPLICATE_EVENT_ID": "WARNING",
}
DEAD_LETTER_RULE = "MALFORMED_JSON"

MONEY = T.DecimalType(18, 2)


_TYPES = {"STRING": T.StringType(), "INT": T.IntegerType(), "BIGINT": T.LongType(),
          "DOUBLE": T.DoubleType(), "BOOLEAN": T.BooleanType(), "TIMESTAMP": T.TimestampType(),
          "TIMESTAMP_NTZ": T.TimestampNTZType(), "DECIMAL(18,2)": MONEY,
          "DECIMAL(28,2)": T.DecimalType(28, 2), "ARRAY<STRING>": T.ArrayType(T.StringType())}


def layout(spec: str) -> T.StructType:
    """StructType of ``name TYPE [NOT NULL], ...``; works without a session."""
    fields = []
    for part in spec.split(", "):
        name, kind, *rest = part.split(" ")
        fields.append(T.StructField(name, _TYPES[kind], not rest))
    return T.StructType(fields)


BRONZE = layout(
    "event_id STRING, event_time TIMESTAMP_NTZ, customer_id STRING, session_id STRING, "
    "order_id STRING, product_id STRING, amount DECIMAL(18,2), currency STRING, "
    "payment_method STRING, payment_status STRING, device STRING, country STRING, "
    "source_version STRING, ingestion_time TIMESTAMP_NTZ")

# Silver keeps the declared names; event_time and amount use the bronze types
# instead of the declared text and double, so no precision is lost on the way.
SILVER = layout(
    "event_id STRING NOT NULL, event_time TIMESTAMP_NTZ NOT NULL, event_type STRING, "
    "customer_id STRING, session_id STRING, order_id STRING, product_id STRING, quantity INT, "
    "unit_price DOUBLE, amount DECIMAL(18,2), currency STRING, payment_method STRING, "
    "payment_status STRING, device STRING, country STRING, source STRING, "
    "source_version STRING, processed_at TIMESTAMP_NTZ, quality_score DOUBLE")

QUARANTINE = layout(
    "event_id STRING, event_time STRING, raw_payload STRING NOT NULL, "
    "failure_reason STRING NOT NULL, failure_type STRING, schema_version STRING, "
    "detected_at TIMESTAMP_NTZ, pipeline_stage STRING")

AUDIT = layout(
    "check_id STRING NOT NULL, event_id STRING, check_name STRING NOT NULL, "
    "status STRING NOT NULL, severity STRING, failure_reason STRING, "
    "observed_at TIMESTAMP_NTZ NOT NULL, pipeline_stage STRING")

INCIDENTS = layout(
    "incident_id STRING NOT NULL, source STRING, from_state STRING, to_state STRING, "
    "opened_at TIMESTAMP_NTZ, error_rate DOUBLE, total BIGINT, bad BIGINT")

ALERTS = layout(
    "alert_id STRING NOT NULL, incident_id STRING, source STRING, raised_at TIMESTAMP_NTZ, "
    "severity STRING, message STRING")

CONTROL = layout("source STRING, signal STRING, issued_at TIMESTAMP_NTZ, reason STRING")

SCHEMA_EVENTS = layout(
    "old_version STRING, new_version STRING, change_type STRING, field STRING, "
    "classification STRING, description STRING, published_at TIMESTAMP_NTZ")

GOLD = layout(
    "hour TIMESTAMP_NTZ, product_id STRING, payment_status STRING, events BIGINT, "
    "customers BIGINT, revenue DECIMAL(28,2), avg_amount DOUBLE")


@dataclass(frozen=True)
class TableSpec:
    """A catalog table: where it lives, its columns and how it is split."""

    namespace: str
    name: str
    schema: T.StructType
    partition_by: tuple[str, ...] = ()
    properties: dict[str, str] = field(default_factory=dict)

    @property
    def identifier(self) -> str:
        return f"{self.namespace}.{self.name}"


TABLES = [
    TableSpec("bronze", "checkout_events", BRONZE),
    TableSpec("silver", "valid_checkout_events", SILVER),
    TableSpec("quarantine", "invalid_checkout_events", QUARANTINE),
    TableSpec("audit", "data_quality_results", AUDIT),
]
# Tables named in the design without a layout; the columns are this project's.
OPERATIONS_TABLES = [
    TableSpec("audit", "incidents", INCIDENTS),
    TableSpec("audit", "alerts", ALERTS),
    TableSpec("audit", "pipeline_control", CONTROL),
    TableSpec("audit", "schema_events", SCHEMA_EVENTS),
]

# Arrival record: what a log source hands to the engine.
ARRIVAL = layout("partition INT, offset BIGINT, arrived_at TIMESTAMP, value STRING")
