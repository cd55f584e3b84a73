"""Tolerant decoding of JSON arrivals into the bronze layout.

The same functions serve batch tables and streams. Fields are decoded as text
and cast afterwards: a typed decode would turn a quoted number into NULL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidewarden import model
from tidewarden.functions.payload import encode, json_body, once
from tidewarden.functions.times import prefix_time

# Bronze reads these payload fields only; everything else in a payload is
# dropped here, so checks must start from the raw payload.
BRONZE_FIELDS = [f for f in model.EVENT_FIELDS
                 if f not in ("event_type", "quantity", "unit_price", "source")]


def decode(raw: DataFrame, fields: list[str] = BRONZE_FIELDS) -> DataFrame:
    """Adds ``event``: a struct of the fields as text.

    Missing fields and unparseable payloads give NULLs, never an error.
    """
    shape = ", ".join(f"`{f}` STRING" for f in fields)
    return raw.selectExpr("*", f"{once(f'from_json({json_body()}, {shape!r})')} AS event")


def money(text: Column) -> Column:
    """DECIMAL(18,2) by way of DOUBLE; junk and overflow give NULL."""
    return text.try_cast("double").try_cast(model.MONEY)


def to_bronze(raw: DataFrame, ingested: Column | None = None) -> DataFrame:
    """The fourteen bronze columns of all arrivals that carry an event id.

    ``ingested`` is the ingestion time; by default the clock of the batch.
    """
    e = decode(raw).where(F.col("event.event_id").isNotNull())
    clock = ingested if ingested is not None else F.localtimestamp()
    plain = {f: F.col(f"event.{f}") for f in BRONZE_FIELDS}
    plain["event_time"] = prefix_time(plain["event_time"]).cast("timestamp_ntz")
    plain["amount"] = money(plain["amount"])
    plain["ingestion_time"] = clock.cast("timestamp_ntz")
    return e.select(*[plain[f.name].alias(f.name) for f in model.BRONZE])


def enforce_required(df: DataFrame, required: list[str]) -> DataFrame:
    """Drops rows with a NULL in a required column."""
    return df.na.drop(subset=required) if required else df


def producer_frame(events: DataFrame, fields: list[str] = model.EVENT_FIELDS) -> DataFrame:
    """(key, value) for a keyed log: JSON with its nulls, keyed by customer.

    A NULL customer gets the key ``None``; only a frame without the column has
    no key at all.
    """
    key = (F.coalesce(F.col("customer_id").cast("string"), F.lit("None"))
           if "customer_id" in events.columns else F.lit(None).cast("string"))
    present = [f for f in fields if f in events.columns]
    return events.select(F.when(key != "", key).alias("key"),
                         encode(F.struct(*present)).alias("value"))
