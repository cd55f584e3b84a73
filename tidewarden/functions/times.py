"""Event-time parsing, formatting and delays."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from tidewarden.functions.payload import value_kind

ISO_MILLIS = "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"


def prefix_time(text: Column) -> Column:
    """TIMESTAMP from the first 19 characters; fraction and offset are dropped."""
    return F.try_to_timestamp(F.substring(text, 1, 19), F.lit("yyyy-MM-dd'T'HH:mm:ss"))


def iso_millis(ts: Column) -> Column:
    """ISO-8601 text in UTC with truncated milliseconds."""
    return F.date_format(ts, ISO_MILLIS)


def flexible_time(primary: Column, fallback: Column) -> Column:
    """Timestamp from a JSON value (variant) that may take several forms.

    A number is an epoch, in milliseconds above 1e11 and in seconds below it.
    Text is ISO-8601 with ``Z``, an offset or neither, which means UTC. A null,
    empty text or the number 0 counts as absent and the fallback is read.
    """
    def number(v: Column) -> Column:
        return F.when(value_kind(v).isin("integer", "float"), F.try_variant_get(v, "$", "double"))

    def text(v: Column) -> Column:
        return F.when(value_kind(v) == "string", F.try_variant_get(v, "$", "string"))

    def present(v: Column) -> Column:
        return F.coalesce(number(v) != 0, text(v) != "", F.lit(False))

    epoch = F.when(present(primary), number(primary)).otherwise(number(fallback))
    iso = F.when(present(primary), text(primary)).otherwise(text(fallback))
    seconds = F.when(epoch > 1e11, epoch / 1000.0).otherwise(epoch)
    zoned = F.when(iso.rlike(r"(Z|[+-]\d{2}:\d{2})$"), iso) \
        .when(iso.contains(":"), F.concat(iso, F.lit("Z"))) \
        .otherwise(F.concat(iso, F.lit("T00:00:00Z")))
    wellformed = iso.rlike(
        r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d{1,6})?)?(Z|[+-]\d{2}:\d{2})?)?$")
    return F.when(epoch.isNotNull() & (epoch != 0),
                  F.timestamp_micros(F.round(seconds * 1000000.0).cast("long"))) \
        .when(wellformed, F.try_to_timestamp(zoned))


def delay_ms(later: Column, earlier: Column) -> Column:
    """Milliseconds between two timestamps, with microsecond precision."""
    return (F.unix_micros(later) - F.unix_micros(earlier)) / 1000.0


def latency_ms(received: Column, event_time: Column) -> Column:
    """End-to-end latency; a clock that runs ahead gives 0, not a negative.

    NULL stays NULL (``greatest`` would skip it and give 0).
    """
    delay = delay_ms(received, event_time)
    return F.when(delay < 0, 0.0).otherwise(delay)
