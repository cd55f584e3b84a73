"""Replay of quarantined events: fix, check again, land what is new."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from tidewarden.operators.dedupe import ARRIVAL, keep_first, not_landed
from tidewarden.operators.quality import RuleOptions, check, silver_rows
from tidewarden.session import settled


def unquote_number(payload: Column, name: str) -> Column:
    """Turns ``"name":"12.5"`` into ``"name":12.5``."""
    return F.regexp_replace(payload, rf'"{name}"\s*:\s*"(-?[0-9]+(?:\.[0-9]+)?)"', f'"{name}":$1')


def rename_key(payload: Column, old: str, new: str) -> Column:
    return F.regexp_replace(payload, rf'"{old}"\s*:', f'"{new}":')


def drop_key(payload: Column, name: str) -> Column:
    """Removes a key with a text value that is not the first key."""
    return F.regexp_replace(payload, rf',\s*"{name}"\s*:\s*"[^"]*"', "")


def undo_schema_drift(payload: Column) -> Column:
    """The repairs for retyped numbers, a renamed key and an unknown key."""
    for name in ("quantity", "amount", "unit_price"):
        payload = unquote_number(payload, name)
    return drop_key(rename_key(payload, "client_id", "customer_id"), "customer_segment")


def recheck(quarantined: DataFrame, contract_rows: list[tuple], fix: Callable[[Column], Column],
            options: RuleOptions = RuleOptions()) -> DataFrame:
    """Repairs the payloads and applies the event's own rules again.

    Needs ``raw_payload``, ``arrived_at`` and a position (partition, offset).
    """
    again = quarantined.select("partition", "offset", "arrived_at", fix(F.col("raw_payload")).alias("value"))
    return check(again, contract_rows, options)


def replay(quarantined: DataFrame, landed: DataFrame, contract_rows: list[tuple],
           fix: Callable[[Column], Column] = undo_schema_drift, options: RuleOptions = RuleOptions(),
           order: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(events to land, events still rejected).

    Only ids that have not landed yet are landed, each once. Which ones is found on ids and positions, written down on the
    way; payloads are only filtered by position.
    """
    checked = recheck(quarantined, contract_rows, fix, options)
    good = checked.where(F.size("failures") == 0)
    place = ["partition", "offset"]
    ids = settled(good.select(*dict.fromkeys([*place, "event_id", *(order or ARRIVAL)])), "replay-ids")
    first = settled(not_landed(keep_first(ids, order=order), landed).select(*place), "replay-fresh")
    return good.join(first, place, "left_semi"), checked.where(F.size("failures") > 0)


def replayed_silver(fresh: DataFrame, processed_at: Column | None = None) -> DataFrame:
    return silver_rows(fresh, processed_at)
