"""Contract and quality rules on raw payloads, routing and audit rows.

A payload is read as a struct of variants, which keeps a null, a missing key
and a value of the wrong type apart, as a struct of texts, which is cheaper than
casting each variant, and as a key list, which shows what the contract does not
know. Each is one pass, and Spark drops the passes a query does not need. The contracts of all versions become
plain boolean conditions of the plan (a registry holds a few dozen versions),
so checking an event against the contract of its own version needs no join and
no loop over fields: everything compiles into one projection.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from tidewarden import model
from tidewarden.functions.payload import json_body, once
from tidewarden.functions.times import prefix_time
from tidewarden.operators.dedupe import flag_duplicates
from tidewarden.operators.ingest import money
from tidewarden.operators.ordered import BLOCK, running_max_before
from tidewarden.session import settled

# Variant type names each contract type accepts, as a condition on {s}.
# A number without a fraction is an integer; an integer is a valid float.
ACCEPTS = {
    "string": "{s} = 'STRING'",
    "timestamp": "{s} = 'STRING' AND {t} IS NOT NULL",
    "integer": "({s} = 'BIGINT' OR endswith({s}, ',0)'))",
    "float": "({s} IN ('BIGINT', 'DOUBLE', 'FLOAT') OR startswith({s}, 'DECIMAL'))",
    "boolean": "{s} = 'BOOLEAN'",
    "object": "startswith({s}, 'OBJECT')",
    "array": "startswith({s}, 'ARRAY')",
}
TIME = "try_to_timestamp(substring({x}, 1, 19), \"yyyy-MM-dd'T'HH:mm:ss\")"
# What a value must survive to land in silver; the text of an infinite number survives none.
SILVER_CASTS = {"amount": "try_cast(try_cast({t} AS double) AS decimal(18,2))", "quantity": "try_cast(try_cast({t} AS double) AS int)",
                "unit_price": "try_cast({t} AS double)"}


@dataclass(frozen=True)
class RuleOptions:
    """Limits the rules use where the contract is silent."""

    currencies: tuple[str, ...] = tuple(model.CURRENCIES)
    positive: tuple[str, ...] = ("amount", "unit_price", "quantity")
    max_skew: str = "5 minutes"
    lateness: str = "5 seconds"
    amount_tolerance: float = 0.001
    strict_fields: bool = True
    dedupe_order: tuple[str, ...] = ("arrived_at", "partition", "offset")
    block: int = BLOCK


def _text(value: str) -> str:
    """SQL string literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _any(conditions: list[str]) -> str:
    return "(" + " OR ".join(conditions) + ")" if conditions else "false"


@dataclass(frozen=True)
class Contracts:
    """The registry as conditions. ``rows`` are contract-table rows (version,
    position, field, type, required, enum): metadata, of bounded number."""

    rows: tuple[tuple, ...]

    @property
    def versions(self) -> list[str]:
        return list(dict.fromkeys(r[0] for r in self.rows))

    @property
    def fields(self) -> list[str]:
        """All fields of all versions, and those the rules read anyway."""
        return list(dict.fromkeys([*model.EVENT_FIELDS, *(r[2] for r in self.rows)]))

    def slot(self, name: str) -> int:
        return self.fields.index(name)

    def among(self, versions: list[str]) -> str:
        if set(versions) == set(self.versions):
            return "_known"
        return f"coalesce(schema_version IN ({', '.join(map(_text, versions))}), false)"

    def grouped(self, key) -> dict:
        """Versions by what ``key`` gives for their rows; None is left out."""
        out: dict = {}
        for r in self.rows:
            k = key(r)
            if k is not None:
                out.setdefault(k, []).append(r[0])
        return out

    def missing(self) -> str:
        return _any([f"({self.among(vs)} AND _v{self.slot(f)} IS NULL)"
                     for f, vs in self.grouped(lambda r: r[2] if r[4] else None).items()])

    def nulls(self) -> str:
        return _any([f"({self.among(vs)} AND is_variant_null(_v{self.slot(f)}))"
                     for f, vs in self.grouped(lambda r: r[2] if r[4] else None).items()])

    def mistyped(self) -> str:
        out = []
        for (f, kind), vs in self.grouped(lambda r: (r[2], r[3])).items():
            i = self.slot(f)
            fits = ACCEPTS[kind].format(s=f"_s{i}", t=TIME.format(x=f"_t{i}"))
            out.append(f"({self.among(vs)} AND _s{i} <> 'VOID' AND NOT ({fits}))")
        for f, cast in SILVER_CASTS.items():
            i = self.slot(f)
            out.append(f"(_known AND _s{i} <> 'VOID' AND {cast.format(t=f'_t{i}')} IS NULL)")
        return _any(out)

    def outside_enum(self) -> str:
        return _any([f"({self.among(vs)} AND _s{self.slot(f)} = 'STRING' AND "
                     f"_t{self.slot(f)} NOT IN ({', '.join(map(_text, allowed))}))"
                     for (f, allowed), vs in self.grouped(
                         lambda r: (r[2], tuple(r[5])) if r[5] else None).items()])

    def unexpected(self) -> str:
        known: dict = {}
        for v in self.versions:
            known.setdefault(tuple(r[2] for r in self.rows if r[0] == v), []).append(v)
        return _any([f"({self.among(vs)} AND size(array_except(_keys, "
                     f"array({', '.join(map(_text, fields))}))) > 0)" for fields, vs in known.items()])


def parse(raw: DataFrame, contracts: Contracts) -> DataFrame:
    """Adds the payload's keys ``_keys`` (NULL unless it is a JSON object); per
    field i the variant ``_v{i}``, its type name ``_s{i}`` and its text
    ``_t{i}``; and ``schema_version`` with whether it is ``_known``."""
    names = contracts.fields
    quoted = ["`" + f.replace("`", "``") + "`" for f in names]
    typed, plain = (_text(", ".join(f"{f} {kind}" for f in quoted)) for kind in ("VARIANT", "STRING"))
    keep = [f"`{c}`" for c in raw.columns]
    out = raw.selectExpr(*keep, f"{json_body()} AS _body").selectExpr(
        *keep, f"from_json(_body, {typed}) AS _j", f"from_json(_body, {plain}) AS _x", "json_object_keys(_body) AS _keys")
    out = out.selectExpr(*keep, "_keys", *[f"_j.{f} AS _v{i}" for i, f in enumerate(quoted)],
                         *[f"schema_of_variant(_j.{f}) AS _s{i}" for i, f in enumerate(quoted)],
                         *[f"_x.{f} AS _t{i}" for i, f in enumerate(quoted)])
    version = f"_t{contracts.slot('source_version')}"
    known = ", ".join(map(_text, contracts.versions))
    return out.selectExpr("*", f"{version} AS schema_version", f"coalesce({version} IN ({known}), false) AS _known")


def stateless_rules(contracts: Contracts, options: RuleOptions) -> dict[str, str]:
    """Failure condition, as SQL, of each rule that needs only the event."""
    slot = contracts.slot

    def number(name: str) -> str:
        return f"try_cast(_t{slot(name)} AS double)"

    amount, price, quantity = number("amount"), number("unit_price"), number("quantity")
    event_ts = TIME.format(x=f"_t{slot('event_time')}")
    currency = slot("currency")
    rules = {
        "MALFORMED_JSON": "_keys IS NULL",
        "UNSUPPORTED_SCHEMA_VERSION": "_keys IS NOT NULL AND NOT _known",
        "MISSING_REQUIRED_FIELD": contracts.missing(),
        "NULL_REQUIRED_FIELD": contracts.nulls(),
        "INVALID_DATA_TYPE": contracts.mistyped(),
        "INVALID_DOMAIN_BOUNDS": _any([f"{number(f)} <= 0" for f in options.positive]),
        "AMOUNT_MISMATCH": f"abs({amount} - round({quantity} * {price}, 2)) >= {options.amount_tolerance}D",
        "INVALID_CURRENCY": f"_s{currency} = 'STRING' AND _t{currency} NOT IN "
                            f"({', '.join(map(_text, options.currencies))})",
        "INVALID_ENUM_VALUE": contracts.outside_enum(),
        "FUTURE_TIMESTAMP_ANOMALY": f"{event_ts} > arrived_at + interval {options.max_skew}",
    }
    if options.strict_fields:
        rules["UNEXPECTED_FIELD"] = contracts.unexpected()
    return rules


def check(raw: DataFrame, contract_rows: list[tuple], options: RuleOptions = RuleOptions()) -> DataFrame:
    """Stateless rules only: arrivals + event fields + ``failures``.

    ``failures`` is the list of failed rule codes by falling priority. This is
    one projection, without a shuffle, for tables and streams alike. A payload
    field whose name the arrival record uses already gets the prefix ``event_``.
    """
    contracts = Contracts(tuple(contract_rows))
    rules = stateless_rules(contracts, options)
    failed = ", ".join(f"CASE WHEN {rules[c]} THEN '{c}' END" for c in model.RULES if c in rules)
    fields = [f"_t{contracts.slot(n)} AS {n if n not in raw.columns else 'event_' + n}"
              for n in model.EVENT_FIELDS]
    return parse(raw, contracts).selectExpr(
        *[f"`{c}`" for c in raw.columns], *fields, "schema_version",
        f"{TIME.format(x='_t' + str(contracts.slot('event_time')))} AS event_ts",
        f"{once(f'array_compact(array({failed}))')} AS failures")


def positions(raw: DataFrame, options: RuleOptions = RuleOptions()) -> DataFrame:
    """The log without its payloads: position, arrival, event id and time, and
    ``credible``: the event time, unless it lies too far in the future."""
    e = F.from_json(F.expr(json_body()), "event_id STRING, event_time STRING")
    ts = prefix_time(F.col("_e.event_time"))
    limit = F.col("arrived_at") + F.expr(f"interval {options.max_skew}")
    # Flags find their rows by position, so rows without one are refused.
    place = F.coalesce("offset", F.raise_error(F.lit("an arrival has no log position")).cast("long")).alias("offset")
    return raw.select("partition", place, "arrived_at", e.alias("_e")).select(
        "partition", "offset", "arrived_at", F.col("_e.event_id").alias("event_id"), ts.alias("event_ts"),
        F.when(ts <= limit, ts).alias("credible"))


def with_marks(narrow: DataFrame, options: RuleOptions = RuleOptions()) -> DataFrame:
    """Adds ``mark``: the newest credible event time earlier in the log partition."""
    return running_max_before(narrow, ["partition"], "offset", F.col("credible"), "mark", options.block)


def is_late(mark: Column, options: RuleOptions = RuleOptions()) -> Column:
    """Whether an event lies more than the allowed lateness behind the mark."""
    return F.coalesce(F.col("event_ts") < mark - F.expr(f"interval {options.lateness}"), F.lit(False))


def context_failures(raw: DataFrame, options: RuleOptions) -> DataFrame:
    """(partition, offset, is_late, is_duplicate) of the rows that have either.

    The log's payloads are read once, for a narrow table of positions that is written down; all else reads that table.
    """
    narrow = settled(positions(raw, options), "positions")
    late = (with_marks(narrow, options).where(is_late(F.col("mark"), options))
            .select("partition", "offset", F.lit(True).alias("is_late"), F.lit(False).alias("is_duplicate")))
    again = (flag_duplicates(narrow, "event_id", list(options.dedupe_order)).where("is_duplicate")
             .select("partition", "offset", F.lit(False).alias("is_late"), "is_duplicate"))
    return late.unionByName(again).groupBy("partition", "offset").agg(
        F.max("is_late").alias("is_late"), F.max("is_duplicate").alias("is_duplicate"))


def assess(raw: DataFrame, contract_rows: list[tuple], options: RuleOptions = RuleOptions()) -> DataFrame:
    """All rules: :func:`check` plus lateness and duplicates.

    The flagged positions, written down as well, join back on (partition, offset), a unique key. The plan that is returned
    reads the payloads once, and parses them once; while the flagged rows are few, Spark sends them to the payloads.
    """
    flags = settled(context_failures(raw, options), "flags")
    checked = check(raw, contract_rows, options)
    joined = checked.join(flags, ["partition", "offset"], "left")
    extra = F.array_compact(F.array(F.when(F.col("is_late"), F.lit("LATE_EVENT")),
                                    F.when(F.col("is_duplicate"), F.lit("DUPLICATE_EVENT_ID"))))
    return joined.withColumn("failures", F.concat("failures", extra)).drop("is_late", "is_duplicate")


def route() -> Column:
    """valid, invalid or dlq."""
    return (F.when(F.size("failures") == 0, "valid")
            .when(F.array_contains("failures", model.DEAD_LETTER_RULE), "dlq").otherwise("invalid"))


def failure_reason() -> Column:
    return F.array_join(F.array_sort("failures"), ";")


def failure_type() -> Column:
    return F.try_element_at(F.col("failures"), F.lit(1))


def quality_score() -> Column:
    """Share of the rules an event passes."""
    return 1 - F.size("failures") / F.lit(float(len(model.RULES)))


def with_verdict(assessed: DataFrame) -> DataFrame:
    return (assessed.withColumn("route", route()).withColumn("failure_reason", failure_reason())
            .withColumn("failure_type", failure_type()).withColumn("quality_score", quality_score()))


def silver_rows(assessed: DataFrame, processed_at: Column | None = None) -> DataFrame:
    """Valid events in the silver layout."""
    now = processed_at if processed_at is not None else F.localtimestamp()
    own = {name: F.col(f"event_{name}" if f"event_{name}" in assessed.columns and name == "source" else name)
           for name in model.EVENT_FIELDS}
    own["event_time"] = F.col("event_ts").cast("timestamp_ntz")
    own["quantity"] = F.col("quantity").try_cast("double").try_cast("int")
    own["unit_price"] = F.col("unit_price").try_cast("double")
    own["amount"] = money(F.col("amount"))
    own["processed_at"] = now.cast("timestamp_ntz")
    own["quality_score"] = quality_score()
    return assessed.where(F.size("failures") == 0).select(
        *[own[f.name].alias(f.name) for f in model.SILVER])


def quarantine_rows(assessed: DataFrame, stage: str = "validation",
                    detected_at: Column | None = None) -> DataFrame:
    """Rejected events with their verbatim payload, in the quarantine layout."""
    now = detected_at if detected_at is not None else F.localtimestamp()
    return assessed.where(route() == "invalid").select(
        "event_id", "event_time", F.col("value").alias("raw_payload"),
        failure_reason().alias("failure_reason"), failure_type().alias("failure_type"),
        "schema_version", now.cast("timestamp_ntz").alias("detected_at"),
        F.lit(stage).alias("pipeline_stage"))


def dead_letters(assessed: DataFrame) -> DataFrame:
    """Payloads that are not JSON objects, with their log position."""
    return assessed.where(route() == "dlq").select("partition", "offset", "arrived_at", "value")


def audit_rows(assessed: DataFrame, stage: str = "validation",
               observed_at: Column | None = None) -> DataFrame:
    """One row per event and check, passed or failed."""
    now = observed_at if observed_at is not None else F.localtimestamp()
    severities = F.create_map(*[F.lit(x) for pair in model.RULES.items() for x in pair])
    rows = assessed.select("partition", "offset", "event_id", "failures", now.alias("_now"),
                           F.explode(F.array(*[F.lit(c) for c in model.RULES])).alias("check_name"))
    failed = F.array_contains("failures", F.col("check_name"))
    return rows.select(
        F.md5(F.concat_ws("|", "partition", "offset", "check_name")).alias("check_id"), "event_id",
        "check_name", F.when(failed, "FAILED").otherwise("PASSED").alias("status"),
        F.when(failed, severities[F.col("check_name")]).otherwise("INFO").alias("severity"),
        F.when(failed, F.col("check_name")).alias("failure_reason"),
        F.col("_now").cast("timestamp_ntz").alias("observed_at"), F.lit(stage).alias("pipeline_stage"))


def route_counts(assessed: DataFrame, stage: str = "validation") -> DataFrame:
    """Lineage: rows per stage and route."""
    return assessed.groupBy(F.lit(stage).alias("pipeline_stage"), route().alias("route")) \
        .agg(F.count(F.lit(1)).alias("events"))
