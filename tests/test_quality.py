"""Rules, routes, and every injected fault against its reason."""

import json

import pytest
from conftest import arrivals, event
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from tidewarden import model
from tidewarden.functions.payload import is_json_object
from tidewarden.operators import compatibility, quality, replay
from tidewarden.operators.ingest import to_bronze
from tidewarden.sources.contracts import checkout_documents, document_rows

ROWS = document_rows(checkout_documents())

CASES = [
    (event(), []),
    (event(customer_id=None), ["NULL_REQUIRED_FIELD"]),
    (event(device=...), ["MISSING_REQUIRED_FIELD"]),
    (event(customer_segment="vip", source_version="v2"), ["UNEXPECTED_FIELD"]),
    (event(customer_id=..., client_id="CUS000001", source_version="v2"),
     ["MISSING_REQUIRED_FIELD", "UNEXPECTED_FIELD"]),
    (event(amount=-1499.0), ["INVALID_DOMAIN_BOUNDS", "AMOUNT_MISMATCH"]),
    (event(quantity=0, amount=0), ["INVALID_DOMAIN_BOUNDS"]),
    (event(amount="1499.0"), ["INVALID_DATA_TYPE"]),
    (event(quantity="2"), ["INVALID_DATA_TYPE"]),
    (event(quantity=2.5, unit_price=2, amount=5), ["INVALID_DATA_TYPE"]),
    (event(customer_id=123), ["INVALID_DATA_TYPE"]),
    (event(event_time="yesterday"), ["INVALID_DATA_TYPE"]),
    (event(unit_price=700, quantity=2, amount=1400), []),
    (event(amount=1500.0), ["AMOUNT_MISMATCH"]),
    (event(currency="ZZZ"), ["INVALID_CURRENCY"]),
    (event(currency="EUR"), []),
    (event(payment_status="REFUNDED"), ["INVALID_ENUM_VALUE"]),
    (event(payment_status="REFUNDED", source_version="v2"), []),
    (event(payment_method="BARTER"), ["INVALID_ENUM_VALUE"]),
    (event(coupon_code=None, source_version="v2"), []),
    (event(coupon_code=5, source_version="v2"), ["INVALID_DATA_TYPE"]),
    (event(amount="1499.0", source_version="v3"), []),
    (event(source_version="v9"), ["UNSUPPORTED_SCHEMA_VERSION"]),
    (event(source_version=...), ["UNSUPPORTED_SCHEMA_VERSION"]),
    (event(event_time="2026-08-20T10:35:23.000Z"), ["FUTURE_TIMESTAMP_ANOMALY"]),
    (event(event_time="2026-08-20T10:35:21.000Z"), []),
    ('{"event_id": "evt', ["MALFORMED_JSON"]),
    ("[1, 2]", ["MALFORMED_JSON"]),
    ("plain", ["MALFORMED_JSON"]),
    (None, ["MALFORMED_JSON"]),
]


def test_each_rule(spark):
    checked = quality.check(arrivals(spark, [c[0] for c in CASES]), ROWS)
    got = {r.offset: r.failures for r in checked.collect()}
    for i, (payload, want) in enumerate(CASES):
        assert got[i] == want, payload


def test_loose_mode_allows_extra_fields(spark):
    options = quality.RuleOptions(strict_fields=False)
    checked = quality.check(arrivals(spark, [event(other=1)]), ROWS, options)
    assert checked.first().failures == []


def test_quoted_contract_values(spark):
    rows = [("v'1", 0, "na'me", "string", True, ["it's", "a\\b"]), ("v'1", 1, "source_version", "string", True, None)]
    payloads = [{"na'me": "it's", "source_version": "v'1"}, {"na'me": "a\\b", "source_version": "v'1"},
                {"na'me": "x", "source_version": "v'1"}]
    got = [r.failures for r in quality.check(arrivals(spark, payloads), rows).orderBy("offset").collect()]
    assert got == [[], [], ["INVALID_ENUM_VALUE"]]


def assessed(spark):
    payloads = [event(1), event(2), event(1), event(3, event_time="2026-07-20T10:30:21.000Z"),
                event(4, amount=None), "torn", event(5)]
    return quality.assess(arrivals(spark, payloads), ROWS)


def test_duplicates_and_lateness(spark):
    got = {r.offset: r.failures for r in assessed(spark).collect()}
    assert got == {0: [], 1: [], 2: ["DUPLICATE_EVENT_ID"], 3: ["LATE_EVENT"], 4: ["NULL_REQUIRED_FIELD"],
                   5: ["MALFORMED_JSON"], 6: []}


def test_future_events_do_not_move_the_mark(spark):
    payloads = [event(1), event(2, event_time="2026-08-20T12:30:21.000Z"), event(3)]
    got = {r.offset: r.failures for r in quality.assess(arrivals(spark, payloads), ROWS).collect()}
    assert got == {0: [], 1: ["FUTURE_TIMESTAMP_ANOMALY"], 2: []}


def test_routes_partition_the_input(spark):
    a = assessed(spark)
    clock = F.lit("2026-08-20").cast("timestamp")
    silver, bad, dead = quality.silver_rows(a, clock), quality.quarantine_rows(a, detected_at=clock), quality.dead_letters(a)
    assert (silver.count(), bad.count(), dead.count()) == (3, 3, 1)
    assert {r.route: r.events for r in quality.route_counts(a).collect()} == {"valid": 3, "invalid": 3, "dlq": 1}
    assert silver.columns == model.SILVER.fieldNames() and len(silver.columns) == 19
    assert bad.columns == model.QUARANTINE.fieldNames()
    assert json.loads(bad.where("event_id = 'evt_4'").first().raw_payload)["amount"] is None


def test_audit_has_a_row_per_event_and_check(spark):
    audit = quality.audit_rows(assessed(spark), observed_at=F.lit("2026-08-20").cast("timestamp"))
    assert audit.count() == 7 * len(model.RULES)
    assert audit.select("check_id").distinct().count() == audit.count()
    assert audit.where("status = 'FAILED'").count() == 4
    assert audit.columns == model.AUDIT.fieldNames()


def test_score_and_reason(spark):
    a = quality.with_verdict(quality.check(arrivals(spark, [event(amount=-1499.0)]), ROWS)).first()
    assert a.failure_reason == "AMOUNT_MISMATCH;INVALID_DOMAIN_BOUNDS"
    assert a.failure_type == "INVALID_DOMAIN_BOUNDS" and abs(a.quality_score - 11 / 13) < 1e-12


def test_replay_lands_each_fixed_event_once(spark):
    payloads = [event(1, amount="1499.0"), event(1, amount="1499.0"), event(2, quantity="2"),
                event(3, customer_id=..., client_id="CUS000009", source_version="v2"),
                event(4, customer_segment="vip", source_version="v2"), event(5, currency="ZZZ"),
                event(6, amount="1499.0")]
    bad = arrivals(spark, payloads).withColumnRenamed("value", "raw_payload")
    landed = spark.createDataFrame([("evt_6",)], "event_id string")
    fresh, rejected = replay.replay(bad, landed, ROWS)
    assert sorted(r.event_id for r in fresh.collect()) == ["evt_1", "evt_2", "evt_3", "evt_4"]
    assert [r.event_id for r in rejected.collect()] == ["evt_5"]
    silver = replay.replayed_silver(fresh, F.lit("2026-08-21").cast("timestamp"))
    assert {r.customer_id for r in silver.collect()} == {"CUS000001", "CUS000009"}


json_values = st.one_of(st.none(), st.booleans(), st.integers(-5, 5), st.sampled_from(["", "x", "INR", "UPI", "v1", "v2"]),
                        st.floats(-10, 10, allow_nan=False).map(lambda x: round(x, 2)), st.just([1]), st.just({"a": 1}))


def plain_reading(payload):
    """Failed rules of a payload, read off the contract in plain Python."""
    doc = checkout_documents().get(payload.get("source_version") if isinstance(payload.get("source_version"), str) else None)
    if doc is None:
        return None
    fields = doc["fields"]
    out = set()
    if any(s["required"] and f not in payload for f, s in fields.items()):
        out.add("MISSING_REQUIRED_FIELD")
    if any(s["required"] and f in payload and payload[f] is None for f, s in fields.items()):
        out.add("NULL_REQUIRED_FIELD")
    if set(payload) - set(fields):
        out.add("UNEXPECTED_FIELD")
    for f, s in fields.items():
        v = payload.get(f)
        if v is None:
            continue
        number = isinstance(v, (int, float)) and not isinstance(v, bool)
        fits = {"string": isinstance(v, str), "timestamp": v == "2026-08-20T10:30:21.123Z",
                "integer": number and float(v).is_integer(), "float": number}[s["type"]]
        if not fits:
            out.add("INVALID_DATA_TYPE")
        if isinstance(v, str) and v not in s.get("enum", [v]):
            out.add("INVALID_ENUM_VALUE")
    return out


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.dictionaries(st.sampled_from(model.EVENT_FIELDS + ["coupon_code", "other"]),
                                st.one_of(json_values, st.just(...)), max_size=4), min_size=40, max_size=80))
def test_contract_rules_match_a_plain_reading(spark, changes):
    payloads = [event(i, **{"source_version": "v2", **c}) for i, c in enumerate(changes)]
    got = {r.offset: r.failures for r in quality.check(arrivals(spark, payloads), ROWS).collect()}
    contractual = {"MISSING_REQUIRED_FIELD", "NULL_REQUIRED_FIELD", "UNEXPECTED_FIELD", "INVALID_DATA_TYPE",
                   "INVALID_ENUM_VALUE"}
    for i, p in enumerate(payloads):
        want = plain_reading(p)
        if want is None:
            assert "UNSUPPORTED_SCHEMA_VERSION" in got[i]
        else:
            assert set(got[i]) & contractual == want, p


def test_registries_have_no_size_limit():
    many = quality.Contracts(tuple(("v1", i, f"f{i}", "string", True, None) for i in range(6000)))
    assert "_v6000" in many.missing()


BROKEN = ['{} x', '{}{}', '{"a":1},{"b":2}', '{"a":1},2],{}', '{"a":NaN}', '[1]', '1', '', ' ', 'null', None]


def test_only_a_single_object_is_valid(spark):
    """What follows the object is not ignored, by the rules, bronze and the observed fields alike."""
    whole = json.dumps(event(1))
    payloads = [whole, f" {whole}\n", whole + " x", whole + whole, whole + "," + whole, *BROKEN]
    raw = arrivals(spark, payloads)
    failures = {r.offset: r.failures for r in quality.assess(raw, ROWS).collect()}
    assert failures[0] == [] and failures[1] == ["DUPLICATE_EVENT_ID"]
    assert all(failures[i] == ["MALFORMED_JSON"] for i in range(2, len(payloads)))
    assert to_bronze(raw).count() == 2
    assert compatibility.payload_entries(raw, [F.col("offset").alias("o")]).select("o").distinct().count() == 2


def test_values_must_survive_the_silver_casts(spark):
    whole = json.dumps(event(1))
    odd = [whole.replace('"amount": 1499.0', '"amount": 1e400'), whole.replace('"amount": 1499.0', '"amount": 12345678901234567890'),
           whole.replace('"quantity": 2', '"quantity": 5000000000'), whole.replace('"unit_price": 749.5', '"unit_price": 1e999')]
    assert all(o != whole for o in odd)
    for r in quality.check(arrivals(spark, odd), ROWS).collect():
        assert "INVALID_DATA_TYPE" in r.failures


def test_a_repeated_key_is_one_field(spark):
    rows = compatibility.payload_entries(arrivals(spark, ['{"a":1,"b":"x","a":"y"}']), [], whole=True).collect()
    assert sorted((r.key or "", r.kind or "") for r in rows) == [("", ""), ("a", "string"), ("b", "string")]


def test_enums_have_no_size_limit(spark):
    payloads = [event(i, payment_method=f"M{i % 1001:04d}") for i in range(1001)]
    got = compatibility.observed_contracts(arrivals(spark, payloads), F.lit("p"), ["payment_method"]).collect()
    by_field = {r.field: r for r in got}
    assert len(by_field["payment_method"]["enum"]) == 1001 and by_field["device"]["enum"] is None
    assert all(r.required for r in got)


def _scans(df):
    return str(df._jdf.queryExecution().executedPlan().toString()).count("FileScan")


def test_payloads_are_read_and_parsed_once(spark):
    """The plan of all rules reads the log once and the flagged positions once; replay reads two more narrow or filtered tables."""
    from conftest import SF

    from tidewarden.plans import queries as Q
    df = Q.event_failures(spark, SF)
    assert _scans(df) <= 2
    assert str(df._jdf.queryExecution().optimizedPlan().toString()).count("from_json") <= 2
    assert _scans(Q.replayed_events(spark, SF)) <= 4


def test_texts_without_padding_are_not_trimmed(spark):
    """Trimming costs a scan of the text; what two conditions share Spark computes for every row, so it stands in a branch."""
    condition = is_json_object("value")
    assert "trim(" in condition
    assert all(before.endswith("ELSE ") for before in condition.split("trim(")[:-1])
    texts = ['{"a":1}', ' {"a":1}\n', '\t{"a":1}', '{"a":1} ', '', ' ', '{', '}', ' {"a":1} x', 'x {"a":1}', '{"a":1}{"b":2}', None]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, value string")
    kept = rows.where(condition).orderBy("i").collect()
    assert [r.i for r in kept] == [0, 1, 2, 3]
