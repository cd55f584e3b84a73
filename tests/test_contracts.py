"""Contract linting, registry, compatibility and drift."""

import json

import pytest
from conftest import arrivals, event
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F, types as T

from tidewarden import model
from tidewarden.operators import compatibility as compat
from tidewarden.sources import contracts as registry


def table(spark, documents):
    return spark.createDataFrame(registry.document_rows(documents), registry.CONTRACT)


def pair(spark, old, new):
    return spark.createDataFrame([(old, new)], "old_version string, new_version string")


def changed(**edits):
    doc = json.loads(json.dumps(registry.checkout_documents()["v1"]))
    for name, spec in edits.items():
        if spec is None:
            del doc["fields"][name]
        else:
            doc["fields"][name] = spec
    return doc


def diff(spark, old, new):
    pairs = pair(spark, "old", "new")
    changes = compat.compare(table(spark, {"old": old, "new": new}), pairs)
    return changes.orderBy("seq").collect(), compat.verdicts(pairs, changes).first()


def test_published_versions(spark):
    c = registry.checkout_contracts(spark)
    assert {r.schema_version: r["count"] for r in c.groupBy("schema_version").count().collect()} == \
        {"v1": 17, "v2": 19, "v3": 19}
    pairs = compat.consecutive_pairs(c)
    changes = compat.compare(c, pairs)
    v = {r.new_version: r for r in compat.verdicts(pairs, changes).collect()}
    assert (v["v2"].classification, v["v2"].changes, v["v2"].breaking) == ("COMPATIBLE", 3, 0)
    assert v["v2"].summary == "Schema evolution from v1 to v2 is COMPATIBLE (3 change(s) detected)."
    assert (v["v3"].classification, v["v3"].changes, v["v3"].breaking) == ("BREAKING", 1, 1)
    assert v["v3"].summary == \
        "Schema evolution from v2 to v3 is BREAKING (1 breaking change(s) detected out of 1 total)."
    rows = changes.where("new_version = 'v2'").orderBy("seq").collect()
    assert {(r.change_type, r.field) for r in rows} == {
        ("FIELD_ADDED", "device_model"), ("FIELD_ADDED", "coupon_code"), ("ENUM_VALUE_ADDED", "payment_status")}
    assert rows[-1].description.endswith("expanded with new value(s): REFUNDED")
    gate = compat.breaking_events(changes).collect()
    assert [(r.new_version, r.field) for r in gate] == [("v3", "amount")]


def test_identical(spark):
    rows, v = diff(spark, changed(), changed())
    assert rows == [] and v.summary == "Schema old and new are identical."


@pytest.mark.parametrize("edit,kind,verdict", [
    ({"tax_id": {"type": "string", "required": True}}, "FIELD_ADDED", "BREAKING"),
    ({"tax_id": {"type": "string", "required": False}}, "FIELD_ADDED", "COMPATIBLE"),
    ({"customer_id": None}, "FIELD_REMOVED", "BREAKING"),
    ({"quantity": {"type": "float"}}, "FIELD_TYPE_CHANGED", "COMPATIBLE"),
    ({"amount": {"type": "integer"}}, "FIELD_TYPE_CHANGED", "BREAKING"),
    ({"device": {"type": "string", "required": False}}, "FIELD_REQUIRED_CHANGED", "COMPATIBLE"),
    ({"payment_status": {"type": "string", "enum": ["FAILED", "PENDING"]}}, "ENUM_VALUE_REMOVED", "BREAKING"),
    ({"device": {"type": "string", "enum": ["mobile"]}}, "ENUM_VALUE_ADDED", "COMPATIBLE"),
    ({"payment_status": {"type": "string"}}, "ENUM_VALUE_REMOVED", "BREAKING"),
])
def test_single_changes(spark, edit, kind, verdict):
    rows, v = diff(spark, changed(), changed(**edit))
    assert [r.change_type for r in rows] == [kind] and v.classification == verdict
    assert rows[0].severity == ("BREAKING" if verdict == "BREAKING" else "INFO")


def test_tightening_is_breaking(spark):
    rows, v = diff(spark, changed(device={"type": "string", "required": False}), changed())
    assert v.classification == "BREAKING" and rows[0].new_value == "true"
    assert rows[0].description == "Field 'device' changed from optional to required"


def plain_verdict(old, new):
    out = []
    for f in old:
        if f not in new:
            out.append(("FIELD_REMOVED", f, True))
    for f in new:
        if f not in old:
            out.append(("FIELD_ADDED", f, new[f]["required"]))
    for f in old:
        if f in new:
            a, b = old[f], new[f]
            if a["type"] != b["type"]:
                out.append(("FIELD_TYPE_CHANGED", f, (a["type"], b["type"]) != ("integer", "float")))
            if a["required"] != b["required"]:
                out.append(("FIELD_REQUIRED_CHANGED", f, b["required"]))
            ea, eb = set(a.get("enum") or []), set(b.get("enum") or [])
            if eb - ea:
                out.append(("ENUM_VALUE_ADDED", f, False))
            if ea - eb:
                out.append(("ENUM_VALUE_REMOVED", f, True))
    return sorted(out)


spec = st.fixed_dictionaries({"type": st.sampled_from(model.CONTRACT_TYPES), "required": st.booleans(),
                              "enum": st.one_of(st.none(), st.lists(st.sampled_from("ABC"), min_size=1, unique=True))})
fields = st.dictionaries(st.sampled_from("pqrstu"), spec, min_size=1)


@settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(fields, fields), min_size=10, max_size=20))
def test_many_pairs_at_once(spark, cases):
    docs, pairs = {}, []
    for i, (a, b) in enumerate(cases):
        docs[f"o{i}"], docs[f"n{i}"] = {"fields": a}, {"fields": b}
        pairs.append((f"o{i}", f"n{i}"))
    changes = compat.compare(table(spark, docs), spark.createDataFrame(pairs, "old_version string, new_version string"))
    got = {}
    for r in changes.collect():
        got.setdefault(r.old_version, []).append((r.change_type, r.field, r.classification == "BREAKING"))
    for i, (a, b) in enumerate(cases):
        assert sorted(got.get(f"o{i}", [])) == plain_verdict(a, b)


LINT = {
    "good": ('{"schema_version":"a","fields":{"x":{"type":"string"}}}', []),
    "empty fields": ('{"schema_version":"a","fields":{}}', []),
    "cut": ('{"schema_version":', [(None, "INVALID_JSON")]),
    "list": ("[]", [(None, "NOT_AN_OBJECT")]),
    "no version": ('{"fields":{}}', [(None, "BAD_SCHEMA_VERSION")]),
    "number version": ('{"schema_version":1,"fields":{}}', [(None, "BAD_SCHEMA_VERSION")]),
    "no fields": ('{"schema_version":"a"}', [(None, "BAD_FIELDS")]),
    "blank name": ('{"schema_version":"a","fields":{" ":{"type":"string"}}}', [(" ", "BLANK_FIELD_NAME")]),
    "definition": ('{"schema_version":"a","fields":{"x":"string"}}', [("x", "BAD_DEFINITION")]),
    "no type": ('{"schema_version":"a","fields":{"x":{}}}', [("x", "BAD_TYPE")]),
    "money": ('{"schema_version":"a","fields":{"x":{"type":"money"}}}', [("x", "UNSUPPORTED_TYPE")]),
    "required": ('{"schema_version":"a","fields":{"x":{"type":"string","required":"yes"}}}', [("x", "BAD_REQUIRED")]),
    "required null": ('{"schema_version":"a","fields":{"x":{"type":"string","required":null}}}', [("x", "BAD_REQUIRED")]),
    "enum empty": ('{"schema_version":"a","fields":{"x":{"type":"string","enum":[]}}}', [("x", "BAD_ENUM")]),
    "enum null": ('{"schema_version":"a","fields":{"x":{"type":"string","enum":null}}}', []),
    "enum items": ('{"schema_version":"a","fields":{"x":{"type":"string","enum":["A",1]}}}', [("x", "BAD_ENUM_ITEM")]),
}


def test_lint(spark):
    docs = spark.createDataFrame([(n, t) for n, (t, _) in LINT.items()], "document string, text string")
    got = {}
    for r in registry.lint(docs).collect():
        got.setdefault(r.document, []).append((r.field, r.error))
    for name, (_, want) in LINT.items():
        assert got.get(name, []) == want, name
    valid = registry.contracts_from(docs)
    assert valid.count() == 2 and valid.first().required is True


def test_registry_from_files(spark, tmp_path):
    for v, doc in registry.checkout_documents().items():
        (tmp_path / f"{v}.json").write_text(json.dumps(doc, indent=1))
    (tmp_path / "v4.json").write_text("{broken")
    folder = str(tmp_path)
    c = registry.read_contracts(spark, folder)
    assert [r[0] for r in registry.versions(c).collect()] == ["v1", "v2", "v3"]
    assert registry.contract(c, "v1").count() == 17
    with pytest.raises(KeyError):
        registry.current_version(spark, _empty(tmp_path))
    (tmp_path / "registry.json").write_text('{"current_version": "v2"}')
    assert registry.current_version(spark, folder) == "v2"
    (tmp_path / "registry.json").write_text('{"current_version": "v8"}')
    assert registry.current_version(spark, folder) == "v3"
    more = registry.register(c, "v5", registry.contract(c, "v1"))
    assert registry.contract(more, "v5").count() == 17 and more.count() == 72
    assert registry.register(more, "v5", registry.contract(c, "v2")).count() == 74


def _empty(tmp_path):
    (tmp_path / "none").mkdir()
    return str(tmp_path / "none")


def test_read_schema():
    s = compat.read_schema(registry.document_rows(registry.checkout_documents()), "v2")
    assert len(s) == 19 and s["quantity"].dataType == T.LongType() and s["coupon_code"].nullable
    assert not s["event_id"].nullable and s["event_time"].dataType == T.TimestampType()


def test_drift(spark):
    raw = arrivals(spark, [event(1), event(2, amount="9"), event(3, color="red"), event(4, device=None),
                           event(5, source_version="v9"), "torn"])
    out = {(r.schema_version, r.field, r.status): r.events for r in compat.drift(
        compat.observed_fields(raw), registry.checkout_contracts(spark)).collect()}
    assert out[("v1", "amount", "TYPE_MISMATCH")] == 1 and out[("v1", "amount", "OK")] == 3
    assert out[("v1", "color", "UNKNOWN_FIELD")] == 1 and out[("v1", "device", "NULL_VALUE")] == 1
    assert out[("v9", "event_id", "UNKNOWN_VERSION")] == 1
    assert not [k for k in out if k[2] == "NEVER_SEEN" or k[0] == "v2"]


def test_any_pair_by_lifetimes_is_the_pairwise_comparison(spark):
    """Versions whose fields come, go, come back and change; all pairs, both ways round."""
    import random
    rnd, rows = random.Random(9), []
    state = {}
    for v in range(12):
        for name in "abcdefg":
            if rnd.random() < 0.3:
                state[name] = rnd.choice([None, ("string", True, None), ("string", False, ["x", "y"]), ("string", True, ["y", "x"]),
                                          ("integer", True, None), ("float", True, None)])
        rows += [(f"v{v:02d}", k, name, *state[name]) for k, name in enumerate(rnd.sample("abcdefg", 7)) if state.get(name)]
    df = spark.createDataFrame(rows, "schema_version string, position int, field string, type string, required boolean, enum array<string>")
    versions = sorted({r[0] for r in rows})
    every = spark.createDataFrame([(a, b) for a in versions for b in versions], "old_version string, new_version string")
    want, got = (sorted(map(str, f(df, every).select("old_version", "new_version", "seq", "field", "change_type", "old_value", "new_value").collect()))
                 for f in (compat.compare, compat.compare_any))
    assert got == want and len(want) > 100
    joins = compat.compare_any(df, every)._jdf.queryExecution().optimizedPlan().toString()
    assert "FullOuter" not in joins
    life = compat.lifetimes(df).collect()
    assert sum(r.versions for r in life) == len(rows)
    assert {(a, b) for a in versions for b in versions if a < b} == {tuple(r) for r in compat.all_pairs(df).collect()}


def test_single_quoted_payloads_are_no_json(spark):
    texts = ["{'a':1}", '{"a":\'b\'}', '{"a":1, \'b\':2}', '{"a":"it\'s"}', '{"a":"\'"}{}', '{"a":1}']
    from tidewarden.functions.payload import is_json_object
    df = spark.createDataFrame([(t,) for t in texts], "value string").selectExpr("value", f"{is_json_object('value')} AS ok")
    assert {r.value for r in df.where("ok").collect()} == {'{"a":"it\'s"}', '{"a":1}'}


def test_observed_payloads_are_parsed_once(spark):
    raw = arrivals(spark, [event(i) for i in range(3)])
    for seen in (compat.observed_fields(raw), compat.kind_counts(raw), compat.observed_contracts(raw, F.col("offset"), ["currency"])):
        assert seen._jdf.queryExecution().executedPlan().toString().count("from_json(") == 1


def test_kinds_counted_by_type_name_are_those_of_the_entries(spark):
    values = ['1', '2.0', '2.5', '1e400', '""', '"a"', 'true', 'null', '{"x":2.0}', '{"x":2.5}', '[]', '[2.0]', '["a",1]', '{}']
    raw = arrivals(spark, [f'{{"a":{v},"source_version":"v{i % 2}"}}' for i, v in enumerate(values)] + ['{}', '{"a":1,"a":"x"}', 'x'])
    entries = compat.payload_entries(raw, [])
    expected = entries.groupBy("schema_version", "key", "kind").agg(F.count(F.lit(1)).alias("events"))
    assert sorted(map(repr, compat.observed_fields(raw).collect())) == sorted(map(repr, expected.collect()))
    expected = entries.groupBy("key", "kind").agg(F.count(F.lit(1)).alias("events"))
    assert sorted(map(repr, compat.kind_counts(raw).collect())) == sorted(map(repr, expected.collect()))
