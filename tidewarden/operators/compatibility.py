"""Contract evolution: differences between versions, verdicts, drift."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from tidewarden.functions.payload import json_body, kind_of, once_per_row, type_name, value_kind, value_text

COMPATIBLE, BREAKING = "COMPATIBLE", "BREAKING"

# The wording of change descriptions and summaries, which readers of change rows match on.
TEXTS = {
    "removed_required": "Removed required field '%s'",
    "removed_optional": "Removed optional field '%s'",
    "added_required": "Added required field '%s' without default",
    "added_optional": "Added optional field '%s'",
    "promoted": "Safe type promotion for field '%s' (%s -> %s)",
    "retyped": "Incompatible type change for field '%s' (%s -> %s)",
    "tightened": "Field '%s' changed from optional to required",
    "relaxed": "Field '%s' relaxed from required to optional",
    "enum_gained": "Enum field '%s' expanded with new value(s): %s",
    "enum_lost": "Enum field '%s' removed value(s): %s",
    "identical": "Schema %s and %s are identical.",
    "compatible": "Schema evolution from %s to %s is COMPATIBLE (%d change(s) detected).",
    "breaking": "Schema evolution from %s to %s is BREAKING (%d breaking change(s) detected out of %d total).",
}


def _worded(text: str, *values: Column) -> Column:
    return F.format_string(TEXTS[text], *values)


def type_compatible(old: Column, new: Column) -> Column:
    """Same type, or an integer widened to a float."""
    return (old == new) | ((old == "integer") & (new == "float"))


def consecutive_pairs(contracts: DataFrame) -> DataFrame:
    """(old_version, new_version) of neighbouring versions in text order."""
    ordered = contracts.select("schema_version").distinct()
    w = W.orderBy("schema_version")
    return ordered.select(F.lag("schema_version").over(w).alias("old_version"),
                          F.col("schema_version").alias("new_version")) \
        .where(F.col("old_version").isNotNull())


def compare(contracts: DataFrame, pairs: DataFrame) -> DataFrame:
    """Change rows of every version pair.

    Fields are matched by name in one full outer join over all pairs. ``seq``
    orders the changes of a pair: removed fields, added fields, then the
    changes of kept fields by type, required flag and enum.

    A missing enum counts as an empty one as soon as the other side has one, so
    giving a free-text field an enum is reported as values added.
    """
    def side(version: str, prefix: str) -> DataFrame:
        c = contracts.select(F.col("schema_version").alias(version), "field",
                             F.struct("type", "required", "enum", "position").alias(prefix))
        return pairs.join(c, version).select("old_version", "new_version", "field", prefix)

    both = side("old_version", "o").join(side("new_version", "n"),
                                         ["old_version", "new_version", "field"], "full_outer")
    return _changes(both)


def lifetimes(contracts: DataFrame) -> DataFrame:
    """Intervals of versions in which a field keeps its definition: (field, nth, first_version, last_version, versions, type, required, enum).

    Versions are taken in text order. A field that is absent for a version, or has another type, required flag or enum,
    begins a new interval afterwards. ``nth`` counts the intervals of a field.
    """
    return _islands(contracts).groupBy("field", "nth").agg(
        F.min("schema_version").alias("first_version"), F.max("schema_version").alias("last_version"), F.count(F.lit(1)).alias("versions"),
        *[F.any_value(c).alias(c) for c in ("type", "required", "enum")])


def _islands(contracts: DataFrame) -> DataFrame:
    """The contract rows with the number ``nth`` of their field's interval."""
    order = contracts.select("schema_version").distinct().select(
        F.col("schema_version").alias("_version"), F.row_number().over(W.orderBy("schema_version")).alias("_at"))
    series = W.partitionBy("field").orderBy("_at")
    definition = F.struct("type", "required", F.array_sort("enum").alias("enum"))
    rows = contracts.join(order, F.col("schema_version") == F.col("_version")).drop("_version").withColumn("_definition", definition)
    follows = (F.lag("_at").over(series) == F.col("_at") - 1) & F.lag("_definition").over(series).eqNullSafe(F.col("_definition"))
    return rows.withColumn("_new", F.when(follows, 0).otherwise(1)) \
        .withColumn("nth", F.sum("_new").over(series.rowsBetween(W.unboundedPreceding, 0))).drop("_new", "_definition", "_at")


def all_pairs(contracts: DataFrame) -> DataFrame:
    """(old_version, new_version) of each version with every later one; a registry holds few versions."""
    listed = contracts.agg(F.array_sort(F.collect_set("schema_version")).alias("v"))
    return listed.select("v", F.posexplode("v").alias("_i", "old_version")).select(
        "old_version", F.explode(F.slice("v", F.col("_i") + 2, F.size("v"))).alias("new_version"))


def compare_any(contracts: DataFrame, pairs: DataFrame) -> DataFrame:
    """Change rows of any version pairs, as :func:`compare` gives them, by way of the fields' lifetimes.

    A version is a list of intervals, one per field. Two versions differ at most in the fields whose interval differs, so a pair
    takes two lookups by version and a comparison of two lists; definitions are fetched for the differing intervals only.
    """
    islands = _islands(contracts)
    whole = islands.groupBy("schema_version").agg(F.collect_list(F.struct("field", "nth")).alias("intervals"),
                                                  F.map_from_entries(F.collect_list(F.struct("field", "position"))).alias("places"))
    side = lambda version, name: whole.select(F.col("schema_version").alias(version), F.struct("intervals", "places").alias(name))
    both = pairs.join(side("old_version", "_old"), "old_version", "left").join(side("new_version", "_new"), "new_version", "left")
    old, new = (F.coalesce(F.col(s)["intervals"], F.array().cast("array<struct<field:string,nth:bigint>>")) for s in ("_old", "_new"))
    both = both.withColumns({"_gone": F.array_except(old, new), "_come": F.array_except(new, old)})
    names = F.array_distinct(F.concat(F.col("_gone")["field"], F.col("_come")["field"]))
    nth = lambda side: F.try_element_at(F.filter(side, lambda x: x["field"] == F.col("field")), F.lit(1))["nth"]
    place = lambda side: F.try_element_at(F.col(side)["places"], F.col("field"))
    changed = both.withColumn("field", F.explode(names)).select(
        "old_version", "new_version", "field", nth("_gone").alias("_o"), nth("_come").alias("_n"), place("_old").alias("_op"), place("_new").alias("_np"))
    known = islands.groupBy("field", "nth").agg(*[F.any_value(c).alias(c) for c in ("type", "required", "enum")])
    for number, position, name in (("_o", "_op", "o"), ("_n", "_np", "n")):
        defined = known.select(F.col("field").alias("_f"), F.col("nth").alias("_k"), "type", "required", "enum")
        changed = changed.join(defined, (F.col("field") == F.col("_f")) & (F.col(number) == F.col("_k")), "left").withColumn(
            name, F.when(F.col("_f").isNotNull(), F.struct("type", "required", "enum", F.col(position).alias("position")))) \
            .drop("_f", "_k", "type", "required", "enum")
    return _changes(changed)


def _changes(both: DataFrame) -> DataFrame:
    """Change rows of (old_version, new_version, field, o, n), the field's definitions on both sides."""
    o, n, name = F.col("o"), F.col("n"), F.col("field")
    kept = o.isNotNull() & n.isNotNull()
    empty = F.array().cast("array<string>")
    oe, ne = F.array_sort(F.coalesce(o["enum"], empty)), F.array_sort(F.coalesce(n["enum"], empty))
    has_enum = o["enum"].isNotNull() | n["enum"].isNotNull()
    gained, lost = F.array_sort(F.array_except(ne, oe)), F.array_sort(F.array_except(oe, ne))
    text = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    flag = lambda c: c.cast("string")
    shape = lambda c: F.to_json(F.struct(c["type"].alias("type"), c["required"].alias("required")))
    listed = lambda c: F.to_json(c)
    none = F.lit(None).cast("string")

    def change(when: Column, phase: int, pos: Column, step: int, kind: str, old: Column, new: Column,
               breaking: Column, description: Column) -> Column:
        return F.when(when, F.struct(
            F.struct(F.lit(phase).alias("phase"), pos.alias("pos"), F.lit(step).alias("step")).alias("at"),
            F.lit(kind).alias("change_type"), old.alias("old_value"), new.alias("new_value"),
            F.when(breaking, BREAKING).otherwise(COMPATIBLE).alias("classification"),
            F.when(breaking, "BREAKING").otherwise("INFO").alias("severity"),
            description.alias("description")))

    widened = type_compatible(o["type"], n["type"])
    tightened = ~o["required"] & n["required"]
    changes = F.array_compact(F.array(
        change(n.isNull(), 1, o["position"], 0, "FIELD_REMOVED", shape(o), none, F.lit(True),
               F.when(o["required"], _worded("removed_required", name)).otherwise(_worded("removed_optional", name))),
        change(o.isNull(), 2, n["position"], 0, "FIELD_ADDED", none, shape(n), n["required"],
               F.when(n["required"], _worded("added_required", name)).otherwise(_worded("added_optional", name))),
        change(kept & (o["type"] != n["type"]), 3, o["position"], 1, "FIELD_TYPE_CHANGED",
               text(o["type"]), text(n["type"]), ~widened,
               F.when(widened, _worded("promoted", name, o["type"], n["type"])).otherwise(_worded("retyped", name, o["type"], n["type"]))),
        change(kept & (o["required"] != n["required"]), 3, o["position"], 2, "FIELD_REQUIRED_CHANGED",
               flag(o["required"]), flag(n["required"]), tightened,
               F.when(tightened, _worded("tightened", name)).otherwise(_worded("relaxed", name))),
        change(kept & has_enum & (F.size(gained) > 0), 3, o["position"], 3, "ENUM_VALUE_ADDED",
               listed(oe), listed(ne), F.lit(False),
               _worded("enum_gained", name, F.array_join(gained, ", "))),
        change(kept & has_enum & (F.size(lost) > 0), 3, o["position"], 4, "ENUM_VALUE_REMOVED",
               listed(oe), listed(ne), F.lit(True),
               _worded("enum_lost", name, F.array_join(lost, ", ")))))
    rows = both.select("old_version", "new_version", "field", F.explode(changes).alias("c")) \
        .select("old_version", "new_version", "field", "c.*")
    w = W.partitionBy("old_version", "new_version").orderBy("at", "field")
    return rows.withColumn("seq", F.row_number().over(w)).drop("at")


def verdicts(pairs: DataFrame, changes: DataFrame) -> DataFrame:
    """Overall classification and summary text per version pair."""
    counts = changes.groupBy("old_version", "new_version").agg(
        F.count(F.lit(1)).alias("changes"), F.count_if(F.col("classification") == BREAKING).alias("breaking"))
    v = pairs.join(counts, ["old_version", "new_version"], "left").na.fill(0, ["changes", "breaking"])
    old, new = F.col("old_version"), F.col("new_version")
    summary = F.when(F.col("changes") == 0, _worded("identical", old, new)) \
        .when(F.col("breaking") == 0, _worded("compatible", old, new, F.col("changes"))) \
        .otherwise(_worded("breaking", old, new, F.col("breaking"), F.col("changes")))
    return v.withColumn("classification", F.when(F.col("breaking") > 0, BREAKING).otherwise(COMPATIBLE)) \
        .withColumn("summary", summary)


def breaking_events(changes: DataFrame, published_at: Column | None = None) -> DataFrame:
    """Rows for the schema-event table: breaking changes only."""
    now = published_at if published_at is not None else F.localtimestamp()
    return changes.where(F.col("classification") == BREAKING).select(
        "old_version", "new_version", "change_type", "field", "classification", "description",
        now.cast("timestamp_ntz").alias("published_at"))


SPARK_TYPES = {"string": T.StringType(), "integer": T.LongType(), "float": T.DoubleType(),
               "boolean": T.BooleanType(), "timestamp": T.TimestampType(), "object": T.VariantType(),
               "array": T.ArrayType(T.VariantType())}


def read_schema(contract_rows: list[tuple], version: str) -> T.StructType:
    """Spark schema of one contract version."""
    own = sorted((r for r in contract_rows if r[0] == version), key=lambda r: r[1])
    return T.StructType([T.StructField(r[2], SPARK_TYPES[r[3]], not r[4]) for r in own])


def _entries(raw: DataFrame, keep: list[Column], whole: bool) -> DataFrame:
    """The kept columns, ``schema_version``, key and variant ``_v`` of each key of the JSON object payloads.

    A payload is parsed once: the parse stands in a generator, as the test that it gave something would repeat it otherwise.
    """
    m = F.from_json(F.expr(json_body()), "map<string,variant>")
    entries = raw.select(*keep, once_per_row(m).alias("_m")).where(F.col("_m").isNotNull())
    entries = entries.withColumn("schema_version", value_text(F.try_element_at("_m", F.lit("source_version"))))
    names = [c for c in entries.columns if c != "_m"]
    listed = F.map_entries("_m")
    last = F.filter(listed, lambda e, i: F.array_position(
        F.transform(F.slice(listed, i + 2, F.size(listed)), lambda x: x["key"]), e["key"]) == 0)
    keys = F.map_keys("_m")
    newest = F.when(F.size(F.array_distinct(keys)) == F.size(keys), listed).otherwise(last)   # repeated keys are rare
    if whole:
        newest = F.concat(newest, F.array(F.struct(F.lit(None).cast("string").alias("key"),
                                                   F.lit(None).cast("variant").alias("value"))))
    return entries.select(*names, F.explode(newest).alias("_e")).select(*names, F.col("_e.key").alias("key"), F.col("_e.value").alias("_v"))


def payload_entries(raw: DataFrame, keep: list[Column], whole: bool = False) -> DataFrame:
    """One row per key of each JSON object payload: key, kind and text.

    A repeated key counts once, with its last value. ``whole`` adds a row with a
    NULL key per payload, so that payloads can be counted in the same pass.
    """
    return _entries(raw, keep, whole).withColumn("kind", value_kind(F.col("_v"))).withColumn("text", value_text(F.col("_v"))).drop("_v")


def _counts(entries: DataFrame, by: list[str | Column]) -> DataFrame:
    """Entries per ``by``, key and type name; kinds are made of the few names that are left. Adds ``kind`` and ``_n``."""
    named = entries.withColumn("_type", type_name(F.col("_v")))
    return named.groupBy(*by, "key", "_type").agg(F.count(F.lit(1)).alias("_n")).withColumn("kind", kind_of(F.col("_type")))


def kind_counts(raw: DataFrame) -> DataFrame:
    """Events per (key, kind) as seen in the payloads."""
    return _counts(_entries(raw, [], False), []).groupBy("key", "kind").agg(F.sum("_n").alias("events"))


def observed_fields(raw: DataFrame) -> DataFrame:
    """Events per (schema_version, key, kind) as seen in the payloads."""
    return _counts(_entries(raw, [], False), ["schema_version"]).groupBy("schema_version", "key", "kind").agg(F.sum("_n").alias("events"))


def drift(observed: DataFrame, contracts: DataFrame) -> DataFrame:
    """Observed keys and kinds held against the contract of their version.

    Status: OK, UNKNOWN_VERSION, UNKNOWN_FIELD, NULL_VALUE, TYPE_MISMATCH, and
    NEVER_SEEN for a contract field of an observed version without any event.
    """
    seen = observed.select(F.col("schema_version"), F.col("key").alias("field"), "kind", "events")
    live = seen.select("schema_version").distinct()
    want = contracts.select("schema_version", "field", F.col("type").alias("expected"),
                            F.col("required").alias("required"))
    known = want.select("schema_version").distinct().withColumn("_known", F.lit(True))
    want = want.join(live, "schema_version", "left_semi")
    both = seen.join(want, ["schema_version", "field"], "full_outer").join(known, "schema_version", "left")
    fits = (F.col("kind") == F.col("expected")) | ((F.col("kind") == "integer") & (F.col("expected") == "float")) \
        | ((F.col("kind") == "string") & (F.col("expected") == "timestamp"))
    status = (F.when(F.col("_known").isNull(), "UNKNOWN_VERSION").when(F.col("expected").isNull(), "UNKNOWN_FIELD")
              .when(F.col("kind").isNull(), "NEVER_SEEN").when(F.col("kind") == "null", "NULL_VALUE")
              .when(fits, "OK").otherwise("TYPE_MISMATCH"))
    return both.select("schema_version", "field", "expected", "kind",
                       F.coalesce("events", F.lit(0)).alias("events"), status.alias("status"))


def observed_contracts(raw: DataFrame, period: Column, enumerated: list[str]) -> DataFrame:
    """Contract table as practised: one version per period of the log.

    A field's type is its most frequent kind in the period (integer and float
    together count as float); it is required when every payload of the period
    has it with a value. Fields in ``enumerated`` list their observed values,
    which are collapsed to distinct ones before they are gathered. One pass over
    the payloads counts (period, key, kind, enumerated value); all else comes from these counts.
    """
    enum_text = F.when(F.col("key").isin(enumerated) & (F.col("_type") == "STRING"), value_text(F.col("_v")))
    counts = _counts(_entries(raw, [period.alias("period")], True), ["period", enum_text.alias("text")])
    kinds = counts.groupBy("period", "key", "kind").agg(
        F.sum("_n").alias("_n"), F.array_sort(F.collect_set("text")).alias("_values"))
    real = F.coalesce(F.col("kind") != "null", F.lit(False))
    per_key = kinds.groupBy("period", "key").agg(
        F.sum(F.when(real, F.col("_n"))).alias("_n"), F.sum("_n").alias("_all"),
        F.max_by(F.when(real, F.col("kind")), F.when(real, F.struct("_n", "kind"))).alias("_kind"),
        F.coalesce(F.bool_or(F.col("kind") == "float"), F.lit(False)).alias("_float"),
        F.max(F.when(F.col("kind") == "string", F.col("_values"))).alias("_values"))
    total = F.max(F.when(F.col("key").isNull(), F.col("_all"))).over(W.partitionBy("period"))
    typed = F.when(F.col("_kind").isin("integer", "float") & F.col("_float"), "float").otherwise(F.col("_kind"))
    place = F.row_number().over(W.partitionBy("period").orderBy("key")) - 1   # the fields of a period are few
    fields = per_key.withColumn("_events", total).where(F.col("key").isNotNull() & (F.col("_n") > 0))
    return fields.select(
        F.col("period").alias("schema_version"), place.alias("position"), F.col("key").alias("field"), typed.alias("type"),
        (F.col("_n") == F.col("_events")).alias("required"),
        F.when(F.size("_values") > 0, F.col("_values")).alias("enum"))
