"""Event contracts as tables: loading, linting and the version registry.

A contract document is JSON: ``{"schema_version": .., "fields": {name: {"type",
"required", "enum"}}}``. As a table it has one row per version and field.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidewarden import model
from tidewarden.functions.payload import value_kind, value_text

CONTRACT = model.layout(
    "schema_version STRING, position INT, field STRING, type STRING, required BOOLEAN, "
    "enum ARRAY<STRING>")

# --- fixed values: the published checkout contracts ---------------------------
_V1_TYPES = {**{f: "string" for f in model.EVENT_FIELDS}, "event_time": "timestamp",
             "quantity": "integer", "unit_price": "float", "amount": "float"}
_V1_ENUMS = {"payment_method": model.PAYMENT_METHODS, "payment_status": model.PAYMENT_STATUSES}
_V2_ENUMS = {**_V1_ENUMS, "payment_status": [*model.PAYMENT_STATUSES, "REFUNDED"]}
_V2_OPTIONAL = {"device_model": "string", "coupon_code": "string"}
CURRENT_VERSION = "v2"
# ------------------------------------------------------------------------------


def _document(version: str, types: dict, optional: dict, enums: dict) -> dict:
    fields = {}
    for name, kind in {**types, **optional}.items():
        fields[name] = {"type": kind, "required": name not in optional}
        if name in enums:
            fields[name]["enum"] = enums[name]
    return {"schema_version": version, "fields": fields}


def checkout_documents() -> dict[str, dict]:
    """The three published versions; the third turns ``amount`` into text."""
    return {
        "v1": _document("v1", _V1_TYPES, {}, _V1_ENUMS),
        "v2": _document("v2", _V1_TYPES, _V2_OPTIONAL, _V2_ENUMS),
        "v3": _document("v3", {**_V1_TYPES, "amount": "string"}, _V2_OPTIONAL, _V2_ENUMS),
    }


def document_rows(documents: dict[str, dict]) -> list[tuple]:
    """Contract-table rows of parsed documents; ``required`` defaults to true."""
    return [(version, i, name, spec["type"], spec.get("required", True), spec.get("enum"))
            for version, doc in documents.items()
            for i, (name, spec) in enumerate(doc["fields"].items())]


def checkout_contracts(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(document_rows(checkout_documents()), CONTRACT)


def read_documents(spark: SparkSession, folder: str, pattern: str = "v*.json") -> DataFrame:
    """(document, text) of the contract files in a folder."""
    return (spark.read.option("pathGlobFilter", pattern).text(folder, wholetext=True)
            .select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("document"),
                    F.col("value").alias("text")))


def _field_problems(v: Column) -> list[tuple[Column, str]]:
    """Conditions on one field definition, each with its error code."""
    kind = value_kind(v)
    part = {k: F.try_variant_get(v, f"$.{k}", "variant") for k in ("type", "required", "enum")}
    type_text = F.when(value_kind(part["type"]) == "string", value_text(part["type"]))
    items = F.try_variant_get(part["enum"], "$", "array<variant>")
    has_enum = part["enum"].isNotNull() & (value_kind(part["enum"]) != "null")
    is_object = kind == "object"
    return [
        (kind != "object", "BAD_DEFINITION"),
        (is_object & (F.coalesce(type_text, F.lit("")) == ""), "BAD_TYPE"),
        (is_object & (type_text != "") & ~type_text.isin(model.CONTRACT_TYPES), "UNSUPPORTED_TYPE"),
        (is_object & part["required"].isNotNull() & (value_kind(part["required"]) != "boolean"),
         "BAD_REQUIRED"),
        (is_object & has_enum & ((value_kind(part["enum"]) != "array") | (F.size(items) == 0)),
         "BAD_ENUM"),
        (is_object & has_enum & F.exists(items, lambda x: value_kind(x) != "string"),
         "BAD_ENUM_ITEM"),
    ]


def _codes(problems: list[tuple[Column, str]]) -> Column:
    return F.array_compact(F.array(*[F.when(cond, F.lit(code)) for cond, code in problems]))


def lint(documents: DataFrame) -> DataFrame:
    """Violations (document, field, error) of (document, text) rows.

    All violations are listed; a document without any is valid.
    """
    docs = documents.withColumn("_v", F.try_parse_json("text"))
    docs = docs.withColumn("_kind", value_kind(F.col("_v"))) \
        .withColumn("_fields", F.try_variant_get("_v", "$.fields", "variant"))
    version = F.try_variant_get("_v", "$.schema_version", "variant")
    is_object = F.col("_kind") == "object"
    whole = docs.select("document", F.lit(None).cast("string").alias("field"), F.explode(_codes([
        (F.col("_v").isNull(), "INVALID_JSON"),
        (F.col("_kind") != "object", "NOT_AN_OBJECT"),
        (is_object & ~F.coalesce((value_kind(version) == "string") & (value_text(version) != ""),
                                 F.lit(False)), "BAD_SCHEMA_VERSION"),
        (is_object & ~F.coalesce(value_kind(F.col("_fields")) == "object", F.lit(False)), "BAD_FIELDS"),
    ])).alias("error"))
    fields = docs.where(value_kind(F.col("_fields")) == "object").select(
        "document", F.explode(F.try_variant_get("_fields", "$", "map<string,variant>")).alias("field", "_d"))
    blank = [(F.trim("field") == "", "BLANK_FIELD_NAME")]
    per_field = fields.select("document", "field",
                              F.explode(_codes(blank + _field_problems(F.col("_d")))).alias("error"))
    return whole.unionByName(per_field)


def contracts_from(documents: DataFrame) -> DataFrame:
    """Contract table of the valid documents; faulty ones are left out."""
    shape = "schema_version STRING, fields MAP<STRING, STRUCT<type: STRING, required: BOOLEAN, enum: ARRAY<STRING>>>"
    bad = lint(documents).select("document").distinct()
    valid = documents.join(bad, "document", "left_anti")
    parsed = valid.select(F.from_json("text", shape).alias("d"))
    return parsed.select(
        F.col("d.schema_version").alias("schema_version"),
        F.posexplode("d.fields").alias("position", "field", "spec")).select(
        "schema_version", "position", "field", "spec.type",
        F.coalesce("spec.required", F.lit(True)).alias("required"), "spec.enum")


def read_contracts(spark: SparkSession, folder: str) -> DataFrame:
    return contracts_from(read_documents(spark, folder))


def current_version(spark: SparkSession, folder: str) -> str:
    """Version the manifest names (``v1`` without one), or the last loaded one
    if the named version is not there."""
    manifest = (spark.read.option("pathGlobFilter", "registry.json").text(folder, wholetext=True)
                .select(F.get_json_object("value", "$.current_version").alias("v")).first())
    named = (manifest.v if manifest else None) or "v1"
    known = [r[0] for r in versions(read_contracts(spark, folder)).collect()]
    if not known:
        raise KeyError("the registry holds no contract")
    return named if named in known else known[-1]


def versions(contracts: DataFrame) -> DataFrame:
    """Known versions, sorted as text."""
    return contracts.select("schema_version").distinct().orderBy("schema_version")


def contract(contracts: DataFrame, version: str) -> DataFrame:
    return contracts.where(F.col("schema_version") == version).orderBy("position")


def register(contracts: DataFrame, version: str, rows: DataFrame) -> DataFrame:
    """Registry with one version added or replaced; the tag overrides the
    version the rows carry."""
    tagged = rows.withColumn("schema_version", F.lit(version)).select(*CONTRACT.fieldNames())
    return contracts.where(F.col("schema_version") != version).select(*CONTRACT.fieldNames()) \
        .unionByName(tagged)
