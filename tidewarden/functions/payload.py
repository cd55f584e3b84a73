"""JSON payload helpers that keep null, missing and mistyped values apart."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def once(expression: str) -> str:
    """SQL that evaluates an expensive expression exactly once per row.

    The optimizer copies a projected expression into every filter on it, and a
    filter that mentions it many times would parse the payload as often. It
    does not move filters below a generator, so the value is produced by one
    that always yields one row.
    """
    return f"explode(array({expression}))"


def once_per_row(c: Column) -> Column:
    """:func:`once` for a column."""
    return F.explode(F.array(c))


def is_json_object(value: str) -> str:
    """SQL condition: the text is one JSON object and nothing else.

    The parsers stop after the first value and ignore what follows. Inside an
    array, before and after another element, the text must be exactly one element.
    Only a text that closes the array itself needs the second test. Trimming is dear, and done only where there is something to trim:
    it stands inside a branch, as Spark computes what two conditions share for every row.
    They also take single quotes for double ones; the variant parser does not, and
    is asked only about texts that hold one.
    """
    bare = f"CASE WHEN startswith({value}, '{{') AND endswith({value}, '}}') THEN {value} ELSE trim(BOTH ' \\t\\n\\r' FROM {value}) END"
    return (f"(startswith({bare}, '{{') AND endswith({bare}, '}}') "
            f"AND coalesce(json_array_length(concat('[', {value}, ',0]')) = 2, false) "
            f"AND (instr({value}, ']') = 0 OR coalesce(json_array_length(concat('[0,', {value}, ']')) = 2, false)) "
            f"AND (instr({value}, '\\'') = 0 OR try_parse_json({value}) IS NOT NULL))")


def json_body(value: str = "value") -> str:
    """SQL: the text if it is a JSON object, else NULL."""
    return f"CASE WHEN {is_json_object(value)} THEN {value} END"


def needs_escape(text: Column) -> Column:
    return text.rlike(r'["\\\x00-\x1f]')


def json_quote(text: Column, special: Column | None = None) -> Column:
    """JSON string literal; the slow escape runs only where it is needed.

    ``special`` may say so for several columns of a row at once.
    """
    escaped = F.to_json(F.array(text))
    inner = F.substr(escaped, F.lit(2), F.length(escaped) - 2)
    return F.when(needs_escape(text) if special is None else special, inner) \
        .otherwise(F.concat(F.lit('"'), text, F.lit('"')))


def json_object(fields: dict[str, Column]) -> Column:
    """JSON object text from value literals; a NULL literal omits its key."""
    parts = [F.concat(F.lit(f'"{name}":'), value) for name, value in fields.items()]
    return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))


def encode(row: Column) -> Column:
    """JSON text of a struct with its nulls written out."""
    return F.to_json(row, {"ignoreNullFields": "false"})


def digits_as_long(text: Column, default: int) -> Column:
    """Number made of the digits in a text, or a default when it has none."""
    return F.coalesce(F.regexp_replace(text, r"\D", "").try_cast("long"), F.lit(default))


def negated(value: Column, default: object) -> Column:
    """Minus the magnitude; a zero or null becomes minus the default."""
    return F.when(value.isNull() | (value == 0), -F.lit(default).cast("double")) \
        .otherwise(-F.abs(value.cast("double")))


# Variant type names and the contract type each belongs to.
KINDS = {"VOID": "null", "STRING": "string", "BIGINT": "integer", "DECIMAL": "float",
         "DOUBLE": "float", "FLOAT": "float", "BOOLEAN": "boolean", "OBJECT": "object",
         "ARRAY": "array"}


def type_name(value: Column) -> Column:
    """Variant type name, with that of an object or array cut to its first word: few names, cheap to count by."""
    name = F.schema_of_variant(value)
    return F.when(name.startswith("OBJECT"), "OBJECT").when(name.startswith("ARRAY"), "ARRAY").otherwise(name)


def kind_of(name: Column) -> Column:
    """Contract type of a variant's type name.

    A number without a fraction (``2.0``) counts as an integer.
    """
    base = F.substring_index(F.substring_index(name, "(", 1), "<", 1)
    lookup = F.create_map(*[F.lit(x) for pair in KINDS.items() for x in pair])
    return F.when(name.endswith(",0)"), "integer").otherwise(F.try_element_at(lookup, base))


def value_kind(value: Column) -> Column:
    """Contract type of a variant: string, integer, float, ..., or null."""
    return kind_of(F.schema_of_variant(value))


def value_text(value: Column) -> Column:
    """Text of a variant, whatever its type; NULL for the JSON null."""
    return F.try_variant_get(value, "$", "string")
