"""JSON text that must keep key order, number spelling and separators, which Catalyst's JSON functions don't."""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

FORMS = "array<struct<normal:string,dumped:string>>"


def normal_text(text: str | None) -> str:
    """Parsed and written again with ', ' and ': '; nothing gives '{}'; what isn't JSON stays as it is."""
    if not text:
        return "{}"
    try:
        return json.dumps(json.loads(text), ensure_ascii=False)
    except ValueError:
        return text


def dumped_text(text: str | None) -> str:
    """The JSON value that the text spells, or the text as a JSON string where it spells none."""
    try:
        value = json.loads(text or "")
    except ValueError:
        value = text or ""
    return json.dumps(value, ensure_ascii=False)


def forms(texts: Column) -> Column:
    """Of every text in an array: normal (see normal_text) and dumped (see dumped_text, of the normal text)."""

    @F.arrow_udf(FORMS)
    def run(a: pa.Array) -> pa.Array:
        out = []
        for row in a.to_pylist():
            out.append(None if row is None else [{"normal": (n := normal_text(t)), "dumped": dumped_text(n)} for t in row])
        return pa.array(out, pa.list_(pa.struct([("normal", pa.string()), ("dumped", pa.string())])))

    return run.asNondeterministic()(texts)  # so it is computed where it stands, never inlined into a lambda


def values(texts: Column) -> Column:
    """Of every text in an array the JSON value that it spells, or itself as a JSON string."""

    @F.arrow_udf("array<string>")
    def run(a: pa.Array) -> pa.Array:
        return pa.array([None if row is None else [dumped_text(t) for t in row] for row in a.to_pylist()], pa.list_(pa.string()))

    return run.asNondeterministic()(texts)  # so it is computed where it stands, never inlined into a lambda


def quoted(texts: Column) -> Column:
    """Every text in an array as a JSON string; null as null."""

    @F.arrow_udf("array<string>")
    def run(a: pa.Array) -> pa.Array:
        return pa.array([None if row is None else [json.dumps(t, ensure_ascii=False) for t in row] for row in a.to_pylist()], pa.list_(pa.string()))

    return run.asNondeterministic()(texts)  # so it is computed where it stands, never inlined into a lambda


# The seven type names of JSON Schema drafts.
_TYPES = ("array", "boolean", "integer", "null", "number", "object", "string")
_SUBSCHEMAS = ("additionalItems", "contains", "additionalProperties", "propertyNames", "not", "if", "then", "else")
_MAPS = ("properties", "patternProperties", "definitions")
_COUNTS = ("maxLength", "minLength", "maxItems", "minItems", "maxProperties", "minProperties")


def schema_fault(schema: object) -> str | None:
    """What makes a value no draft-7 schema, by the keywords' own rules; None if nothing does. Formats aren't checked."""
    if isinstance(schema, bool):
        return None
    if not isinstance(schema, dict):
        return "a schema is an object or a boolean"
    kinds = schema.get("type", "object")
    listed = kinds if isinstance(kinds, list) else [kinds]
    if not listed or any(k not in _TYPES for k in listed) or len(set(map(str, listed))) != len(listed):
        return f"no such type: {kinds}"
    required = schema.get("required", [])
    if not isinstance(required, list) or any(not isinstance(r, str) for r in required) or len(set(required)) != len(required):
        return "required is a list of distinct names"
    if "enum" in schema and not isinstance(schema["enum"], list):
        return "enum is a list"
    for k in ("title", "description", "$ref", "$id", "$schema", "$comment", "pattern", "format"):
        if k in schema and not isinstance(schema[k], str):
            return f"{k} is a string"
    for k in _COUNTS:
        if k in schema and (isinstance(schema[k], bool) or not isinstance(schema[k], (int, float)) or schema[k] < 0 or schema[k] != int(schema[k])):
            return f"{k} is a count"
    for k in ("maximum", "minimum", "exclusiveMaximum", "exclusiveMinimum", "multipleOf"):
        if k in schema and (isinstance(schema[k], bool) or not isinstance(schema[k], (int, float)) or k == "multipleOf" and schema[k] <= 0):
            return f"{k} is a number"
    if "uniqueItems" in schema and not isinstance(schema["uniqueItems"], bool):
        return "uniqueItems is a boolean"
    below = [schema[k] for k in _SUBSCHEMAS if k in schema]
    for k in _MAPS:
        if k in schema:
            if not isinstance(schema[k], dict):
                return f"{k} is an object"
            below += schema[k].values()
    for k in ("allOf", "anyOf", "oneOf"):
        if k in schema:
            if not isinstance(schema[k], list) or not schema[k]:
                return f"{k} is a list of schemas"
            below += schema[k]
    if "items" in schema:
        below += schema["items"] if isinstance(schema["items"], list) else [schema["items"]]
    return next((f for s in below if (f := schema_fault(s))), None)


def schema_faults(texts: Column) -> Column:
    """Of every JSON Schema text in an array its fault, or null."""

    def one(text: str | None) -> str | None:
        try:
            return schema_fault(json.loads(text) if text else {})
        except ValueError:
            return "not JSON"

    @F.arrow_udf("array<string>")
    def run(a: pa.Array) -> pa.Array:
        return pa.array([None if row is None else [one(t) for t in row] for row in a.to_pylist()], pa.list_(pa.string()))

    return run.asNondeterministic()(texts)  # so it is computed where it stands, never inlined into a lambda
