"""JSON documents against a subset of JSON Schema: violations with their paths, as columns. The schema is read once, on
the driver, and becomes one expression over a variant; no Python runs in it."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from talus.functions.text import let

#: What a variant's schema says of scalars, by JSON type.
SCALARS = {"string": "^STRING", "boolean": "^BOOLEAN", "null": "^VOID", "number": "^(BIGINT|DECIMAL|DOUBLE|FLOAT)", "integer": "^(BIGINT|DECIMAL|DOUBLE|FLOAT)"}
CONTAINERS = {"object": "map<string,variant>", "array": "array<variant>"}


def as_type(value: Column, kind: str) -> Column:
    return F.try_variant_get(value, "$", kind)


def parsed(text: Column) -> Column:
    """The variant of a JSON text; null where the text is null, is not one whole value, or names a key twice. A
    value that stands alone both in an array and under a key has nothing after it."""
    listed = as_type(F.try_parse_json(F.concat(F.lit("["), text, F.lit("]"))), "array<variant>")
    keyed = F.try_parse_json(F.concat(F.lit('{"v":'), text, F.lit("}")))
    return F.when(keyed.isNotNull() & (F.size(listed) == 1), listed[0])


def has_type(value: Column, kind: str) -> Column:
    if kind in CONTAINERS:
        return as_type(value, CONTAINERS[kind]).isNotNull()
    fits = F.schema_of_variant(value).rlike(SCALARS[kind])
    number = as_type(value, "double")
    return fits & (number == F.rint(number)) if kind == "integer" else fits


def is_value(value: Column, wanted: object) -> Column:
    """Whether the variant equals a value of the schema; 1, 1.0 and 1e0 are alike, the order of keys says nothing."""
    if isinstance(wanted, (int, float)) and not isinstance(wanted, bool):
        return has_type(value, "number") & (as_type(value, "double") == float(wanted))
    return F.to_json(value) == F.to_json(F.parse_json(F.lit(json.dumps(wanted))))


def violations(schema: dict, value: Column, path: Column) -> Column:
    """array<string> of what the variant breaks, each as 'path: what'. Unknown keywords say nothing."""
    none = F.expr("cast(array() as array<string>)")
    said = lambda *text: F.concat(path, *(F.lit(t) if isinstance(t, str) else t for t in text))
    check = lambda broken, text: F.when(broken, F.array(said(text))).otherwise(none)
    kind, found = schema.get("type", ""), []
    if schema.get("enum"):
        known = F.lit(False)
        for wanted in schema["enum"]:
            known = known | F.coalesce(is_value(value, wanted), F.lit(False))
        found.append(check(~known, ": not in enum"))
    if kind == "string":
        text = as_type(value, "string")
        if "minLength" in schema:
            found.append(check(F.octet_length(text) < schema["minLength"], f": shorter than minLength {schema['minLength']}"))
        if "maxLength" in schema:
            found.append(check(F.octet_length(text) > schema["maxLength"], f": longer than maxLength {schema['maxLength']}"))
        if "pattern" in schema:
            pattern = schema["pattern"]
            try:
                re.compile(pattern)
                found.append(check(~text.rlike(pattern), f": does not match pattern {pattern}"))
            except re.error:
                found.append(F.array(said(f": schema declares invalid pattern {pattern}")))
    elif kind in ("number", "integer"):
        number = as_type(value, "double")
        if "min" in schema:
            found.append(check(number < schema["min"], f": under min {schema['min']}"))
        if "max" in schema:
            found.append(check(number > schema["max"], f": over max {schema['max']}"))
    elif kind == "array" and isinstance(schema.get("items"), dict):
        each = lambda x, k: violations(schema["items"], x, said("[", k.cast("string"), "]"))
        found.append(F.flatten(F.transform(as_type(value, CONTAINERS["array"]), each)))
    elif kind == "object":
        known = {k: v for k, v in schema.get("properties", {}).items() if isinstance(v, dict)}
        fields = as_type(value, CONTAINERS["object"])
        keys = F.map_keys(fields)
        found += [check(~F.array_contains(keys, k), f".{k}: missing required field") for k in schema.get("required", [])]
        if schema.get("additionalProperties") is False:
            others = F.array_except(F.array_sort(keys), F.array(*map(F.lit, sorted(known))).cast("array<string>"))
            found.append(F.transform(others, lambda k: said(".", k, ": unexpected field")))
        for k in sorted(known):
            inner = let(F.try_element_at(fields, F.lit(k)), lambda x: violations(known[k], x, said(f".{k}")))  # noqa: B023
            found.append(F.when(F.array_contains(keys, k), inner).otherwise(none))
    out = F.concat(*found) if found else none
    if kind in SCALARS or kind in CONTAINERS:
        out = F.when(has_type(value, kind), out).otherwise(F.array(said(f": expected type {kind}")))
    return out


def validate(column: str | Column, schema: str) -> Column:
    """array<string> of violations of a column of JSON documents."""
    text = F.col(column) if isinstance(column, str) else column
    bad = F.array(F.lit("output is not valid JSON"))
    return let(parsed(text), lambda v: F.when(v.isNull(), bad).otherwise(violations(json.loads(schema), v, F.lit("$"))))


def canonical_json(text: Column) -> Column:
    """One spelling of all JSON texts that hold equal values. Null where the text is no JSON."""
    return F.to_json(parsed(text))


def equal_json(a: Column, b: Column) -> Column:
    """Whether two JSON texts hold equal values; key order and spacing do not matter. Null where one is no JSON."""
    return canonical_json(a) == canonical_json(b)
