"""JSON Schema: as Spark types, and as a check of values, in Python and as a column.

Both checks know the same keywords and say the same; schemas are given to them ``resolved``.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Mapping
from functools import reduce
from operator import or_
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_SIMPLE = {"string": T.StringType(), "integer": T.LongType(), "number": T.DoubleType(), "boolean": T.BooleanType()}


def resolved(schema: Mapping, root: Mapping | None = None, above: tuple[str, ...] = ()) -> dict:
    """The schema with what its ``$ref`` name inside it in their place."""
    root = schema if root is None else root
    if "$ref" in schema:
        ref = schema["$ref"]
        if not ref.startswith("#") or ref in above:
            raise ValueError(f"{ref} is outside the schema" if not ref.startswith("#") else f"{ref} refers to itself, which no Spark type can hold")
        found: Any = root
        for key in ref[1:].split("/")[1:]:
            found = found[key.replace("~1", "/").replace("~0", "~")]
        return resolved({**found, **{k: v for k, v in schema.items() if k != "$ref"}}, root, (*above, ref))
    out = dict(schema)
    for key in ("items", "additionalProperties"):
        if isinstance(out.get(key), Mapping):
            out[key] = resolved(out[key], root, above)
    for key in ("anyOf", "oneOf", "allOf"):
        if key in out:
            out[key] = [resolved(s, root, above) for s in out[key]]
    if "properties" in out:
        out["properties"] = {k: resolved(s, root, above) for k, s in out["properties"].items()}
    return out


def _united(schema: dict) -> dict:
    """A schema and all of its allOf as one, as far as its type goes."""
    out = {k: v for k, v in schema.items() if k != "allOf"}
    for part in map(_united, schema.get("allOf", [])):
        out = out | part | ({"properties": out["properties"] | part["properties"]} if "properties" in out and "properties" in part else {})
    return out


def _without_null(schema: dict) -> tuple[dict | None, bool]:
    """(the schema besides null, whether null is allowed); None for unions of several others."""
    kind = schema.get("type")
    if isinstance(kind, list):
        rest = [k for k in kind if k != "null"]
        return (schema | {"type": rest[0]} if len(rest) == 1 else None), "null" in kind
    for key in ("anyOf", "oneOf"):
        if key in schema:
            rest = [s for s in schema[key] if s.get("type") != "null"]
            return (rest[0] if len(rest) == 1 else None), len(rest) < len(schema[key])
    return schema, kind == "null"


def spark_type(schema: dict) -> T.DataType:
    """The type of values of a schema; what has no one type is a VARIANT."""
    inner, _ = _without_null(_united(schema))
    if inner is None:
        return T.VariantType()
    kind = inner.get("type")
    if kind in _SIMPLE:
        return _SIMPLE[kind]
    if "enum" in inner and all(isinstance(x, str) for x in inner["enum"]):
        return T.StringType()
    if kind == "array" and "items" in inner:
        return T.ArrayType(spark_type(inner["items"]))
    if kind == "object" or "properties" in inner:
        if inner.get("properties"):
            return T.StructType([T.StructField(k, spark_type(s), True) for k, s in inner["properties"].items()])
        extra = inner.get("additionalProperties")
        if isinstance(extra, dict):
            return T.MapType(T.StringType(), spark_type(extra))
    return T.VariantType()


def _is(value: Any, kind: str) -> bool:
    number = isinstance(value, (int, float)) and not isinstance(value, bool)
    return {
        "string": isinstance(value, str),
        "integer": number and float(value).is_integer(),
        "number": number,
        "boolean": isinstance(value, bool),
        "null": value is None,
        "array": isinstance(value, list),
        "object": isinstance(value, dict),
    }.get(kind, True)


def issues(value: Any, schema: dict, at: str = "") -> list[str]:
    """What is wrong with a value: type, enum, const, required, properties, items, limits, pattern,
    unions.  Properties come in the schema's order, then others by name."""
    where = at or "value"
    out = [x for part in schema.get("allOf", []) for x in issues(value, part, at)]
    for key in ("anyOf", "oneOf"):
        if key in schema:
            return out + ([] if any(not issues(value, s, at) for s in schema[key]) else [f"{where} fits none of its types"])
    kind = schema.get("type")
    kinds = kind if isinstance(kind, list) else [kind] if kind else []
    if kinds and not any(_is(value, k) for k in kinds):
        return [*out, f"{where} is not {' or '.join(kinds)}"]
    if "enum" in schema and not any(_same(value, x) for x in schema["enum"]):
        out.append(f"{where} is none of {', '.join(map(str, schema['enum']))}")
    if "const" in schema and not _same(value, schema["const"]):
        out.append(f"{where} is not {schema['const']}")
    if isinstance(value, dict):
        below = f"{at}." if at else ""
        out += [f"{below}{k} is missing" for k in schema.get("required", []) if k not in value]
        known, other = schema.get("properties", {}), schema.get("additionalProperties")
        for k in [*(k for k in known if k in value), *sorted(k for k in value if k not in known)]:
            inner = known.get(k, other)
            if isinstance(inner, dict):
                out += issues(value[k], inner, below + k)
            elif inner is False:
                out.append(f"{below}{k} is not expected")
    if isinstance(value, list):
        if isinstance(schema.get("items"), dict):
            for i, v in enumerate(value):
                out += issues(v, schema["items"], f"{at}[{i}]")
        if len(value) < schema.get("minItems", 0):
            out.append(f"{where} has too few items")
        if len(value) > schema.get("maxItems", len(value)):
            out.append(f"{where} has too many items")
    if isinstance(value, str):
        if len(value) < schema.get("minLength", 0) or len(value) > schema.get("maxLength", len(value)):
            out.append(f"{where} has a wrong length")
        if "pattern" in schema and not re.search(schema["pattern"], value):
            out.append(f"{where} does not match {schema['pattern']}")
    if _is(value, "number"):
        if value < schema.get("minimum", value) or value > schema.get("maximum", value):
            out.append(f"{where} is out of range")
    return out


def _same(a: Any, b: Any) -> bool:
    return isinstance(a, bool) == isinstance(b, bool) and a == b


# ------------------------------------------------------------------------------- the same, natively


def _get(v: Column, kind: str) -> Column:
    return F.try_variant_get(v, "$", kind)


def let(value: Column, function: Callable[[Column], Column]) -> Column:
    """``function(value)`` with the value computed once, however often the function uses it."""
    return F.get(F.transform(F.array(value), function), F.lit(0))


def _member(v: Column, key: str) -> Column:
    """A member as a VARIANT; null if it isn't there, a JSON null if it is null."""
    for quote in ("'", '"'):
        if quote not in key:
            return F.try_variant_get(v, f"$[{quote}{key}{quote}]", "variant")
    members = _get(v, "map<string,variant>")
    return F.when(F.map_contains_key(members, key), F.coalesce(members[key], F.parse_json(F.lit("null"))))


def _is_native(v: Column, name: Column, kind: str) -> Column:
    """``name`` is the value's type, VOID for a JSON null."""
    number = name.isin("BIGINT", "DOUBLE") | name.startswith("DECIMAL")
    return {
        "string": name == "STRING",
        "integer": F.when(number, _get(v, "double") == F.rint(_get(v, "double"))).otherwise(False),
        "number": number,
        "boolean": name == "BOOLEAN",
        "null": name == "VOID",
        "array": name.startswith("ARRAY"),
        "object": name.startswith("OBJECT"),
    }.get(kind, F.lit(True))


def _same_native(v: Column, name: Column, constant: Any) -> Column:
    if constant is None:
        return _is_native(v, name, "null")
    if isinstance(constant, (bool, int, float, str)):
        kind, cast = ("boolean", bool) if isinstance(constant, bool) else ("string", str) if isinstance(constant, str) else ("number", float)
        return _is_native(v, name, kind) & (_get(v, "double" if kind == "number" else kind) == F.lit(cast(constant)))
    return F.coalesce(F.to_json(v) == F.to_json(F.parse_json(F.lit(json.dumps(constant)))), F.lit(False))


def native_issues(v: Column, schema: dict, at: Column | None = None) -> Column:
    """``issues`` of a VARIANT column, as an array of texts."""
    name = F.coalesce(F.schema_of_variant(v), F.lit("VOID"))
    if schema == {"type": "string"}:  # the commonest leaf needs no binding
        wrong = F.concat(F.lit("value") if at is None else at, F.lit(" is not string"))
        return F.when(name == "STRING", F.array().cast("array<string>")).otherwise(F.array(wrong))
    return let(F.struct(v.alias("value"), name.alias("name")), lambda x: _native_issues(x["value"], x["name"], schema, at))


def _native_issues(v: Column, name: Column, schema: dict, at: Column | None) -> Column:
    none = F.array().cast("array<string>")
    where = F.lit("value") if at is None else at
    found: list[Column] = []

    def say(wrong: Column, *message: Column) -> Column:
        return F.when(wrong, F.array(F.concat(*message))).otherwise(none)

    def all_of(parts: list[Column]) -> Column:
        return F.concat(*parts) if parts else none

    first = [native_issues(v, part, at) for part in schema.get("allOf", [])]
    for key in ("anyOf", "oneOf"):
        if key in schema:
            fits = reduce(or_, (F.size(native_issues(v, s, at)) == 0 for s in schema[key]), F.lit(False))
            return all_of([*first, say(~fits, where, F.lit(" fits none of its types"))])
    if "enum" in schema:
        known_value = reduce(or_, (_same_native(v, name, x) for x in schema["enum"]), F.lit(False))
        found.append(say(~known_value, where, F.lit(" is none of " + ", ".join(map(str, schema["enum"])))))
    if "const" in schema:
        found.append(say(~_same_native(v, name, schema["const"]), where, F.lit(f" is not {schema['const']}")))
    found += _native_members(v, name, schema, at, say, none)
    found += _native_items(v, name, schema, at, say, none)
    if schema.keys() & {"minLength", "maxLength", "pattern"}:
        text, is_text = _get(v, "string"), _is_native(v, name, "string")
        n = F.length(text)
        wrong = (n < schema.get("minLength", 0)) | (n > schema["maxLength"] if "maxLength" in schema else F.lit(False))
        found.append(say(is_text & wrong, where, F.lit(" has a wrong length")))
        if "pattern" in schema:
            found.append(say(is_text & ~text.rlike(schema["pattern"]), where, F.lit(f" does not match {schema['pattern']}")))
    if schema.keys() & {"minimum", "maximum"}:
        value = _get(v, "double")
        low = value < float(schema["minimum"]) if "minimum" in schema else F.lit(False)
        high = value > float(schema["maximum"]) if "maximum" in schema else F.lit(False)
        found.append(say(_is_native(v, name, "number") & (low | high), where, F.lit(" is out of range")))
    kind = schema.get("type")
    kinds = kind if isinstance(kind, list) else [kind] if kind else []
    inner = all_of(found)
    if kinds:
        fits = reduce(or_, (_is_native(v, name, k) for k in kinds))
        inner = F.when(F.coalesce(fits, F.lit(False)), inner).otherwise(F.array(F.concat(where, F.lit(f" is not {' or '.join(kinds)}"))))
    return all_of([*first, inner])


def _native_members(v: Column, name: Column, schema: dict, at: Column | None, say, none: Column) -> list[Column]:
    known, other = schema.get("properties", {}), schema.get("additionalProperties")
    is_object = _is_native(v, name, "object")

    def path(key: Column) -> Column:
        return key if at is None else F.concat(at, F.lit("."), key)

    out = [say(is_object & _member(v, k).isNull(), path(F.lit(k)), F.lit(" is missing")) for k in schema.get("required", [])]
    out += [F.when(is_object & _member(v, k).isNotNull(), native_issues(_member(v, k), s, path(F.lit(k)))).otherwise(none) for k, s in known.items()]
    if other is False or isinstance(other, dict):

        def odd(members: Column) -> Column:
            keys = F.array_sort(F.filter(F.map_keys(members), lambda k: ~k.isin(list(known)) if known else F.lit(True)))
            if other is False:
                return F.transform(keys, lambda k: F.concat(path(k), F.lit(" is not expected")))
            return F.flatten(F.transform(keys, lambda k: native_issues(members[k], other, path(k))))

        out.append(F.when(is_object, let(_get(v, "map<string,variant>"), odd)).otherwise(none))
    return out


def _native_items(v: Column, name: Column, schema: dict, at: Column | None, say, none: Column) -> list[Column]:
    out, where = [], F.lit("value") if at is None else at
    is_array, items = _is_native(v, name, "array"), _get(v, "array<variant>")
    if isinstance(schema.get("items"), dict):

        def one(x: Column, i: Column) -> Column:
            return native_issues(x, schema["items"], F.concat(*([] if at is None else [at]), F.lit("["), i.cast("string"), F.lit("]")))

        out.append(F.when(is_array, F.flatten(F.transform(items, one))).otherwise(none))
    if "minItems" in schema:
        out.append(say(is_array & (F.size(items) < schema["minItems"]), where, F.lit(" has too few items")))
    if "maxItems" in schema:
        out.append(say(is_array & (F.size(items) > schema["maxItems"]), where, F.lit(" has too many items")))
    return out
