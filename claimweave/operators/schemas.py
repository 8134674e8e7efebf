"""JSON Schema (a Draft 7 subset) compiled to Column predicates.

Keywords: type, required, properties, additionalProperties, minProperties, maxProperties, enum, const, pattern,
minLength, maxLength, minimum, maximum, exclusiveMinimum, exclusiveMaximum, multipleOf, items (one schema or one for
each place), additionalItems, contains, minItems, maxItems, uniqueItems, patternProperties, propertyNames,
dependencies, allOf, anyOf, oneOf, not, if/then/else, $ref into the schema itself, and the formats of FORMATS; other
formats are annotations. A schema with another validating keyword, or one that refers to itself, is refused when it
is compiled.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from functools import partial, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

_KNOWN = {"type", "required", "properties", "additionalProperties", "enum", "const", "pattern", "minLength", "maxLength", "minimum", "maximum", "exclusiveMinimum", "exclusiveMaximum", "items", "minItems", "maxItems", "uniqueItems", "allOf", "anyOf", "not", "oneOf", "if", "then", "else", "minProperties", "maxProperties", "multipleOf", "contains", "patternProperties", "propertyNames", "dependencies", "additionalItems", "format"}
_NOTES = {"$schema", "$id", "title", "description", "default", "examples", "$comment", "definitions", "$defs"}

_DATE = r"[0-9]{4}-[0-9]{2}-[0-9]{2}"
_TIME = r"([01][0-9]|2[0-3]):[0-5][0-9]:([0-5][0-9]|60)([.][0-9]+)?([zZ]|[+-]([01][0-9]|2[0-3]):[0-5][0-9])"
_LABEL, _BYTE, _GROUP = "[A-Za-z0-9]([A-Za-z0-9-]{0,61}[A-Za-z0-9])?", "(25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])", "[0-9A-Fa-f]{1,4}"
_HOST = rf"(?=.{{1,253}}\z){_LABEL}([.]{_LABEL})*"
#: Formats that are checked: patterns of the whole text.
FORMATS = {
    "date": _DATE, "time": _TIME, "date-time": f"{_DATE}[Tt]{_TIME}",
    "hostname": _HOST, "email": rf"[A-Za-z0-9!#$%&'*+/=?^_`{{|}}~-]+([.][A-Za-z0-9!#$%&'*+/=?^_`{{|}}~-]+)*@{_HOST}",
    "ipv4": rf"{_BYTE}([.]{_BYTE}){{3}}", "ipv6": rf"({_GROUP}:){{7}}{_GROUP}|(?=.{{2,39}}\z)(?!(.*:)?{_GROUP}(:+{_GROUP}){{7}})({_GROUP}(:{_GROUP})*)?::({_GROUP}(:{_GROUP})*)?",
    "uri": r"[A-Za-z][A-Za-z0-9+.-]*:([A-Za-z0-9._~:/?#@!$&'()*+,;=\[\]-]|%[0-9A-Fa-f]{2})*", "json-pointer": "(/([^~/]|~[01])*)*",
}


def has_format(text: Column, name: str) -> Column:
    """Whether a text is of a format of FORMATS; dates have to be in the calendar."""
    if name == "ipv6":  # two groups may be written as an IPv4 address
        text = F.regexp_replace(text, rf"(?<=:){FORMATS['ipv4']}\z", "0:0")
    fits = text.rlike(rf"\A({FORMATS[name]})\z")
    return fits & F.substring(text, 1, 10).try_cast("date").isNotNull() if name in ("date", "date-time") else fits


class UnsupportedSchema(ValueError):
    """The schema is not of the supported subset."""


def _is(value: Column, kind: str) -> Column:
    shape = F.schema_of_variant(value)
    return {
        "object": shape.startswith("OBJECT"), "array": shape.startswith("ARRAY"), "string": shape == "STRING", "boolean": shape == "BOOLEAN",
        "null": F.is_variant_null(value), "integer": (shape == "BIGINT") | (shape.startswith("DECIMAL") & (F.try_variant_get(value, "$", "double") % 1 == 0)) | ((shape == "DOUBLE") & (F.try_variant_get(value, "$", "double") % 1 == 0)),
        "number": shape.isin("BIGINT", "DOUBLE") | shape.startswith("DECIMAL"),
    }[kind]


def referred(root: dict, ref: str, seen: tuple[str, ...]) -> dict:
    """The part of the schema that a reference such as #/definitions/a names."""
    if not ref.startswith("#") or ref in seen:
        raise UnsupportedSchema(f"$ref {ref}: {'refers to itself' if ref in seen else 'not in this schema'}")
    found = root
    for part in ref[1:].split("/")[1:]:
        name = part.replace("~1", "/").replace("~0", "~")
        if not isinstance(found, dict) or name not in found:
            raise UnsupportedSchema(f"$ref {ref}: nothing there")
        found = found[name]
    return found


def compile_schema(schema: dict, value: Column, path: str = "", root: dict | None = None, seen: tuple[str, ...] = ()) -> list[tuple[str, str, Column]]:
    """(path, kind, failing) of each assertion; `failing` is true where the value breaks it."""
    root = schema if root is None else root

    def inner(sub: dict, at: Column, where: str) -> list[tuple[str, str, Column]]:
        return compile_schema(sub, at, where, root, seen)

    def fails(sub: dict, at: Column) -> Column:
        return _any([c for _, _, c in inner(sub, at, path)])

    if isinstance(schema, dict) and "$ref" in schema:  # what stands beside it is ignored
        return compile_schema(referred(root, schema["$ref"], seen), value, path, root, (*seen, schema["$ref"]))
    if schema is True or schema == {}:
        return []
    if schema is False:
        return [(path, "false_schema", value.isNotNull())]
    if odd := set(schema) - _KNOWN - _NOTES:
        raise UnsupportedSchema(f"{path or '/'}: {sorted(odd)}")
    out: list[tuple[str, str, Column]] = []
    here = value.isNotNull()
    number, text = F.try_variant_get(value, "$", "double"), F.try_variant_get(value, "$", "string")
    is_text, is_array, is_number = here & _is(value, "string"), here & _is(value, "array"), here & _is(value, "number")
    if "type" in schema:
        kinds = schema["type"] if isinstance(schema["type"], list) else [schema["type"]]
        fits = _is(value, kinds[0])
        for k in kinds[1:]:
            fits = fits | _is(value, k)
        out.append((path, "type", here & ~fits))
    for key, test in (("minimum", lambda b: number < b), ("maximum", lambda b: number > b), ("exclusiveMinimum", lambda b: number <= b), ("exclusiveMaximum", lambda b: number >= b)):
        if key in schema:
            if isinstance(schema[key], bool) or not isinstance(schema[key], (int, float)):
                raise UnsupportedSchema(f"{path or '/'}: {key} must be a number")
            out.append((path, key, is_number & test(float(schema[key]))))
    if "minLength" in schema:
        out.append((path, "minLength", is_text & (F.length(text) < schema["minLength"])))
    if "maxLength" in schema:
        out.append((path, "maxLength", is_text & (F.length(text) > schema["maxLength"])))
    if "pattern" in schema:
        out.append((path, "pattern", is_text & ~text.rlike(schema["pattern"])))
    if schema.get("format") in FORMATS:
        out.append((path, "format", is_text & ~has_format(text, schema["format"])))
    for key in ("enum", "const"):
        if key in schema:
            allowed = [json.dumps(v, separators=(",", ":"), ensure_ascii=False) for v in (schema["enum"] if key == "enum" else [schema["const"]])]
            out.append((path, key, here & ~F.coalesce(F.to_json(value), F.lit("null")).isin(*allowed)))
    for name in schema.get("required", []):
        out.append((path, "required", here & _is(value, "object") & F.try_variant_get(value, _step(name), "variant").isNull()))
    for name, sub in schema.get("properties", {}).items():
        out += inner(sub, F.try_variant_get(value, _step(name), "variant"), f"{path}/{name}")
    is_object, known = here & _is(value, "object"), F.array(*map(F.lit, schema.get("properties", {}))).cast("array<string>")
    keys, entries = F.json_object_keys(F.to_json(value)), F.map_entries(F.try_variant_get(value, "$", "map<string,variant>"))

    def some(rows: Column, test: Callable[[Column], Column]) -> Column:
        return F.coalesce(F.exists(rows, test), F.lit(False))

    patterns = schema.get("patternProperties", {})
    for pattern, sub in patterns.items():
        test = partial(lambda p, s, x: x["key"].rlike(p) & fails(s, x["value"]), pattern, sub)
        out.append((f"{path}/*", "patternProperties", is_object & some(entries, lambda x: test(x))))  # noqa: B023
    if "propertyNames" in schema:
        out.append((path, "propertyNames", is_object & some(keys, lambda x: fails(schema["propertyNames"], x.cast("variant")))))
    for name, needs in schema.get("dependencies", {}).items():
        there = is_object & F.array_contains(keys, name)
        missing = F.size(F.array_except(F.array(*map(F.lit, needs)).cast("array<string>"), keys)) > 0 if isinstance(needs, list) else fails(needs, value)
        out.append((path, "dependencies", there & missing))

    def more(x: Column) -> Column:
        return reduce(lambda kept, p: kept & ~x.rlike(p), patterns, ~F.array_contains(known, x))

    if schema.get("additionalProperties") is False:
        out.append((path, "additionalProperties", is_object & some(keys, more)))
    elif isinstance(schema.get("additionalProperties"), dict):
        out.append((f"{path}/*", "additionalProperties", is_object & some(entries, lambda x: more(x["key"]) & fails(schema["additionalProperties"], x["value"]))))
    if "minProperties" in schema:
        out.append((path, "minProperties", is_object & (F.size(keys) < schema["minProperties"])))
    if "maxProperties" in schema:
        out.append((path, "maxProperties", is_object & (F.size(keys) > schema["maxProperties"])))
    if "multipleOf" in schema:
        share = number / F.lit(float(schema["multipleOf"]))
        out.append((path, "multipleOf", is_number & (F.abs(share - F.round(share)) > 1e-9)))
    items = F.try_variant_get(value, "$", "array<variant>")
    if "minItems" in schema:
        out.append((path, "minItems", is_array & (F.size(items) < schema["minItems"])))
    if "maxItems" in schema:
        out.append((path, "maxItems", is_array & (F.size(items) > schema["maxItems"])))
    if schema.get("uniqueItems"):
        texts = F.transform(items, lambda x: F.to_json(x))
        out.append((path, "uniqueItems", is_array & (F.size(F.array_distinct(texts)) < F.size(items))))
    if isinstance(schema.get("items"), list):
        for i, sub in enumerate(schema["items"]):
            out += inner(sub, F.get(items, F.lit(i)), f"{path}/{i}")
        rest = F.slice(items, len(schema["items"]) + 1, F.greatest(F.size(items), F.lit(0)))
        out.append((f"{path}/*", "additionalItems", is_array & F.coalesce(F.exists(rest, lambda x: fails(schema.get("additionalItems", {}), x)), F.lit(False))))
    elif isinstance(schema.get("items"), dict):
        broken = F.exists(items, lambda x: fails(schema["items"], x))
        out.append((f"{path}/*", "items", is_array & F.coalesce(broken, F.lit(False))))
    if "contains" in schema:
        out.append((path, "contains", is_array & F.coalesce(F.forall(items, lambda x: fails(schema["contains"], x)), F.lit(False))))
    for sub in schema.get("allOf", []):
        out += inner(sub, value, path)
    if "anyOf" in schema:
        out.append((path, "anyOf", here & reduce(lambda x, y: x & y, [fails(sub, value) for sub in schema["anyOf"]])))
    if "oneOf" in schema:
        fit = reduce(lambda x, y: x + y, [(~fails(sub, value)).cast("int") for sub in schema["oneOf"]])
        out.append((path, "oneOf", here & (fit != 1)))
    if "not" in schema:
        out.append((path, "not", here & ~fails(schema["not"], value)))
    if "if" in schema:
        met = ~fails(schema["if"], value)
        out += [(p, k, met & c) for p, k, c in inner(schema.get("then", {}), value, path)]
        out += [(p, k, ~met & c) for p, k, c in inner(schema.get("else", {}), value, path)]
    return out


def _step(name: str) -> str:
    return "$['" + name.replace("'", "\\'") + "']"


def _any(conditions: list[Column]) -> Column:
    out = F.lit(False)
    for c in conditions:
        out = out | F.coalesce(c, F.lit(False))
    return out


def validate(df: DataFrame, keys: list[str], json_col: str, schema: dict, max_depth: int = 10) -> DataFrame:
    """keys, valid, n_errors, errors (array<struct<path, kind>>), depth. A parse error or too great a depth is the only error."""
    parsed = df.select(*keys, F.col(json_col).alias("_json"), F.try_parse_json(F.col(json_col)).alias("_value"))
    depth = T.json_depth(F.col("_json"))
    checks = [F.when(F.coalesce(c, F.lit(False)), F.struct(F.lit(p or "/").alias("path"), F.lit(k).alias("kind"))) for p, k, c in compile_schema(schema, F.col("_value"))]
    one = lambda kind: F.array(F.struct(F.lit("/").alias("path"), F.lit(kind).alias("kind")))
    own = F.array_compact(F.array(*checks)) if checks else F.array().cast("array<struct<path:string,kind:string>>")
    errors = F.when(F.col("_value").isNull(), one("parse_error")).when(depth > max_depth, one("max_depth")).otherwise(own)
    out = parsed.select(*keys, errors.alias("errors"), F.when(F.col("_value").isNotNull(), depth).otherwise(0).alias("depth"))
    return out.select(*keys, (F.size("errors") == 0).alias("valid"), F.size("errors").cast("long").alias("n_errors"), "errors", "depth")
