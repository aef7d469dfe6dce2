"""JSON Schema as a column expression over VARIANT: a schema is compiled once, and rows are checked inside the JVM.

A check gives the first violation of a value, as the path to it and the keyword that it breaks, or null. Checks are made in a fixed order: type, enum and
const, then what belongs to numbers, texts, arrays and objects in the order below, members in the order of the schema, and last the combinations.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Keywords that say nothing about validity, and those that are refused because they lead out of the schema.
NOTES = frozenset("$schema $comment title description default examples deprecated readOnly writeOnly".split())
OUTSIDE = frozenset("$ref $dynamicRef $recursiveRef $vocabulary $id".split())
#: Bounds of a tool call's arguments.
MOST_BYTES, MOST_DEPTH, MOST_VALUES = 24 * 1024, 16, 4096
TYPES = frozenset("null boolean integer number string array object".split())
KEYWORDS = frozenset("type enum const minimum maximum exclusiveMinimum exclusiveMaximum multipleOf minLength maxLength pattern minItems maxItems uniqueItems items contains minProperties maxProperties required properties patternProperties additionalProperties propertyNames allOf anyOf oneOf not".split())


def _bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value evaluated once for each row."""
    return F.transform(F.array(value), body)[0]


def kind(v: Column) -> Column:
    """The JSON type of a variant: null, boolean, number, string, array or object; null if there is no value."""
    s = F.schema_of_variant(v)
    return F.when(s.startswith("OBJECT"), "object").when(s.startswith("ARRAY"), "array").when(s == "VOID", "null").when(s == "BOOLEAN", "boolean").when(s == "STRING", "string").when(s.isNotNull(), "number")


def number(v: Column) -> Column:
    return F.try_variant_get(v, "$", "double")


def text(v: Column) -> Column:
    return F.try_variant_get(v, "$", "string")


def parts(v: Column) -> Column:
    return F.try_variant_get(v, "$", "array<variant>")


def members(v: Column) -> Column:
    return F.try_variant_get(v, "$", "map<string,variant>")


def _step(name: str) -> str:
    return "/" + name.replace("~", "~0").replace("/", "~1")


def _literal(value: object) -> Column:
    return F.to_json(F.parse_json(F.lit(json.dumps(value))))


def _first(found: list[Column]) -> Column:
    return F.coalesce(*found) if len(found) > 1 else found[0] if found else F.lit(None).cast("string")


def violation(v: Column, schema: dict | bool, path: Column | None = None) -> Column:
    """'path: keyword' of the first violation of a variant, null if it holds; members and items are joined by '/', the value itself is the empty path.

    Numbers are compared as doubles and values of enum and const by their canonical text. Unknown keywords, references and formats raise when the schema is compiled, so
    nothing is ignored that might matter. A value that isn't there (SQL null) holds.
    """
    path = F.lit("") if path is None else path
    if isinstance(schema, bool):
        return F.lit(None).cast("string") if schema else F.when(v.isNotNull(), F.concat(path, F.lit(": false")))
    strange = set(schema) - KEYWORDS - NOTES
    if strange:
        raise ValueError(f"schema has {'references' if strange & OUTSIDE else 'keywords that are not supported'}: {', '.join(sorted(strange))}")
    return _bind(v, lambda x: _bind(kind(x), lambda k: _first(_checks(x, k, schema, path))))


def _checks(v: Column, k: Column, s: dict, path: Column) -> list[Column]:
    out: list[Column] = []

    def bad(when: Column, keyword: str, of: str | None = None) -> None:
        out.append(F.when(when if of is None else (k == of) & when, F.concat(path, F.lit(f": {keyword}"))))

    def within(of: str, found: Column) -> None:
        out.append(F.when(k == of, found))

    if "type" in s:
        names = [s["type"]] if isinstance(s["type"], str) else list(s["type"])
        if not names or set(names) - TYPES:
            raise ValueError(f"no type of JSON: {names}")
        plain = [n for n in names if n != "integer"]
        fits = k.isin(plain) if plain else F.lit(False)
        if "integer" in names:
            fits = fits | ((k == "number") & (number(v) == F.floor(number(v))))
        bad(~fits, "type")
    for keyword, values in (("enum", s.get("enum")), ("const", [s["const"]] if "const" in s else None)):
        if values is not None:
            bad(~F.to_json(v).isin([_literal(x) for x in values]) if values else k.isNotNull(), keyword)
    for keyword, wrong in (("minimum", lambda n, m: n < m), ("maximum", lambda n, m: n > m), ("exclusiveMinimum", lambda n, m: n <= m), ("exclusiveMaximum", lambda n, m: n >= m), ("multipleOf", lambda n, m: F.abs(n / m - F.round(n / m)) > 1e-9)):
        if keyword in s:
            bad(wrong(number(v), F.lit(float(s[keyword]))), keyword, "number")
    if "minLength" in s:
        bad(F.length(text(v)) < s["minLength"], "minLength", "string")
    if "maxLength" in s:
        bad(F.length(text(v)) > s["maxLength"], "maxLength", "string")
    if "pattern" in s:
        bad(~text(v).rlike(s["pattern"]), "pattern", "string")
    if "minItems" in s:
        bad(F.size(parts(v)) < s["minItems"], "minItems", "array")
    if "maxItems" in s:
        bad(F.size(parts(v)) > s["maxItems"], "maxItems", "array")
    if s.get("uniqueItems"):
        bad(_bind(F.transform(parts(v), lambda x: F.to_json(x)), lambda a: F.size(F.array_distinct(a)) < F.size(a)), "uniqueItems", "array")
    if "items" in s:
        inner = F.transform(parts(v), lambda x, i: violation(x, s["items"], F.concat(path, F.lit("/"), i.cast("string"))))
        within("array", F.get(F.array_compact(inner), F.lit(0)))
    if "contains" in s:
        bad(~F.exists(parts(v), lambda x: violation(x, s["contains"], path).isNull()), "contains", "array")
    if "minProperties" in s:
        bad(F.size(members(v)) < s["minProperties"], "minProperties", "object")
    if "maxProperties" in s:
        bad(F.size(members(v)) > s["maxProperties"], "maxProperties", "object")
    for name in s.get("required", ()):
        bad(~F.map_contains_key(members(v), name), f"required {name}", "object")
    for name, inner in s.get("properties", {}).items():
        within("object", violation(members(v)[name], inner, F.concat(path, F.lit(_step(name)))))
    named, shapes = list(s.get("properties", {})), s.get("patternProperties", {})

    def each(wanted: Callable[[Column], Column], inner: dict | bool) -> Column:
        held = F.array_sort(F.map_entries(F.map_filter(members(v), lambda n, _: wanted(n))), lambda a, b: F.when(a["key"] < b["key"], -1).when(a["key"] > b["key"], 1).otherwise(0))
        found = F.transform(held, lambda e: violation(e["value"], inner, F.concat(path, F.lit("/"), F.replace(F.replace(e["key"], F.lit("~"), F.lit("~0")), F.lit("/"), F.lit("~1")))))
        return F.get(F.array_compact(found), F.lit(0))

    for shape, inner in shapes.items():
        within("object", each(_matching(shape), inner))
    if "additionalProperties" in s and s["additionalProperties"] is not True:
        within("object", each(_others(named, list(shapes)), s["additionalProperties"]))
    if "propertyNames" in s:
        wrong = F.filter(F.array_sort(F.map_keys(members(v))), lambda n: violation(F.parse_json(F.to_json(F.struct(n.alias("n")))), {"properties": {"n": s["propertyNames"]}}).isNotNull())
        bad(F.size(wrong) > 0, "propertyNames", "object")
    for inner in s.get("allOf", ()):
        out.append(violation(v, inner, path))
    holds = lambda inner: violation(v, inner, path).isNull()
    if "anyOf" in s:
        bad(~F.array_contains(F.array(*[holds(x) for x in s["anyOf"]]), True), "anyOf")
    if "oneOf" in s:
        bad(F.size(F.filter(F.array(*[holds(x) for x in s["oneOf"]]), lambda x: x)) != 1, "oneOf")
    if "not" in s:
        bad(holds(s["not"]), "not")
    return out


def _matching(shape: str) -> Callable[[Column], Column]:
    return lambda n: n.rlike(shape)


def _others(named: list[str], shapes: list[str]) -> Callable[[Column], Column]:
    def other(n: Column) -> Column:
        out = ~n.isin(named) if named else F.lit(True)
        for shape in shapes:
            out = out & ~n.rlike(shape)
        return out

    return other


def oversized(value: Column) -> Column:
    """Which bound of a call's arguments a JSON text breaks: 'bytes', 'values' or 'depth' of its compact form; null if none.

    Counted on the text without its strings: a value stands behind each comma and each bracket that holds something; innermost brackets are
    folded MOST_DEPTH times where so many open at all, and what is left is too deep.
    """

    def of(plain: Column) -> Column:
        values = 1 + F.regexp_count(plain, F.lit("[,]|[\\[{](?![\\]}])"))
        deep = F.regexp_replace(plain, "\\[\\]|\\{\\}", "0")
        folded = deep
        for _ in range(MOST_DEPTH):
            folded = F.regexp_replace(folded, "[\\[{][^\\[\\]{}]*[\\]}]", "0")
        return F.when(values > MOST_VALUES, "values").when((F.regexp_count(deep, F.lit("[\\[{]")) > MOST_DEPTH) & folded.rlike("[\\[{]"), "depth")

    return F.when(F.octet_length(value) > MOST_BYTES, "bytes").otherwise(_bind(F.regexp_replace(value, '"(?:[^"\\\\]|\\\\.)*"', "0"), of))


def arguments_error(tool: Column, arguments: Column, schemas: dict[str, dict]) -> Column:
    """Why a call of a tool with arguments (JSON text) is refused, the first that applies, null if it isn't: ': json' (no JSON object), ': bytes', ': values' or ': depth', ': tool' (no schema by that name), or the schema's first violation."""

    def of(v: Column) -> Column:
        found = F.lit(": tool")
        for name, schema in schemas.items():
            found = F.when(tool == name, violation(v, schema)).otherwise(found)
        return F.when(F.coalesce(kind(v) != "object", F.lit(True)), ": json").otherwise(F.coalesce(F.concat(F.lit(": "), oversized(F.to_json(v))), found))

    return _bind(F.try_parse_json(arguments), of)
