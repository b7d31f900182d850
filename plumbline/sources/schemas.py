"""Spark schemas of the logical tables, and of JSON Schemas of replies."""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: The decoded drawing, keyed by sheet; ordinals keep the drawing order.
SHEETS = "doc_id string, page_number int, width_pt double, height_pt double"
PATHS = "doc_id string, page_number int, path_id int, fill array<double>, stroke_width double, items array<struct<kind:string,x0:double,y0:double,x1:double,y1:double>>"
WORDS = "doc_id string, page_number int, block_no int, line_no int, word_no int, word string, x0 double, y0 double, x1 double, y1 double"
SPANS = "doc_id string, page_number int, block_no int, line_no int, span_no int, font_size double, dir_x double, dir_y double, chars array<struct<c:string,x0:double,y0:double,x1:double,y1:double>>"
RESPONSES = "run_id string, doc_id string, page_number int, response string, error string, elapsed double"
CALLS = "call_id long, model string, prompt long, completion long, reasoning long, cache_write long, cache_read long"
PRICING = "model string, input double, output double, reasoning double, cache_write double, cache_read double"


class SchemaError(ValueError):
    """A JSON Schema that no column type expresses."""


_SCALARS = {"string": T.StringType(), "number": T.DoubleType(), "integer": T.LongType(), "boolean": T.BooleanType(), "null": T.NullType()}


def unwrap(schema: Any) -> dict:
    """The schema in an envelope {"schema": ...}, or as it is."""
    if isinstance(schema, dict) and isinstance(schema.get("schema"), dict):
        schema = schema["schema"]
    if not isinstance(schema, dict):
        raise SchemaError("a schema is an object")
    return schema


def load(path: str) -> dict:
    with open(path, encoding="utf-8") as f:
        return unwrap(json.load(f))


def spark_type(schema: dict, root: dict | None = None, seen: tuple[str, ...] = ()) -> T.DataType:
    """The column type of a JSON Schema; unions and recursion become VARIANT.

    External references, arrays without items and unknown types are errors.
    """
    root = schema if root is None else root
    if "$ref" in schema:
        where, _, name = schema["$ref"].rpartition("/")
        if where not in ("#/$defs", "#/definitions"):
            raise SchemaError(f"only references to $defs: {schema['$ref']}")
        found = {**root.get("$defs", {}), **root.get("definitions", {})}.get(name)
        if found is None:
            raise SchemaError(f"no such definition: {name}")
        return T.VariantType() if name in seen else spark_type(found, root, (*seen, name))
    for key in ("anyOf", "oneOf"):
        if key in schema:
            if not schema[key]:
                raise SchemaError(f"an empty {key}")
            return _union([spark_type(s, root, seen) for s in schema[key]])
    if "enum" in schema or "const" in schema:
        values = schema.get("enum", [schema.get("const")])
        if len({json.dumps(v) for v in values}) != len(values):
            raise SchemaError("repeated values of an enum")
        return _union([_of_value(v) for v in values])
    kind = schema.get("type")
    if isinstance(kind, list):
        rest = {k: v for k, v in schema.items() if k != "type"}
        return _union([spark_type({"type": k, **rest}, root, seen) for k in kind])
    if kind == "object" or kind is None and "properties" in schema:
        return T.StructType([T.StructField(k, spark_type(v, root, seen), True) for k, v in schema.get("properties", {}).items()])
    if kind == "array":
        if not isinstance(schema.get("items"), dict):
            raise SchemaError("an array declares its items")
        return T.ArrayType(spark_type(schema["items"], root, seen))
    if kind in _SCALARS:
        return _SCALARS[kind]
    if kind is None and not schema:
        return T.VariantType()
    raise SchemaError(f"unsupported type: {kind}")


def _of_value(v: Any) -> T.DataType:
    return _SCALARS["null" if v is None else "boolean" if isinstance(v, bool) else "integer" if isinstance(v, int) else "number" if isinstance(v, float) else "string"]


def _union(kinds: list[T.DataType]) -> T.DataType:
    """One type besides null is that type; whole and other numbers are numbers."""
    kinds = [k for i, k in enumerate(kinds) if not isinstance(k, T.NullType) and k not in kinds[:i]]
    if not kinds:
        return T.NullType()
    if len(kinds) == 1:
        return kinds[0]
    return T.DoubleType() if all(isinstance(k, (T.LongType, T.DoubleType)) for k in kinds) else T.VariantType()


def unique_names(titles: list[str]) -> list[str]:
    """Names of types from titles: ASCII word characters alone, a letter first and large, a number where one is taken."""
    taken: set[str] = set()
    out = []
    for title in titles:
        plain = "".join(c if c.isascii() and (c.isalnum() or c == "_") else "_" for c in title)
        name = plain[0].upper() + plain[1:] if plain[:1].isalpha() else "Model_" + plain
        n = 1
        while (full := name if n == 1 else f"{name}{n}") in taken:
            n += 1
        taken.add(full)
        out.append(full)
    return out


def strict(schema: Any) -> Any:
    """The schema with all properties required and no others allowed, at every level."""
    if isinstance(schema, list):
        return [strict(x) for x in schema]
    if not isinstance(schema, dict):
        return schema
    out = {k: strict(v) for k, v in schema.items()}
    if isinstance(schema.get("properties"), dict):
        out["required"] = list(schema["properties"])
        out["additionalProperties"] = False
    return out


def problems(value: Any, schema: dict, root: dict | None = None, at: str = "$") -> list[str]:
    """Where a reply departs from its schema: missing, unexpected or of another type."""
    root = schema if root is None else root
    if "$ref" in schema:
        return problems(value, {**root.get("$defs", {}), **root.get("definitions", {})}[schema["$ref"].rpartition("/")[2]], root, at)
    for key in ("anyOf", "oneOf"):
        if key in schema:
            each = [problems(value, s, root, at) for s in schema[key]]
            return [] if any(not e for e in each) else [f"{at}: fits none of the alternatives"]
    if "enum" in schema and value not in schema["enum"] or "const" in schema and value != schema["const"]:
        return [f"{at}: not an allowed value"]
    kinds = schema.get("type", "object" if "properties" in schema else None)
    kinds = kinds if isinstance(kinds, list) else [kinds] if kinds else []
    fits = {
        "object": lambda v: isinstance(v, dict), "array": lambda v: isinstance(v, list), "string": lambda v: isinstance(v, str), "null": lambda v: v is None, "boolean": lambda v: isinstance(v, bool),
        "integer": lambda v: isinstance(v, int) and not isinstance(v, bool), "number": lambda v: isinstance(v, (int, float)) and not isinstance(v, bool),
    }
    if kinds and not any(fits[k](value) for k in kinds):
        return [f"{at}: not {' or '.join(kinds)}"]
    out: list[str] = []
    if isinstance(value, dict):
        own = schema.get("properties", {})
        out += [f"{at}.{k}: missing" for k in schema.get("required", []) if k not in value and not problems_allow_null(own.get(k, {}))]
        if schema.get("additionalProperties", False) is not True and own:
            out += [f"{at}.{k}: unexpected" for k in value if k not in own]
        for k, s in own.items():
            if k in value and not (value[k] is None and k not in schema.get("required", [])):
                out += problems(value[k], s, root, f"{at}.{k}")
    if isinstance(value, list) and isinstance(schema.get("items"), dict):
        for i, x in enumerate(value):
            out += problems(x, schema["items"], root, f"{at}[{i}]")
    return out


def problems_allow_null(schema: dict) -> bool:
    kind = schema.get("type")
    return isinstance(kind, list) and "null" in kind or any(s.get("type") == "null" for key in ("anyOf", "oneOf") for s in schema.get(key, []))


def checked(replies: DataFrame, schema: dict, column: str = "response", most: int = 3) -> DataFrame:
    """Replies with ``problems``: the first places at which the JSON text in a column departs from a schema.

    Null for a text that is no JSON, empty for a good reply.
    """
    out = T.StructType([*replies.schema.fields, T.StructField("problems", T.ArrayType(T.StringType()))])
    at, arrow = replies.columns.index(column), to_arrow_schema(out)

    def found(text: str | None) -> list[str] | None:
        try:
            return None if text is None else problems(json.loads(text), schema)[:most]
        except ValueError:
            return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            told = pa.array(list(map(found, batch.column(at).to_pylist())), pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip([*batch.columns, told], arrow)], schema=arrow)

    return replies.mapInArrow(run, out)
