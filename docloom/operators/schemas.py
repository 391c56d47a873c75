"""JSON Schemas: inferred from documents by merging partial schemas, and checked against documents."""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.dynamic.lane import mapped, ship
from docloom.errors import JsonError

DIALECT = "http://json-schema.org/schema#"
DEEPEST, MOST_PROBLEMS = 64, 64


# --- inference. A partial schema: kinds of scalars seen, and, if seen, what arrays hold and what objects have.

def partial(v) -> dict:
    if isinstance(v, dict):
        return {"kinds": [], "object": {"properties": {k: partial(x) for k, x in v.items()}, "required": sorted(v)}}
    if isinstance(v, list):
        items = None
        for x in v:
            items = merged(items, partial(x))
        return {"kinds": [], "array": {"items": items}}
    name = "null" if v is None else "boolean" if isinstance(v, bool) else "integer" if isinstance(v, int) else "number" if isinstance(v, float) else "string"
    return {"kinds": [name]}


def merged(a: dict | None, b: dict | None) -> dict | None:
    """What two partial schemas allow together; the order of merging doesn't matter."""
    if a is None or b is None:
        return a or b
    kinds = {*a["kinds"], *b["kinds"]}
    if "number" in kinds:
        kinds.discard("integer")
    out: dict = {"kinds": sorted(kinds)}
    if "array" in a or "array" in b:
        out["array"] = {"items": merged(a.get("array", {}).get("items"), b.get("array", {}).get("items"))}
    if "object" in a and "object" in b:
        x, y = a["object"], b["object"]
        names = [*x["properties"], *(k for k in y["properties"] if k not in x["properties"])]
        out["object"] = {"properties": {k: merged(x["properties"].get(k), y["properties"].get(k)) for k in names}, "required": sorted({*x["required"]} & {*y["required"]})}
    elif "object" in a or "object" in b:
        out["object"] = a.get("object") or b.get("object")
    return out


def as_schema(p: dict | None) -> dict:
    """A partial schema as JSON Schema."""
    if p is None:
        return {}
    parts = []
    if p["kinds"]:
        parts.append({"type": p["kinds"][0] if len(p["kinds"]) == 1 else p["kinds"]})
    if "array" in p:
        parts.append({"type": "array", "items": as_schema(p["array"]["items"])})
    if "object" in p:
        o = p["object"]
        parts.append({"type": "object", "properties": {k: as_schema(o["properties"][k]) for k in sorted(o["properties"])}, "required": o["required"]})
    return parts[0] if len(parts) == 1 else {"anyOf": parts}


def infer_counted(documents: DataFrame, column: str = "value") -> tuple[dict, int]:
    """The JSON Schema of all documents (JSON text) of a column, and the number of documents that can't be read. Each task merges its own; tens of partial schemas meet at a time."""
    from docloom.dynamic import reader

    ship(documents)

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, bad = None, 0
        for b in batches:
            for text in b.column(0).to_pylist():
                try:
                    if text is not None:
                        out = merged(out, partial(reader.parse(text)))
                except JsonError:
                    bad += 1
        yield pa.RecordBatch.from_pydict({"part": [json.dumps([out, bad])]})

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, bad = None, 0
        for b in batches:
            for text in b.column(0).to_pylist():
                more, n = json.loads(text)
                out, bad = merged(out, more) if more is not None else out, bad + n
        yield pa.RecordBatch.from_pydict({"part": [json.dumps([out, bad])]})

    parts = documents.select(column).mapInArrow(part, "part string").repartition(16).mapInArrow(join, "part string")
    out, bad = None, 0
    for r in parts.collect():  # 16 at most
        more, n = json.loads(r[0])
        out, bad = merged(out, more) if more is not None else out, bad + n
    return {"$schema": DIALECT} | as_schema(out), bad


def infer(documents: DataFrame, column: str = "value") -> dict:
    """The JSON Schema of all documents (JSON text) of a column; those that can't be read teach nothing (infer_counted() says how many they are)."""
    return infer_counted(documents, column)[0]


# --- validation

def type_of(v) -> str:
    return partial(v)["kinds"][0] if not isinstance(v, (list, dict)) else "array" if isinstance(v, list) else "object"


def problems(schema, value, root=None, path: str = "@", depth: int = 0) -> Iterator[tuple[str, str, str]]:
    """kind, path and message of what is wrong with a value."""
    root = schema if root is None else root
    if schema is True or schema == {}:
        return
    if schema is False:
        yield "false", path, "nothing is allowed here"
        return
    if depth > DEEPEST:
        yield "depth", path, f"more than {DEEPEST} levels"
        return
    if "$ref" in schema:
        name = schema["$ref"].rsplit("/", 1)[-1]
        target = root if schema["$ref"] == "#" else root.get("$defs", {}).get(name, root.get("definitions", {}).get(name))
        if target is None:
            yield "$ref", path, f"{schema['$ref']} isn't defined"
        else:
            yield from problems(target, value, root, path, depth + 1)
        return
    if "anyOf" in schema and all(next(problems(s, value, root, path, depth + 1), None) for s in schema["anyOf"]):
        yield "anyOf", path, "none of the schemas fits"
    if "enum" in schema and not any(type(e) is type(value) and e == value or not isinstance(e, bool) and not isinstance(value, bool) and isinstance(e, (int, float)) and isinstance(value, (int, float)) and e == value for e in schema["enum"]):
        yield "enum", path, "not one of the allowed values"
    kind = type_of(value)
    if "type" in schema:
        allowed = schema["type"] if isinstance(schema["type"], list) else [schema["type"]]
        if kind not in allowed and not (kind == "integer" and "number" in allowed):
            yield "type", path, f"{kind} instead of {' or '.join(allowed)}"
            return
    if isinstance(value, str):
        size = len(value.encode("utf-16-le")) // 2
        if "pattern" in schema and not re.search(schema["pattern"], value):
            yield "pattern", path, f"doesn't match {schema['pattern']}"
        if size < schema.get("minLength", 0) or size > schema.get("maxLength", math.inf):
            yield "minLength" if size < schema.get("minLength", 0) else "maxLength", path, f"a string of {size} characters"
    if kind in ("integer", "number"):
        for name, wrong in (("minimum", lambda x, y: x < y), ("maximum", lambda x, y: x > y), ("exclusiveMinimum", lambda x, y: x <= y), ("exclusiveMaximum", lambda x, y: x >= y)):
            if name in schema and wrong(value, schema[name]):
                yield name, path, f"{value} is beyond {schema[name]}"
    if isinstance(value, list):
        if not schema.get("minItems", 0) <= len(value) <= schema.get("maxItems", math.inf):
            yield "minItems" if len(value) < schema.get("minItems", 0) else "maxItems", path, f"an array of {len(value)}"
        if "items" in schema:
            for i, x in enumerate(value):
                yield from problems(schema["items"], x, root, f"{path}[{i}]", depth + 1)
        if "contains" in schema:
            n = sum(next(problems(schema["contains"], x, root, path, depth + 1), None) is None for x in value)
            if not schema.get("minContains", 1) <= n <= schema.get("maxContains", math.inf):
                yield "contains", path, f"{n} elements fit"
    if isinstance(value, dict):
        for k in schema.get("required", []):
            if k not in value:
                yield "required", path, f"the key {k!r} is missing"
        for k, x in value.items():
            fits = [s for p, s in schema.get("patternProperties", {}).items() if re.search(p, k)]
            if k in schema.get("properties", {}):
                fits.append(schema["properties"][k])
            for s in fits:
                yield from problems(s, x, root, f"{path}.{k}", depth + 1)


def validate(documents: DataFrame, schema: dict, column: str = "value", most: int = MOST_PROBLEMS) -> DataFrame:
    """documents with problems: what is wrong with each (JSON text), at most `most`; none for valid ones."""
    from itertools import islice

    from docloom.dynamic import reader

    def one(text: str | None) -> tuple:
        try:
            value = reader.parse(text or "")
        except JsonError as e:
            return ([{"kind": "json", "path": "@", "message": str(e)}],)
        return ([{"kind": k, "path": p, "message": m} for k, p, m in islice(problems(schema, value), most)],)

    return mapped(documents, column, one, "problems array<struct<kind: string, path: string, message: string>>")


def kind_of(t: T.DataType) -> str:
    """What JSON Schema calls the values of a column."""
    kinds = ((T.BooleanType, "boolean"), ((T.ByteType, T.ShortType, T.IntegerType, T.LongType), "integer"), (T.NumericType, "number"), (T.ArrayType, "array"), ((T.StructType, T.MapType), "object"), (T.NullType, "null"))
    return next((n for k, n in kinds if isinstance(t, k)), "string")


def validate_columns(df: DataFrame, schema: dict) -> DataFrame:
    """The rows of a relation with problems (names of the broken keywords, as key:keyword), by Column expressions alone: type, required, enum, pattern, lengths and bounds of scalar keys."""
    from docloom.plans.typed import quoted

    checks = []
    for name, s in schema.get("properties", {}).items():
        if name not in df.columns:
            if name in schema.get("required", []):
                checks.append(F.lit(f"{name}:required"))
            continue
        c = quoted(name)
        kinds = [s["type"]] if isinstance(s.get("type"), str) else s.get("type")
        if kinds:
            held = kind_of(df.schema[name].dataType)
            # a double that is whole is an integer, too, and null is a kind of its own
            whole = (c == F.floor(c)) if held == "number" and "integer" in kinds and "number" not in kinds else F.lit(held in kinds or held == "integer" and "number" in kinds)
            checks.append(F.when(~whole if "null" in kinds else ~(whole & c.isNotNull()), F.lit(f"{name}:type")))
        bad = {
            "enum": lambda v, c=c: ~c.isin(*v), "pattern": lambda v, c=c: ~c.rlike(v), "minLength": lambda v, c=c: F.length(c) < v, "maxLength": lambda v, c=c: F.length(c) > v,
            "minimum": lambda v, c=c: c < v, "maximum": lambda v, c=c: c > v, "exclusiveMinimum": lambda v, c=c: c <= v, "exclusiveMaximum": lambda v, c=c: c >= v,
        }
        checks += [F.when(f(s[k]), F.lit(f"{name}:{k}")) for k, f in bad.items() if k in s]
        if name in schema.get("required", []):
            checks.append(F.when(c.isNull(), F.lit(f"{name}:required")))
    found = F.filter(F.array(*checks), lambda x: x.isNotNull()) if checks else F.array().cast("array<string>")
    return df.withColumn("problems", found)


def validate_files(documents: DataFrame, patterns: dict[str, dict], column: str = "value", path: str = "path") -> DataFrame:
    """documents checked by file name: the first pattern that matches a document's path decides its schema; others have no problems."""
    from itertools import islice

    from docloom.dynamic import reader

    def one(text: str | None) -> tuple:
        where, _, body = (text or "").partition("\0")
        for p, schema in patterns.items():
            if re.search(p, where):
                try:
                    return ([f"{k} at {at}: {m}" for k, at, m in islice(problems(schema, reader.parse(body)), MOST_PROBLEMS)],)
                except JsonError as e:
                    return ([str(e)],)
        return ([],)

    both = documents.withColumn("__both", F.concat(F.col(path), F.lit("\0"), F.coalesce(column, F.lit(""))))
    return mapped(both, "__both", one, "problems array<string>").drop("__both")
