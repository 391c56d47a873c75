"""Random documents from JSON Schemas, and random strings from patterns."""

from __future__ import annotations

import json
import random
import re
import string
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from docloom.errors import QueryError

DEEPEST, MOST_REPEATS = 64, 20
PRINTABLE = string.ascii_letters + string.digits + string.punctuation + " "
EXTENDED = PRINTABLE + "".join(map(chr, range(0xA1, 0x100)))
try:  # the standard library's pattern parser has moved
    from re import _constants as sre
    from re import _parser as sre_parser
except ImportError:
    import sre_constants as sre
    import sre_parse as sre_parser


def matching(pattern: str, r: random.Random) -> str:
    """A string that matches a pattern without look-around; repeats end at MOST_REPEATS."""
    tree = sre_parser.parse(pattern)
    groups: dict[int, str] = {}

    def chosen(items) -> str:
        negated, allowed = False, []
        for kind, v in items:
            if kind is sre.NEGATE:
                negated = True
            elif kind is sre.LITERAL:
                allowed.append(chr(v))
            elif kind is sre.RANGE:
                allowed += map(chr, range(v[0], v[1] + 1))
            elif kind is sre.CATEGORY:
                allowed += category(v)
        return r.choice([c for c in PRINTABLE if c not in allowed] if negated else allowed)

    def category(v) -> str:
        sets = {sre.CATEGORY_DIGIT: string.digits, sre.CATEGORY_SPACE: " \t", sre.CATEGORY_WORD: string.ascii_letters + string.digits + "_"}
        if v in sets:
            return sets[v]
        inverse = {sre.CATEGORY_NOT_DIGIT: sre.CATEGORY_DIGIT, sre.CATEGORY_NOT_SPACE: sre.CATEGORY_SPACE, sre.CATEGORY_NOT_WORD: sre.CATEGORY_WORD}
        return "".join(c for c in PRINTABLE if c not in sets[inverse[v]])

    def made(items) -> str:
        out = []
        for kind, v in items:
            if kind is sre.LITERAL:
                c = chr(v)
                out.append(r.choice((c.lower(), c.upper())) if tree.state.flags & re.I else c)
            elif kind is sre.NOT_LITERAL:
                out.append(r.choice([c for c in PRINTABLE if c != chr(v)]))
            elif kind is sre.ANY:
                out.append(r.choice(PRINTABLE))
            elif kind is sre.IN:
                out.append(chosen(v))
            elif kind is sre.BRANCH:
                out.append(made(r.choice(v[1])))
            elif kind in (sre.MAX_REPEAT, sre.MIN_REPEAT):
                low, high, inner = v
                n = r.randint(low, max(low, min(int(high), MOST_REPEATS)))
                out += [made(inner) for _ in range(n)]
            elif kind is sre.SUBPATTERN:
                text = made(v[3])
                if v[0]:
                    groups[v[0]] = text
                out.append(text)
            elif kind is sre.GROUPREF:
                out.append(groups.get(v, ""))
            elif kind is not sre.AT:
                raise QueryError(f"{pattern!r}: strings for this kind of pattern can't be made")
        return "".join(out)

    return made(tree)


def generate(schema, r: random.Random, fewest: int | None = None, most: int | None = None, extended: bool = False, patterns: bool = False, root=None, depth: int = 0):
    """A random value that a schema allows. fewest, most: array lengths where the schema says none."""
    root = schema if root is None else root
    fewest, most = 0 if fewest is None else fewest, 10 if most is None else most
    if depth > DEEPEST:
        return None
    again = lambda s: generate(s, r, fewest, most, extended, patterns, root, depth + 1)
    if schema is True or schema == {}:
        return r.choice([None, True, 1, 1.5, "a"])
    if schema is False:
        raise QueryError("nothing is allowed")
    if "$ref" in schema:
        name = schema["$ref"].rsplit("/", 1)[-1]
        return again(root if schema["$ref"] == "#" else root.get("$defs", {}).get(name) or root["definitions"][name])
    if "anyOf" in schema:
        some = schema["anyOf"]
        return again(r.choice([s for s in some if "$ref" not in s] or some) if depth > 16 else r.choice(some))
    if "enum" in schema:
        return r.choice(schema["enum"])
    kind = schema.get("type", "object" if "properties" in schema else "null")
    kind = r.choice(kind) if isinstance(kind, list) else kind
    if kind == "null":
        return None
    if kind == "boolean":
        return r.random() < 0.5
    if kind == "integer":
        low = schema.get("minimum", schema.get("exclusiveMinimum", -(2**31)))
        high = schema.get("maximum", schema.get("exclusiveMaximum", 2**31 - 1))
        return r.randint(int(low) + ("exclusiveMinimum" in schema), int(high) - ("exclusiveMaximum" in schema))
    if kind == "number":
        low, high = schema.get("minimum", schema.get("exclusiveMinimum", -5.0)), schema.get("maximum", schema.get("exclusiveMaximum", 5.0))
        return r.uniform(low, max(low, high))
    if kind == "string":
        if patterns and "pattern" in schema:
            return matching(schema["pattern"], r)
        low = schema.get("minLength", 0)
        n = r.randint(low, max(low, schema.get("maxLength", low + 10)))
        return "".join(r.choice(EXTENDED if extended else PRINTABLE) for _ in range(n))
    if kind == "array":
        low = schema.get("minItems", fewest)
        n = r.randint(low, max(low, schema.get("maxItems", max(most, low))))
        out = [again(schema.get("items", {})) for _ in range(n)]
        if "contains" in schema:
            low = schema.get("minContains", 1)
            out += [again(schema["contains"]) for _ in range(r.randint(low, max(low, min(schema.get("maxContains", low + 2), low + 2))))]
            r.shuffle(out)
        return out
    if kind == "object":
        needed = set(schema.get("required", []))
        out = {k: again(s) for k, s in schema.get("properties", {}).items() if k in needed or depth < 16 and r.random() < 0.5}
        for p, s in schema.get("patternProperties", {}).items():
            for _ in range(r.randint(0, 2)):
                out[matching(p, r)] = again(s)
        return out
    raise QueryError(f"the type {kind!r} is unknown")


def documents(spark: SparkSession, schema: dict, n: int, seed: int = 0, **limits) -> DataFrame:
    """n random documents (id, value as JSON text); each depends on seed and id only, so that a lost task makes the same."""
    from docloom.dynamic import writer
    from docloom.dynamic.lane import ship

    text = json.dumps(schema)
    out = spark.range(n)
    ship(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = json.loads(text)
        for b in batches:
            made = [writer.compact(generate(s, random.Random(f"{seed}:{i}"), **limits), False) for i in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_pydict({"id": b.column(0), "value": made})

    return out.mapInArrow(run, "id long, value string")
