"""Nested relations to flat ones, planned from the schema.

Strategies: d (default): down to the one table in the rows, copying scalars on the way and the scalars of objects that hang
beside it; r: every leaf a column, arrays by position; n: the relation must be flat already; s: whatever is nested becomes
JSON text. Names on a path are joined with a separator.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.errors import QueryError, Untyped
from docloom.functions.scalars import json_text
from docloom.plans.typed import quoted


def is_scalar(t: T.DataType) -> bool:
    return not isinstance(t, (T.ArrayType, T.StructType, T.MapType))


def classify(t: T.DataType) -> str:
    """SCAL, ROW (object of scalars), REC (array of rows), SQR (array of arrays of scalars), TAB (object with arrays of scalars), ARR (array of scalars), BAD."""
    if is_scalar(t):
        return "SCAL"
    if isinstance(t, T.StructType):
        kinds = {classify(f.dataType) for f in t.fields}
        return "ROW" if kinds <= {"SCAL"} else "TAB" if kinds <= {"SCAL", "ARR"} else "BAD"
    if isinstance(t, T.ArrayType):
        inner = classify(t.elementType)
        return {"SCAL": "ARR", "ROW": "REC", "ARR": "SQR", "TAB": "REC"}.get(inner, "BAD")
    return "BAD"


def tables(t: T.DataType, at: tuple = ()) -> list[tuple]:
    """The paths to all tables below a type."""
    if isinstance(t, T.ArrayType):
        if classify(t) in ("REC", "SQR"):
            return [at]
        return tables(t.elementType, at) if not is_scalar(t.elementType) else []
    if isinstance(t, T.StructType):
        return [p for f in t.fields for p in tables(f.dataType, (*at, f.name))]
    return []


def json_of(f: T.StructField) -> Column:
    """A column's JSON text, null keys among it."""
    c = quoted(f.name)
    try:
        return F.when(c.isNotNull(), json_text(c, f.dataType, sort_keys=False))
    except Untyped:  # maps
        return F.to_json(c, {"ignoreNullFields": "false"})


def tabularize(df: DataFrame, strategy: str = "d", separator: str = ".") -> DataFrame:
    """The flat form of a relation by one of the strategies."""
    if strategy == "s":
        return df.select(*(quoted(f.name) if is_scalar(f.dataType) else json_of(f).alias(f.name) for f in df.schema.fields))
    if strategy == "r":
        return recursive(df, separator)
    found = tables(df.schema)
    if strategy == "n":
        if any(not is_scalar(f.dataType) and classify(f.dataType) != "ARR" for f in df.schema.fields):
            raise QueryError("the relation isn't a table")
        return expanded(df, separator)
    if len(found) > 1:
        raise QueryError(f"several tables in the rows: {', '.join('.'.join(p) for p in found)}")
    if not found:
        return expanded(hung(df, separator), separator)
    path = found[0]
    out = df
    for k, name in enumerate(path):
        # beside the way down: scalars, and the scalars of hanging objects
        kind = out.schema[name].dataType
        beside = [f.name for f in out.schema.fields if f.name != name]
        out = hung(out.select(*map(quoted, beside), quoted(name)), separator, keep=name)
        beside = [f.name for f in out.schema.fields if f.name != name]
        while isinstance(kind, T.ArrayType):
            if isinstance(kind.elementType, T.ArrayType) and classify(kind) == "SQR" and k == len(path) - 1:
                break
            out = out.withColumn(name, F.explode(quoted(name)))
            kind = kind.elementType
        if isinstance(kind, T.StructType):
            inner = [quoted(name).getField(f).alias(f if f in path[k + 1 :] else f"{name}{separator}{f}") for f in kind.fieldNames()]
            out = out.select(*map(quoted, beside), *inner)
        elif isinstance(kind, T.ArrayType):
            out = out.withColumn(name, F.explode(quoted(name)))
            return numbered(out, name, separator, "")
    return expanded(out, separator)


def hung(df: DataFrame, separator: str, keep: str | None = None) -> DataFrame:
    """Objects of scalars beside the table become columns `object.key`."""
    columns: list[Column] = []
    names: set[str] = set()
    for f in df.schema.fields:
        if f.name != keep and isinstance(f.dataType, T.StructType):
            parts = [(f"{f.name}{separator}{g.name}", quoted(f.name).getField(g.name)) for g in f.dataType.fields if is_scalar(g.dataType)]
        else:
            parts = [(f.name, quoted(f.name))]
        for n, c in parts:
            if n in names:
                raise QueryError(f"two columns would be called {n!r}")
            names.add(n)
            columns.append(c.alias(n))
    return df.select(*columns)


def expanded(df: DataFrame, separator: str) -> DataFrame:
    """Parallel arrays of scalars side by side, short ones filled with empty strings; scalars repeated; objects left are dropped."""
    arrays = [f for f in df.schema.fields if classify(f.dataType) == "ARR"]
    scalars = [f.name for f in df.schema.fields if is_scalar(f.dataType)]
    if not arrays:
        return df.select(*map(quoted, scalars))
    longest = F.greatest(F.lit(1), F.lit(1), *(F.coalesce(F.size(quoted(a.name)), F.lit(0)) for a in arrays))
    out = df.withColumn("__i", F.explode(F.sequence(F.lit(0), longest - 1)))
    filled = lambda a: F.coalesce(F.when(F.col("__i") < F.size(quoted(a.name)), F.get(quoted(a.name), F.col("__i")).cast("string")), F.lit(""))
    padded = [(F.get(quoted(a.name), F.col("__i")) if len(arrays) == 1 else filled(a)).alias(a.name) for a in arrays]
    return out.select(*map(quoted, scalars), *padded)


def numbered(df: DataFrame, name: str, separator: str, prefix: str) -> DataFrame:
    """An array of scalars as columns col1 and on; the widest row decides how many (one pass over the data)."""
    width = df.agg(F.max(F.size(quoted(name)))).first()[0] or 0
    others = [c for c in df.columns if c != name]
    return df.select(*map(quoted, others), *(F.get(quoted(name), F.lit(i)).alias(f"{prefix}col{i + 1}") for i in range(width)))


def recursive(df: DataFrame, separator: str) -> DataFrame:
    """Every leaf a column; array elements by position, as many as the widest row has."""
    while True:
        nested = [f for f in df.schema.fields if not is_scalar(f.dataType)]
        if not nested:
            return df
        arrays = [f for f in nested if isinstance(f.dataType, T.ArrayType)]
        widths = df.agg(*(F.max(F.size(quoted(f.name))).alias(f"w{i}") for i, f in enumerate(arrays))).first() if arrays else []
        columns = []
        for f in df.schema.fields:
            if isinstance(f.dataType, T.StructType):
                columns += [quoted(f.name).getField(g).alias(f"{f.name}{separator}{g}") for g in f.dataType.fieldNames()]
            elif isinstance(f.dataType, T.ArrayType):
                width = widths[next(i for i, a in enumerate(arrays) if a.name == f.name)] or 0
                columns += [F.get(quoted(f.name), F.lit(i)).alias(f"{f.name}{separator}col{i + 1}") for i in range(width)]
            elif isinstance(f.dataType, T.MapType):
                columns.append(json_of(f).alias(f.name))
            else:
                columns.append(quoted(f.name))
        df = df.select(*columns)
