"""Runs a query on each document of a DataFrame, on the executors."""

from __future__ import annotations

from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.errors import JsonError, QueryError


def root() -> str:
    """The folder that this package stands in."""
    return str(Path(__file__).resolve().parents[2])


def ship(df: DataFrame) -> None:
    """Let Python workers find this package where it stands beside the driver."""
    df.sparkSession.sparkContext.environment.setdefault("PYTHONPATH", root())


def mapped(df: DataFrame, column: str, f, fields: str) -> DataFrame:
    """df with the fields that f (text -> tuple of values) makes of a string column."""
    ship(df)
    added = T.StructType.fromDDL(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        for b in batches:
            rows = [f(x) for x in b.column(b.schema.get_field_index(column)).to_pylist()]
            for k, field in enumerate(added.fields):
                b = b.append_column(field.name, pa.array([r[k] for r in rows], to_arrow_type(field.dataType)))
            yield b

    return df.mapInArrow(run, T.StructType([*df.schema.fields, *added.fields]))


def run(query: str, documents: DataFrame, column: str = "value") -> DataFrame:
    """documents with result (compact JSON text, null on an error) and error."""
    from docloom.plans.parser import parse

    parse(query)  # errors in the query itself come here, not on the executors

    def one(text: str | None) -> tuple:
        from docloom.dynamic.evaluator import evaluate_text

        if text is None:
            return None, "no document"
        try:
            return evaluate_text(query, text), None
        except (QueryError, JsonError) as e:
            return None, str(e)

    return mapped(documents, column, one, "result string, error string")


def lints(documents: DataFrame, column: str = "value") -> DataFrame:
    """documents with the canonical JSON text, the strictest level at which it can be read, and the lints."""
    def one(text: str | None) -> tuple:
        from docloom.dynamic import reader, writer

        if text is None:
            return None, None, []
        try:
            value, found, _ = reader.read(text)
            return writer.compact(value, False), reader.LEVELS[max((x.level for x in found), default=0)], [f"{reader.LEVELS[x.level]} at {x.at}: {x.message}" for x in found]
        except JsonError as e:
            return None, "FATAL", [str(e)]

    return mapped(documents, column, one, "json string, level string, lints array<string>")


def embedded_json(texts: DataFrame, column: str = "value", starts: str = '"[{') -> DataFrame:
    """A row for each JSON value found in a text column: the other columns, start, end and json."""
    def one(text: str | None) -> tuple:
        from docloom.dynamic import reader, writer

        return ([{"start": a, "end": b, "json": writer.compact(v, False)} for a, b, v in reader.embedded(text or "", starts)],)

    found = mapped(texts, column, one, "found array<struct<start: long, end: long, json: string>>")
    return found.select(*(F.col(f"`{c}`") for c in texts.columns if c != column), F.explode("found").alias("found")).select("*", "found.*").drop("found")


def node_paths(documents: DataFrame, column: str = "value", style: str = "query", scalars_only: bool = False) -> DataFrame:
    """A row for each node of each document (JSON text): the other columns, path (query, javascript or python style), kind and json. Unreadable documents have no nodes."""
    def one(text: str | None) -> tuple:
        from docloom.dynamic import reader, writer
        from docloom.dynamic.evaluator import kind_of

        try:
            v = reader.parse(text or "")
        except JsonError:
            return ([],)
        return ([{"path": writer.path(list(keys), style), "kind": kind_of(x), "json": writer.compact(x, False)} for keys, x in writer.nodes(v) if not (scalars_only and isinstance(x, (dict, list)))],)

    found = mapped(documents, column, one, "nodes array<struct<path: string, kind: string, json: string>>")
    return found.select(*(F.col(f"`{c}`") for c in documents.columns if c != column), F.explode("nodes").alias("node")).select("*", "node.*").drop("node")


def selections(texts: DataFrame, column: str = "value", spans: str = "spans") -> DataFrame:
    """texts with document (JSON text) and error: the parts of each text that spans (array of structs start, end; in characters) select, each read as JSON of its own, as one object by `start,end`."""
    def one(text: str | None) -> tuple:
        from docloom.dynamic import reader, writer

        if text is None:
            return None, "no text"
        head, _, body = text.partition("\0")
        out = {}
        for span in filter(None, head.split(";")):
            a, b = map(int, span.split(","))
            try:
                out[span] = reader.parse(body[a:b])
            except JsonError as e:
                return None, f"{span}: {e}"
        return writer.compact(out, False), None

    marks = F.array_join(F.transform(spans, lambda x: F.concat(x["start"].cast("string"), F.lit(","), x["end"].cast("string"))), ";")
    both = texts.withColumn("__marked", F.when(F.col(column).isNotNull(), F.concat(F.coalesce(marks, F.lit("")), F.lit("\0"), F.col(column))))
    return mapped(both, "__marked", one, "document string, error string").drop("__marked")
