"""Sinks: documents in the text forms of the writer, relations as CSV and JSON Lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.dynamic.lane import mapped
from docloom.errors import JsonError
from docloom.plans.typed import quoted

STYLES = ("m", "c", "g", "w", "p", "yaml", "ini", "lines", "dson")


def formatted(documents: DataFrame, style: str = "c", sort_keys: bool = True, indent: int = 4, column: str = "value") -> DataFrame:
    """documents with text: each one in a style (m, c, g, w, p, yaml, ini, lines, dson); null for what can't be read or written so."""
    if style not in STYLES:
        raise ValueError(f"unknown style {style!r}")

    def one(text: str | None) -> tuple:
        from docloom.dynamic import reader, writer

        if text is None:
            return (None,)
        try:
            v = reader.parse(text)
            if style in ("yaml", "ini", "lines", "dson"):
                return ({"yaml": writer.yaml, "ini": writer.ini, "lines": writer.json_lines, "dson": writer.dson}[style](v),)
            return (writer.styled(v, style, sort_keys, indent),)
        except (JsonError, ValueError):
            return (None,)

    return mapped(documents, column, one, "text string")


def write_csv(df: DataFrame, path: str, delimiter: str = ",", quote: str = '"', header: bool = True, bools_as_ints: bool = False, mode: str = "errorifexists") -> None:
    """A flat relation as CSV, its columns in sorted order; nulls are empty."""
    columns = [quoted(c).cast("int").alias(c) if bools_as_ints and dict(df.dtypes)[c] == "boolean" else quoted(c) for c in sorted(df.columns)]
    df.select(*columns).write.mode(mode).option("sep", delimiter).option("quote", quote).option("escape", quote).option("header", header).option("emptyValue", "").csv(path)


def write_json_lines(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).json(path)


def to_json_strings(df: DataFrame, column: str) -> DataFrame:
    """A text column as JSON strings."""
    text = f"to_json(named_struct('v', `{column}`))"
    return df.withColumn(column, F.expr(f"substring({text}, 6, length({text}) - 6)"))


def from_json_strings(df: DataFrame, column: str) -> DataFrame:
    """JSON strings as text."""
    return df.withColumn(column, F.from_json(F.concat(F.lit('{"v":'), F.col(column), F.lit("}")), "v string").getField("v"))
