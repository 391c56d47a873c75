"""Sources: JSON documents, JSON Lines, CSV, INI, text by pattern, whole folders, and URLs."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.dynamic.lane import lints, mapped, ship
from docloom.errors import JsonError, QueryError

#: What a file's suffix says about its kind.
KINDS = {"json": "json", "json5": "json", "jsonc": "json", "jsonl": "jsonl", "ini": "ini", "csv": "csv", "tsv": "csv"}


def texts(spark: SparkSession, path: str, glob: str | None = None, recursive: bool = True) -> DataFrame:
    """path and value (the whole text) of each file."""
    r = spark.read.format("text").option("wholetext", True).option("recursiveFileLookup", recursive)
    if glob:
        r = r.option("pathGlobFilter", glob)
    return r.load(path).select(F.col("_metadata.file_path").alias("path"), "value")


def grep(spark: SparkSession, path: str, patterns: str = "*.json", recursive: bool = True) -> DataFrame:
    """Each file below path whose name fits one of the patterns: path, json (canonical text, null if it can't be read), level and lints."""
    from docloom.sources.globs import matcher

    found = texts(spark, path, None, recursive).where(F.col("path").rlike(matcher(patterns)))
    return lints(found).drop("value")


#: Text that one object of all files may hold.
MOST_COMBINED = 400_000_000


def grep_object(spark: SparkSession, path: str, patterns: str = "*.json", recursive: bool = True, most: int = MOST_COMBINED) -> DataFrame:
    """One row: value, the object (JSON text) of all readable files that grep() finds, by path, to be queried as one document. More than `most` bytes in all are refused; query grep()'s rows then."""
    found = grep(spark, path, patterns, recursive).where("json is not null").select("path", "json")
    size = found.agg(F.sum(F.octet_length("json"))).first()[0] or 0
    if size > most:
        raise QueryError(f"{size} bytes are too many for one object")
    pair = F.concat(F.to_json(F.array("path")).substr(F.lit(2), F.length(F.to_json(F.array("path"))) - 2), F.lit(": "), F.col("json"))
    pairs = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("path", pair.alias("pair")))), lambda x: x["pair"]), ", ")
    return found.agg(F.concat(F.lit("{"), pairs, F.lit("}")).alias("value"))


def json_documents(spark: SparkSession, path: str, schema: str | None = None, whole_files: bool = True) -> DataFrame:
    """Strict or near-strict JSON files as a relation, by Spark's own reader. Without whole_files each line is a document, and large files are split among tasks."""
    r = spark.read.option("multiLine", whole_files).option("allowComments", True).option("allowSingleQuotes", True).option("allowUnquotedFieldNames", True).option("allowNonNumericNumbers", True)
    return (r.schema(schema) if schema else r).json(path)


def json_lines(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    return (spark.read.schema(schema) if schema else spark.read).json(path)


def csv(spark: SparkSession, path: str, columns: int | None = None, delimiter: str | None = None, newline: str | None = None, quote: str = '"', header: bool = True, malformed: str | None = None, line_breaks: bool = True) -> DataFrame:
    """RFC 4180 files as a relation of strings; without a delimiter it is sniffed. Rows of another number of columns are dropped; with malformed, a column of that name, they stay, and it holds their text (null for good rows). line_breaks: quoted values may hold some; where none do, without it, large files are split among tasks."""
    if delimiter is None:
        head = [r[0] for r in spark.read.text(path).limit(SNIFFED_LINES).collect()]
        delimiter = sniff("\n".join(head))[0] or ","
    r = spark.read.option("multiLine", line_breaks).option("sep", delimiter).option("quote", quote).option("escape", quote).option("mode", "DROPMALFORMED").option("header", header)
    if newline:
        r = r.option("lineSep", newline)
    if malformed:
        plain = csv(spark, path, columns, delimiter, newline, quote, header, line_breaks=line_breaks).schema
        return r.option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", malformed).schema(plain.add(malformed, "string")).csv(path)
    if columns and not header:
        r = r.schema(", ".join(f"_c{i} string" for i in range(columns)))
    return r.csv(path)


SNIFFED_LINES, SNIFFED_CHARS = 16, 1600


def column_count(text: str, delimiter: str, newline: str, quote: str = '"') -> int:
    """The number of columns that the first lines agree on, or -1."""
    text = text[:SNIFFED_CHARS]
    counts, n, inside, lines, at = [], 1, False, 0, 0
    while at < len(text) and lines < SNIFFED_LINES:
        c = text[at]
        if c == quote:
            inside = not inside
        elif not inside and text.startswith(newline, at):
            counts.append(n)
            n, lines, at = 1, lines + 1, at + len(newline) - 1
        elif not inside and c == delimiter:
            n += 1
        elif not inside and c in "\r\n":
            return -1
        at += 1
    if at >= len(text) and len(text) < SNIFFED_CHARS and text and not text.endswith(newline):
        counts.append(n)
    return counts[0] if counts and len(set(counts)) == 1 and (len(counts) > 1 or counts[0] > 1) else -1


def sniff(text: str) -> tuple[str | None, str | None, int]:
    """Delimiter, line end and number of columns, of the usual ones; the most columns win."""
    found = [(column_count(text, d, n), d, n) for d in ",\t|;^" for n in ("\r\n", "\n", "\r")]
    n, d, line = max(found, key=lambda x: x[0])
    return (d, line, n) if n > 1 else (None, None, -1)


def ini(text: str) -> dict[str, dict[str, str]]:
    """Sections of keys and values; deeper indented lines go on with a value; ; and # begin comments; duplicates are errors."""
    out: dict[str, dict[str, str]] = {}
    section, key, indent = None, None, 0
    for number, line in enumerate(text.splitlines(), 1):
        bare = line.strip()
        depth = len(line) - len(line.lstrip())
        if not bare or bare[0] in ";#":
            continue
        if key is not None and depth > indent:
            out[section][key] += "\n" + bare
        elif m := re.fullmatch(r"\[([^\]]*)\]\s*(?:[;#].*)?", bare):
            section, key = m[1], None
            if section in out:
                raise JsonError(f"line {number}: the section {section!r} twice")
            out[section] = {}
        elif m := re.match(r"([^=:]+?)\s*[=:]\s*(.*)", bare):
            if section is None:
                raise JsonError(f"line {number}: a key before any section")
            key, indent = m[1], depth
            if key in out[section]:
                raise JsonError(f"line {number}: the key {key!r} twice")
            out[section][key] = m[2]
        else:
            raise JsonError(f"line {number}: neither a section nor a key")
    return out


def ini_files(spark: SparkSession, path: str) -> DataFrame:
    """path, sections (a map of maps) and error of each INI file."""
    def one(text: str | None) -> tuple:
        try:
            return list({k: list(v.items()) for k, v in ini(text or "").items()}.items()), None
        except JsonError as e:
            return None, str(e)

    return mapped(texts(spark, path), "value", one, "sections map<string, map<string, string>>, error string").drop("value")


def by_pattern(df: DataFrame, column: str, pattern: str) -> DataFrame:
    """A row for each match of a pattern in a text column: the groups as _1, _2 and on (or the whole match)."""
    from docloom.functions.scalars import groups_of, java_pattern

    p = java_pattern(pattern)
    n = groups_of(p)
    parts = [F.regexp_extract_all(F.col(column), F.lit(p), F.lit(g)).alias(f"_{i + 1}") for i, g in enumerate(range(1, n + 1) if n else [0])]
    return df.select(F.explode(F.arrays_zip(*parts)).alias("m")).select("m.*")


def urls(df: DataFrame, column: str = "url", timeout: float = 10.0, headers: dict | None = None) -> DataFrame:
    """df with json, level and lints of what each URL answers, and error. Requests go out from the executors."""
    ship(df)
    sent = {"Accept": "application/json", **(headers or {})}

    def one(url: str | None) -> tuple:
        import urllib.request

        from docloom.dynamic import reader, writer

        try:
            with urllib.request.urlopen(urllib.request.Request(url or "", headers=sent), timeout=timeout) as answer:
                return writer.compact(reader.parse(answer.read().decode("utf-8")), False), None
        except (OSError, ValueError) as e:
            return None, f"{type(e).__name__}: {e}"

    return mapped(df, column, one, "json string, error string")


def read(spark: SparkSession, path: str) -> DataFrame:
    """A file or folder by its suffix."""
    kind = KINDS.get(path.rstrip("/").rsplit(".", 1)[-1].lower(), "text")
    return {"json": json_documents, "jsonl": json_lines, "csv": csv, "ini": ini_files, "text": texts}[kind](spark, path)


def embedded(df: DataFrame, column: str, starts: str = '"[{') -> DataFrame:
    from docloom.dynamic.lane import embedded_json

    return embedded_json(df, column, starts)


