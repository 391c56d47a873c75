"""Documents to tables, and tables to CSV, in the dynamic lane."""

from __future__ import annotations

from docloom.dynamic import writer
from docloom.errors import QueryError


def is_scalar(v) -> bool:
    return not isinstance(v, (list, dict))


def is_row(v) -> bool:
    return isinstance(v, dict) and all(is_scalar(x) or isinstance(x, list) and all(map(is_scalar, x)) for x in v.values())


def kind(v) -> str:
    """rec: array of flat objects; sqr: array of arrays of scalars; tab: object with arrays of scalars; or nothing."""
    if isinstance(v, list) and v:
        if all(is_row(x) for x in v):
            return "rec"
        if all(isinstance(x, list) and all(map(is_scalar, x)) for x in v):
            return "sqr"
    if isinstance(v, dict) and any(isinstance(x, list) for x in v.values()) and is_row(v):
        return "tab"
    return ""


def paths(v, at: tuple = ()) -> set[tuple]:
    """The paths to all tables in a document; elements of an array share a path."""
    if kind(v):
        return {at}
    if isinstance(v, list):
        return {p for x in v for p in paths(x, (*at, 0))}
    if isinstance(v, dict):
        return {p for k, x in v.items() for p in paths(x, (*at, k))}
    return set()


def spread(row: dict) -> list[dict]:
    """A row for each position of its arrays; short ones are filled with empty strings."""
    arrays = {k: x for k, x in row.items() if isinstance(x, list)}
    if not arrays:
        return [row]
    n = max(1, *map(len, arrays.values()), 1)
    return [{k: (x[i] if i < len(x) else "") if isinstance(x, list) else x for k, x in row.items()} for i in range(n)]


def hanging(v: dict, without: str, separator: str) -> dict:
    out = {}
    for k, x in v.items():
        if k == without:
            continue
        parts = {k: x} if is_scalar(x) else {f"{k}{separator}{j}": y for j, y in x.items() if is_scalar(y)} if isinstance(x, dict) else {}
        for n, y in parts.items():
            if n in out:
                raise QueryError(f"two columns would be called {n!r}")
            out[n] = y
    return out


def to_table(v, strategy: str = "d", separator: str = ".") -> list[dict]:
    if strategy == "s":
        rows = v if isinstance(v, list) else [v]
        return [{k: x if is_scalar(x) else writer.compact(x) for k, x in (r.items() if isinstance(r, dict) else ((f"col{i + 1}", y) for i, y in enumerate(r)))} for r in rows]
    if strategy == "r":
        if not isinstance(v, list):
            raise QueryError("an array expected")

        def leaves(x, name: str) -> dict:
            if is_scalar(x):
                return {name: x}
            parts = x.items() if isinstance(x, dict) else ((f"col{i + 1}", y) for i, y in enumerate(x))
            return {n: z for k, y in parts for n, z in leaves(y, f"{name}{separator}{k}" if name else k).items()}

        return [leaves(x, "") for x in v]
    if strategy == "n" and not kind(v):
        raise QueryError("the document isn't a table")
    found = {tuple(0 if isinstance(k, int) else k for k in p) for p in paths(v)}
    if len(found) > 1:
        raise QueryError("several tables in the document")
    if not found:
        return []
    path = next(iter(found))

    def down(x, at: tuple, carried: dict, prefix: str) -> list[dict]:
        if not at:
            name = lambda k: f"{prefix}{separator}{k}" if prefix else k
            if kind(x) == "sqr":
                return [carried | {name(f"col{i + 1}"): y for i, y in enumerate(r)} for r in x]
            return [carried | {name(k): y for k, y in r.items()} for row in (x if isinstance(x, list) else [x]) for r in spread(row)]
        if at[0] == 0 and isinstance(x, list):
            return [r for y in x for r in down(y, at[1:], carried, prefix)]
        if not isinstance(x, dict) or at[0] not in x:
            return []
        beside = {f"{prefix}{separator}{k}" if prefix else k: y for k, y in hanging(x, at[0], separator).items()}
        return down(x[at[0]], at[1:], carried | beside, at[0])

    return down(v, path, {}, "")


def cell(v, delimiter: str, newline: str, quote: str) -> str:
    text = "" if v is None else writer.text_of(v)
    if any(c in text for c in (delimiter, quote, "\n", "\r")):
        return quote + text.replace(quote, quote * 2) + quote
    return text


def rows_to_csv(v, delimiter: str = ",", newline: str = "\r\n", quote: str = '"') -> str:
    """An array of objects (the first one's keys are the header), of arrays, or of scalars (one column; no line end at the end)."""
    if not isinstance(v, list) or not v:
        raise QueryError("an array with rows expected")
    line = lambda xs: delimiter.join(cell(x, delimiter, newline, quote) for x in xs)
    if isinstance(v[0], dict):
        lines = [line(v[0]), *(line(r.values()) for r in v)]
        one = len(v[0]) == 1
    elif isinstance(v[0], list):
        lines, one = [line(r) for r in v], len(v[0]) == 1
    else:
        lines, one = [line([r]) for r in v], True
    return newline.join(lines) + ("" if one else newline)


def table_to_csv(rows: list[dict], header: list[str] | None = None, delimiter: str = ",", newline: str = "\n", quote: str = '"', bools_as_ints: bool = False) -> str:
    """Rows with keys that may differ: the header is their sorted union unless it is given, missing values are empty."""
    header = header or sorted({k for r in rows for k in r})
    value = lambda x: int(x) if bools_as_ints and isinstance(x, bool) else x
    lines = [delimiter.join(cell(h, delimiter, newline, quote) for h in header)]
    lines += [delimiter.join(cell(value(r.get(h)), delimiter, newline, quote) for h in header) for r in rows]
    return newline.join(lines)
