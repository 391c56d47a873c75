"""Regular expressions of the dynamic lane: patterns of the query language, compiled once."""

from __future__ import annotations

from functools import lru_cache

import regex

from docloom.functions.scalars import INT_PATTERN, NUMBER_PATTERN


@lru_cache(maxsize=512)
def compiled(pattern: str, lines: bool, macros: bool = False):
    """lines: ^ and $ match at lines; macros: (INT) and (NUMBER) stand for their patterns."""
    if macros:
        for name, stands in (("INT", INT_PATTERN), ("NUMBER", NUMBER_PATTERN)):
            pattern = pattern.replace(f"(?:{name})", f"(?:{stands})").replace(f"({name})", f"({stands})")
    return regex.compile(pattern, regex.MULTILINE if lines else 0)


def template(by: str) -> str:
    """A replacement with $1 or ${1} as this library writes it."""
    out = by.replace("\\", "\\\\")
    out = regex.sub(r"\$\{(\w+)\}", r"\\g<\1>", out)
    return regex.sub(r"\$(\d)", r"\\g<\1>", out)


@lru_cache(maxsize=128)
def csv_row(columns: int, delimiter: str = ",", newline: str = "\r\n", quote: str = '"') -> str:
    """The pattern of a record of so many fields, a group each, after RFC 4180: a field is quoted, with quotes doubled inside, or plain up to the delimiter. Other than there, the marks can be chosen, a plain field may have quotes behind its first character, and the last record may end with the text."""
    d, q = regex.escape(delimiter, special_only=True), regex.escape(quote, special_only=True)
    plain = f"(?:[^{q}{d}\\r\\n][^{d}\\r\\n]*)?"
    field = f"({q}(?:{q}{q}|[^{q}])*{q}|{plain})"
    breaks = {"\r": "\\r", "\n": "\\n"}
    end = "".join(breaks.get(c, regex.escape(c)) for c in newline)
    # a record starts where nothing but a line's end stands before
    return f"(?<![^{breaks.get(newline[-1], regex.escape(newline[-1]))}])" + d.join([field] * columns) + f"(?:{end}|\\z)"
