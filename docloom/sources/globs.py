"""File name patterns: lists of simple patterns, and an algebra of them."""

from __future__ import annotations

import re

from docloom.errors import QueryError


def one(pattern: str) -> str:
    """A pattern's regular expression: * and ? within a folder, ** across folders, [..] and {a,b}. Without a slash only the name counts."""
    out, at = [], 0
    while at < len(pattern):
        c = pattern[at]
        if pattern.startswith("**", at):
            out.append(".*")
            at += 1
        elif c == "*":
            out.append(r"[^/\\]*")
        elif c == "?":
            out.append(r"[^/\\]")
        elif c == "[" and "]" in pattern[at:]:
            end = pattern.index("]", at)
            body = pattern[at + 1 : end]
            out.append("[" + ("^" + body[1:] if body[:1] == "!" else body).replace("\\", "\\\\") + "]")
            at = end
        elif c == "{" and "}" in pattern[at:]:
            end = pattern.index("}", at)
            out.append("(?:" + "|".join(one_part(p) for p in pattern[at + 1 : end].split(",")) + ")")
            at = end
        elif c in "/\\":
            out.append(r"[/\\]")
        else:
            out.append(re.escape(c))
        at += 1
    return ("" if "/" in pattern or "\\" in pattern else r"(?:^|.*[/\\])") + "".join(out) + "$"


def one_part(p: str) -> str:
    return re.escape(p).replace(r"\*", r"[^/\\]*").replace(r"\?", r"[^/\\]")


def matcher(lines: str) -> str:
    """One regular expression, ignoring case, for patterns of which any may match; one a line."""
    return "(?i)" + "|".join(f"(?:{one(p.strip())})" for p in lines.splitlines() if p.strip())


def compiled(expression: str):
    """A test of names from an algebra: patterns side by side must all match; `|` between alternatives; `!` before what must not match; `<` and `>` around groups."""
    tokens = re.findall(r"[<>|!]|[^\s<>|!]+", expression)
    at = 0

    def any_of():
        nonlocal at
        parts = [all_of()]
        while at < len(tokens) and tokens[at] == "|":
            at += 1
            parts.append(all_of())
        return lambda name: any(p(name) for p in parts)

    def all_of():
        parts = [term()]
        while at < len(tokens) and tokens[at] not in "|>":
            parts.append(term())
        return lambda name: all(p(name) for p in parts)

    def term():
        nonlocal at
        if at >= len(tokens):
            raise QueryError("a pattern is missing")
        token = tokens[at]
        at += 1
        if token == "!":
            inner = term()
            return lambda name: not inner(name)
        if token == "<":
            inner = any_of()
            if at >= len(tokens) or tokens[at] != ">":
                raise QueryError("a group isn't closed")
            at += 1
            return inner
        p = re.compile("(?i)" + one(token))
        return lambda name: p.search(name) is not None

    out = any_of()
    if at < len(tokens):
        raise QueryError(f"{tokens[at]!r} is left over")
    return out
