"""Text forms of documents: compact, pretty in three styles, JSON Lines, INI and YAML."""

from __future__ import annotations

import json
import math
import re


def scalar(v) -> str:
    if v is None:
        return "null"
    if v is True or v is False:
        return str(v).lower()
    if isinstance(v, str):
        return json.dumps(v, ensure_ascii=False)
    if isinstance(v, float):
        if math.isnan(v):
            return "NaN"
        if math.isinf(v):
            return "Infinity" if v > 0 else "-Infinity"
        if v == int(v) and abs(v) < 1e15:
            return f"{v:.1f}"
        return repr(v).replace("e+", "E+").replace("e-", "E-") if "e" in repr(v) else repr(v)
    return str(v)


def sorted_items(v: dict, sort_keys: bool):
    return sorted(v.items(), key=lambda kv: (kv[0].lower(), kv[0].swapcase())) if sort_keys else list(v.items())


def compact(v, sort_keys: bool = True, comma: str = ", ", colon: str = ": ") -> str:
    if isinstance(v, dict):
        return "{" + comma.join(scalar(k) + colon + compact(x, sort_keys, comma, colon) for k, x in sorted_items(v, sort_keys)) + "}"
    if isinstance(v, list):
        return "[" + comma.join(compact(x, sort_keys, comma, colon) for x in v) + "]"
    return scalar(v)


def text_of(v) -> str:
    """A string itself, anything else as compact JSON."""
    return v if isinstance(v, str) else compact(v)


def google(v, sort_keys: bool = True, indent: int = 4, depth: int = 0) -> str:
    """Opening brackets stay on the line of their key."""
    pad, end = " " * indent * (depth + 1), " " * indent * depth
    if isinstance(v, dict) and v:
        return "{\n" + ",\n".join(f"{pad}{scalar(k)}: {google(x, sort_keys, indent, depth + 1)}" for k, x in sorted_items(v, sort_keys)) + f"\n{end}}}"
    if isinstance(v, list) and v:
        return "[\n" + ",\n".join(pad + google(x, sort_keys, indent, depth + 1) for x in v) + f"\n{end}]"
    return compact(v)


def whitesmith(v, sort_keys: bool = True, indent: int = 4, depth: int = 0) -> str:
    """Brackets stand on lines of their own, as deep as what they enclose."""
    pad, inner = " " * indent * depth, " " * indent * (depth + 1)

    def part(x) -> str:
        return "\n" + whitesmith(x, sort_keys, indent, depth + 1) if isinstance(x, (dict, list)) and x else " " + compact(x)

    if isinstance(v, dict) and v:
        return f"{pad}{{\n" + ",\n".join(f"{pad}{scalar(k)}:{part(x)}" for k, x in sorted_items(v, sort_keys)) + f"\n{pad}}}"
    if isinstance(v, list) and v:
        return f"{pad}[\n" + ",\n".join(whitesmith(x, sort_keys, indent, depth + 1) if isinstance(x, (dict, list)) and x else pad + compact(x) for x in v) + f"\n{pad}]"
    del inner
    return pad + compact(v)


def pprint(v, sort_keys: bool = True, indent: int = 4, depth: int = 0, width: int = 79) -> str:
    """Whatever fits the rest of a line is compact."""
    flat = compact(v, sort_keys)
    if not isinstance(v, (dict, list)) or not v or len(flat) + indent * depth <= width:
        return flat
    pad, end = " " * indent * (depth + 1), " " * indent * depth
    if isinstance(v, dict):
        return "{\n" + ",\n".join(f"{pad}{scalar(k)}: {pprint(x, sort_keys, indent, depth + 1, width)}" for k, x in sorted_items(v, sort_keys)) + f"\n{end}}}"
    return "[\n" + ",\n".join(pad + pprint(x, sort_keys, indent, depth + 1, width) for x in v) + f"\n{end}]"


def styled(v, style: str = "m", sort_keys: bool = True, indent: int = 4) -> str:
    """m: most compact; c: compact; g, w, p: pretty."""
    if style == "m":
        return compact(v, sort_keys, ",", ":")
    if style == "c":
        return compact(v, sort_keys)
    return {"g": google, "w": whitesmith, "p": pprint}[style](v, sort_keys, indent)


def commented(v, comments: list, places: dict, indent: int = 4) -> str:
    """Google style with the comments of the source: each on lines of its own, before the node that follows it there, at that node's depth; keys stay in their order. comments and places: see reader.read_commented()."""
    waiting = sorted(comments)

    def due(place: float, pad: str) -> str:
        out = ""
        while waiting and waiting[0][0] < place:
            text = waiting.pop(0)[1].rstrip()
            out += pad + (text if text.startswith("/") else "//" + text[1:]) + "\n"
        return out

    def written(x, keys: tuple, depth: int) -> str:
        if not isinstance(x, (dict, list)) or not x:
            return compact(x, False)
        pad, end = " " * indent * (depth + 1), " " * indent * depth
        pairs = list(x.items()) if isinstance(x, dict) else list(enumerate(x))
        lines = []
        for n, (k, y) in enumerate(pairs):
            before = due(places.get((*keys, k), 0), pad)
            head = f"{scalar(k)}: " if isinstance(x, dict) else ""
            lines.append(f"{before}{pad}{head}{written(y, (*keys, k), depth + 1)}{',' if n + 1 < len(pairs) else ''}\n")
        marks = "{}" if isinstance(x, dict) else "[]"
        return f"{marks[0]}\n{''.join(lines)}{end}{marks[1]}"

    out = due(places.get((), 0), "") + written(v, (), 0)
    return out + ("\n" + due(math.inf, "").rstrip("\n") if waiting else "")


def json_lines(v) -> str:
    return "\n".join(compact(x) for x in (v if isinstance(v, list) else [v]))


def ini(v: dict) -> str:
    """Sections of an object of objects; line ends within values are indented."""
    out = []
    for section, pairs in v.items():
        if not isinstance(pairs, dict):
            raise ValueError("INI needs an object of objects")
        out.append(f"[{section}]")
        out += [f"{k}={text_of(x)}".replace("\n", "\n    ") for k, x in pairs.items()]
    return "\n".join(out) + "\n"


def yaml(v, depth: int = 0) -> str:
    """Block style; strings that another type could be mistaken for are quoted."""
    pad = "    " * depth

    def plain(x) -> str:
        if isinstance(x, float) and (math.isnan(x) or math.isinf(x)):
            return ".nan" if math.isnan(x) else ".inf" if x > 0 else "-.inf"
        if not isinstance(x, str):
            return compact(x)
        odd = not x or x != x.strip() or re.search(r"[:#{}\[\],&*!|>'\"%@`\n\t\\]", x) or x[0] in "-?" or x.lower() in ("true", "false", "null", "yes", "no", "~")
        try:
            float(x)
            odd = True
        except ValueError:
            pass
        return json.dumps(x, ensure_ascii=False) if odd else x

    if isinstance(v, dict) and v:
        return "".join(f"{pad}{plain(k)}:\n{yaml(x, depth + 1)}" if isinstance(x, (dict, list)) and x else f"{pad}{plain(k)}: {plain(x)}\n" for k, x in v.items())
    if isinstance(v, list) and v:
        return "".join(f"{pad}-\n{yaml(x, depth + 1)}" if isinstance(x, (dict, list)) and x else f"{pad}- {plain(x)}\n" for x in v)
    return f"{pad}{plain(v)}\n"


# The words and marks of DSON.
DSON_PAIRS, DSON_ITEMS = (",", ".", "!", "?"), (" and ", " also ")


def dson(v) -> str:
    """Doge serialized object notation. Numbers are octal, part by part (a float's whole part, fraction and exponent each as an integer); infinities and NaN can't be written."""
    def octal(n: int) -> str:
        return "1" + "0" * 21 if n == -(1 << 63) else f"-{-n:o}" if n < 0 else f"{n:o}"

    if isinstance(v, dict):
        pairs = [f"{scalar(k)} is {dson(x)}" for k, x in v.items()]
        return "such " + "".join(p + (DSON_PAIRS[k % 4] + " " if k + 1 < len(pairs) else " ") for k, p in enumerate(pairs)) + "wow"
    if isinstance(v, list):
        items = [dson(x) for x in v]
        return "so " + "".join(x + (DSON_ITEMS[k % 2] if k + 1 < len(items) else " ") for k, x in enumerate(items)) + "many"
    if v is None:
        return "empty"
    if isinstance(v, bool):
        return "yes" if v else "no"
    if isinstance(v, int):
        return octal(v)
    if isinstance(v, float):
        if not math.isfinite(v):
            raise ValueError("DSON has no infinities and no NaN")
        parts = re.fullmatch(r"(-?\d+)(?:\.(\d+))?(?:E([+-]\d+))?", scalar(v).removesuffix(".0"))
        return octal(int(parts[1])) + (f".{octal(int(parts[2]))}" if parts[2] else "") + (f"VERY{octal(int(parts[3]))}" if parts[3] else "")
    return scalar(v)


def nodes(v, above: tuple = ()):
    """Each node of a document with the keys that lead to it, the document first."""
    yield above, v
    if isinstance(v, dict):
        for k, x in v.items():
            yield from nodes(x, (*above, k))
    elif isinstance(v, list):
        for k, x in enumerate(v):
            yield from nodes(x, (*above, k))


def path(keys: list, style: str = "query") -> str:
    """The path to a node: JavaScript, Python or query style."""
    out = ["@"] if style == "query" else []
    for k in keys:
        if isinstance(k, int):
            out.append(f"[{k}]")
        elif re.fullmatch(r"[A-Za-z_$][A-Za-z0-9_$]*", k) and style != "python":
            out.append("." + k)
        elif style == "query":
            out.append("[`" + k.replace("\\", "\\\\").replace("`", "\\`") + "`]")
        else:
            out.append("[" + (json.dumps(k) if style == "javascript" or "'" in k else "'" + k + "'") + "]")
    return "".join(out)
