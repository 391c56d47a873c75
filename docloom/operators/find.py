"""Find and replace: builds queries."""

from __future__ import annotations


def quoted_text(text: str) -> str:
    return "`" + text.replace("\\", "\\\\").replace("`", "\\`") + "`"


def find_query(what: str, where: str = "values", regex: bool = False, exact: bool = False, ignore_case: bool = False, recursive: bool = True, root: str = "@", math: bool = False) -> str:
    """The query that finds what among keys, values or both below root. math: what is a comparison such as `> 3`."""
    if math:
        values = f"({root}{'..*' if recursive else '.*'})[is_num(@)]"
        return f"({values})[@ {what}]"
    import re

    pattern = what if regex else re.escape(what)
    pattern = f"^(?:{pattern})$" if exact else pattern
    pattern = f"(?i){pattern}" if ignore_case else pattern
    g = "g" + "`" + pattern.replace("`", "\\`") + "`"
    plain = exact and not regex and not ignore_case
    keys = f"{root}{'..' if recursive else '.'}{quoted_text(what) if plain else g}"
    of_values = f"({root}{'..*' if recursive else '.*'})[str(@) {'==' if plain else '=~'} {quoted_text(what) if plain else g}]"
    if where == "keys":
        return keys
    if where == "values":
        return of_values
    return f"concat({keys}, {of_values})"


def replace_query(find: str, what: str, by: str, regex: bool = False) -> str:
    """The query that replaces what by something in all that a find query finds."""
    pattern = ("g" + "`" + what.replace("`", "\\`") + "`") if regex else quoted_text(what)
    return f"var x = {find}; x = s_sub(@, {pattern}, {quoted_text(by)})"
