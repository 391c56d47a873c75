"""Functions of single values as Columns. Each takes and returns (Column, DataType) pairs.

Integers are long and wrap; all other numbers are double; x / 0 is an infinity or NaN; rounding is half to even; null equals
null; a number counts as true unless it is 0, a string or container unless it is empty, null never.
"""

from __future__ import annotations

import json
import re
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.errors import Untyped

LONG, DOUBLE, BOOL, STRING, NULL = T.LongType(), T.DoubleType(), T.BooleanType(), T.StringType(), T.NullType()
# What (INT) and (NUMBER) stand for in patterns (without the group around them).
INT_PATTERN = r"[+-]?(?:0x[\da-fA-F]+|\d+)"
NUMBER_PATTERN = r"[+-]?(?:0x[\da-fA-F]+|\d+(?:\.\d*)?|\.\d+)(?:[eE][+-]?\d+)?"


def wrapped(c: Column) -> Column:
    """A decimal as a long, modulo 2**64."""
    two64 = F.lit(Decimal(1 << 64))
    low = F.pmod(c, two64)
    return F.when(low >= F.lit(Decimal(1 << 63)), low - two64).otherwise(low).cast("long")


def wrapping(op: str, x: Column, y: Column) -> Column:
    """Longs added, subtracted or multiplied, modulo 2**64 whatever the session says of overflow: exactly in decimals where a long doesn't do."""
    a, b = x.cast("decimal(20,0)"), y.cast("decimal(20,0)")
    # products of two longs have 38 digits at most
    plain = {"+": F.try_add, "-": F.try_subtract, "*": F.try_multiply}[op](x, y)
    exact = {"+": lambda: a + b, "-": lambda: a - b, "*": lambda: x.cast("decimal(19,0)") * y.cast("decimal(19,0)")}[op]()
    return F.coalesce(plain, wrapped(exact.cast("decimal(38,0)")))


def is_integer(t: T.DataType) -> bool:
    return isinstance(t, (T.ByteType, T.ShortType, T.IntegerType, T.LongType))


def is_number(t: T.DataType) -> bool:
    """Numbers, among which booleans count."""
    return isinstance(t, (T.NumericType, T.BooleanType))


def is_text(t: T.DataType) -> bool:
    return isinstance(t, (T.StringType, T.DateType, T.TimestampType, T.TimestampNTZType))


def as_long(c: Column, t: T.DataType) -> Column:
    return c if isinstance(t, T.LongType) else c.cast("long")


def as_double(c: Column, t: T.DataType) -> Column:
    return c if isinstance(t, T.DoubleType) else c.cast("int").cast("double") if isinstance(t, T.BooleanType) else c.cast("double")


def as_number(c: Column, t: T.DataType) -> tuple[Column, T.DataType]:
    if isinstance(t, T.BooleanType) or is_integer(t):
        return as_long(c, t), LONG
    if isinstance(t, T.NumericType):
        return as_double(c, t), DOUBLE
    raise Untyped(f"a {t.simpleString()} is no number")


def truthy(c: Column, t: T.DataType) -> Column:
    if isinstance(t, T.BooleanType):
        return F.coalesce(c, F.lit(False))
    if isinstance(t, T.NumericType):
        return F.coalesce(c != 0, F.lit(False))
    if is_text(t):
        return F.coalesce(F.length(c.cast("string")) > 0, F.lit(False))
    if isinstance(t, (T.ArrayType, T.MapType)):
        return F.coalesce(F.size(c) > 0, F.lit(False))
    if isinstance(t, T.StructType):
        return c.isNotNull() & F.lit(len(t.fields) > 0)
    return F.lit(False)


def condition(c: Column, t: T.DataType) -> Column:
    """What truthy() says, as a filter's condition: null may stand for false, so that the scan can have it."""
    if isinstance(t, T.BooleanType):
        return c
    return c != 0 if isinstance(t, T.NumericType) else truthy(c, t)


def double_text(c: Column) -> Column:
    """A double as JSON text: whole numbers end in .0, infinities and NaN are words, and exponents (from 16 digits, or below 1e-4) have a sign and two digits."""
    plain = c.cast("string")
    part = lambda k: F.regexp_extract(plain, r"^(-?)(\d)\.(\d+)E(-?\d+)$", k)
    sign, first, e = part(1), part(2), part(4).try_cast("int")
    rest = F.when(part(3) == "0", F.lit("")).otherwise(part(3))
    digits = F.concat(first, rest)
    mantissa = F.concat(first, F.when(rest == "", F.lit("")).otherwise(F.concat(F.lit("."), rest)))
    power = F.concat(F.when(e < 0, F.lit("E-")).otherwise(F.lit("E+")), F.when(F.abs(e) < 10, F.lit("0")).otherwise(F.lit("")), F.abs(e).cast("string"))
    after = F.when(F.length(digits) > e + 1, F.substring(digits, e + 2, F.lit(20))).otherwise(F.lit("0"))
    large = F.concat(F.rpad(digits, e + 1, F.lit("0")), F.lit("."), after)
    small = F.concat(F.lit("0."), F.repeat(F.lit("0"), F.greatest(F.lit(0), -e - 1)), digits)
    written = F.when((e >= 16) | (e < -4), F.concat(mantissa, power)).when(e > 0, large).otherwise(small)
    return F.when(plain.contains("E"), F.concat(sign, written)).otherwise(plain)


def as_text(c: Column, t: T.DataType) -> Column:
    """The canonical text of a scalar; a string is itself."""
    if isinstance(t, T.BooleanType) or is_integer(t):
        out = c.cast("string")
    elif isinstance(t, T.NumericType):
        out = double_text(as_double(c, t))
    elif is_text(t):
        out = c.cast("string")
    elif isinstance(t, T.NullType):
        return F.lit("null")
    else:
        try:
            out = json_text(c, t, ", ", ": ")
        except Untyped:  # maps
            out = F.to_json(c, {"ignoreNullFields": "false"})
    return F.coalesce(out, F.lit("null"))


def divide(a: Column, b: Column) -> Column:
    at_zero = F.when(F.isnan(a) | (a == 0), F.lit(float("nan"))).when(a > 0, F.lit(float("inf"))).otherwise(F.lit(float("-inf")))
    return F.when(a.isNull() | b.isNull(), F.lit(None).cast("double")).when(b == 0, at_zero).otherwise(a / b)


def binary(op: str, a: tuple[Column, T.DataType], b: tuple[Column, T.DataType]) -> tuple[Column, T.DataType]:
    (x, tx), (y, ty) = a, b
    if op in ("==", "!="):
        if is_number(tx) and is_number(ty) and tx != ty and not (is_integer(tx) and is_integer(ty)):
            x, y = as_double(x, tx), as_double(y, ty)
        elif is_text(tx) != is_text(ty) and not isinstance(tx, T.NullType) and not isinstance(ty, T.NullType):
            raise Untyped(f"a {tx.simpleString()} can't be compared with a {ty.simpleString()}")
        same = x.eqNullSafe(y)
        return (same if op == "==" else ~same), BOOL
    if op in ("<", ">", "<=", ">="):
        if is_number(tx) != is_number(ty) or is_text(tx) != is_text(ty):
            raise Untyped(f"a {tx.simpleString()} can't be compared with a {ty.simpleString()}")
        if is_number(tx) and tx != ty and not (is_integer(tx) and is_integer(ty)):
            x, y = as_double(x, tx), as_double(y, ty)
        out = {"<": x < y, ">": x > y, "<=": x <= y, ">=": x >= y}[op]
        if is_text(tx):  # null is below all strings
            no_x, no_y = x.isNull(), y.isNull()
            out = (~no_x & ~no_y & out) | {"<": no_x & ~no_y, ">": ~no_x & no_y, "<=": no_x, ">=": no_y}[op]
        return out, BOOL
    if op == "=~":
        if not is_text(tx) or not is_text(ty):
            raise Untyped("=~ needs strings")
        return x.cast("string").rlike(y), BOOL
    if op == "+" and is_text(tx) and is_text(ty):
        return F.concat(x, y), STRING
    if op == "*" and is_text(tx) and (is_integer(ty) or isinstance(ty, T.BooleanType)):
        return F.repeat(x, F.greatest(as_long(y, ty), F.lit(0)).cast("int")), STRING
    if op in ("&", "|", "^"):
        if isinstance(tx, T.BooleanType) and isinstance(ty, T.BooleanType):
            return {"&": x & y, "|": x | y, "^": x != y}[op], BOOL
        if not (is_integer(tx) or isinstance(tx, T.BooleanType)) or not (is_integer(ty) or isinstance(ty, T.BooleanType)):
            raise Untyped(f"{op} needs integers or booleans")
        x, y = as_long(x, tx), as_long(y, ty)
        return {"&": x.bitwiseAND(y), "|": x.bitwiseOR(y), "^": x.bitwiseXOR(y)}[op], LONG
    (x, tx), (y, ty) = as_number(x, tx), as_number(y, ty)
    both_long = tx == ty == LONG
    if op == "/":
        return divide(as_double(x, tx), as_double(y, ty)), DOUBLE
    if op == "**":
        return F.pow(as_double(x, tx), as_double(y, ty)), DOUBLE
    zero = F.raise_error(F.lit("division by zero"))
    if op == "//":
        return F.when(y == 0, zero.cast("long")).otherwise(F.floor(as_double(x, tx) / as_double(y, ty)).cast("long")), LONG
    if not both_long:
        x, y = as_double(x, tx), as_double(y, ty)
    if op == "%":
        at_zero = zero.cast("long") if both_long else F.lit(float("nan"))
        return F.when(y == 0, at_zero).otherwise(x % y), LONG if both_long else DOUBLE
    if both_long:
        return wrapping(op, x, y), LONG
    return {"+": x + y, "-": x - y, "*": x * y}[op], DOUBLE


def unary(op: str, a: tuple[Column, T.DataType]) -> tuple[Column, T.DataType]:
    if op == "not":
        return ~truthy(*a), BOOL
    c, t = as_number(*a)
    if op == "+":
        return c, t
    return (wrapping("-", F.lit(0).cast("long"), c), t) if t == LONG else (-c, t)


def java_pattern(pattern: str, macros: bool = True) -> str:
    """A pattern for Spark: ^ and $ at lines, and what (INT) and (NUMBER) stand for."""
    if macros:
        for name, stands in (("INT", INT_PATTERN), ("NUMBER", NUMBER_PATTERN)):
            pattern = pattern.replace(f"(?:{name})", f"(?:{stands})").replace(f"({name})", f"({stands})")
    return pattern if pattern.startswith("(?m)") else "(?m)" + pattern


def groups_of(pattern: str) -> int:
    return re.compile(re.sub(r"\\p\{\w+\}", "x", pattern)).groups


def half_even(c: Column, places: int = 0) -> Column:
    return F.when(F.isnan(c) | (F.abs(c) == float("inf")), c).otherwise(F.bround(c, places)) if places else F.rint(c)


def parse_number(c: Column) -> Column:
    """A string as a double: decimal, or 0x hexadecimal with a sign."""
    sign = F.when(c.startswith("-"), F.lit(-1.0)).otherwise(F.lit(1.0))
    hexadecimal = F.regexp_extract(c, r"^[+-]?0[xX]([0-9a-fA-F]+)$", 1)
    return F.when(hexadecimal != "", sign * F.conv(hexadecimal, 16, 10).cast("double")).otherwise(c.cast("double"))


def utf16_length(c: Column) -> Column:
    return (F.octet_length(F.encode(c, "UTF-16BE")) / 2).cast("long")


def logarithm(c: Column, base: float | None = None) -> Column:
    ln = F.log(c) if base is None else F.log(c) / F.log(F.lit(float(base)))
    return F.when(c.isNull(), F.lit(None).cast("double")).when(c == 0, F.lit(float("-inf"))).when(c < 0, F.lit(float("nan"))).otherwise(ln)


def padded(c: Column, pad: str, n: int, left: bool) -> Column:
    """Whole copies of pad until the length is at least n."""
    copies = F.greatest(F.lit(0), F.ceil((F.lit(n) - F.length(c)) / F.lit(max(1, len(pad))))).cast("int")
    more = F.repeat(F.lit(pad), copies)
    return F.concat(more, c) if left else F.concat(c, more)


#: Characters whose upper case is several characters, by Unicode's rules: they stay as they are.
GROWING = "".join(c for c in map(chr, range(0x80, 0x10000)) if len(c.upper()) > 1)


def upper(c: Column) -> Column:
    slow = F.array_join(F.transform(F.split(c, ""), lambda x: F.when(x.rlike(f"[{GROWING}]"), x).otherwise(F.upper(x))), "")
    return F.when(c.rlike(f"[{GROWING}]"), slow).otherwise(F.upper(c))


def key_order(name: str) -> tuple[str, str]:
    return name.lower(), name.swapcase()


def json_text(c: Column, t: T.DataType, comma: str = ",", colon: str = ":", sort_keys: bool = True) -> Column:
    """JSON text of a value of any type without maps: null keys stay, and numbers have their canonical text."""
    null = F.lit("null")
    if isinstance(t, T.StructType):
        fields = sorted(t.fields, key=lambda f: key_order(f.name)) if sort_keys else t.fields
        parts = []
        for k, f in enumerate(fields):
            parts += [F.lit((comma if k else "") + json.dumps(f.name, ensure_ascii=False) + colon), json_text(c.getField(f.name), f.dataType, comma, colon, sort_keys)]
        return F.when(c.isNull(), null).otherwise(F.concat(F.lit("{"), *parts, F.lit("}")))
    if isinstance(t, T.ArrayType):
        inner = F.array_join(F.transform(c, lambda x: json_text(x, t.elementType, comma, colon, sort_keys)), comma)
        return F.when(c.isNull(), null).otherwise(F.concat(F.lit("["), inner, F.lit("]")))
    if isinstance(t, T.MapType):
        raise Untyped("JSON text of a map")
    if is_text(t):
        quoted = F.to_json(F.array(c.cast("string")))
        return F.when(c.isNull(), null).otherwise(F.substring(quoted, F.lit(2), F.length(quoted) - 2))
    return as_text(c, t)
