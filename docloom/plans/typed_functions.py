"""The query language's functions in the typed lane: over relations (as aggregates and DataFrame operations), over arrays
(as higher-order functions) and over single values."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf
from pyspark.sql.window import Window

from docloom.errors import QueryError, Untyped
from docloom.functions import scalars as s
from docloom.plans import tree as t
from docloom.plans.typed import ABSENT, Aggregate, Compiler, Groups, Lookup, Member, Order, Relation, Row, Value, constant, indexed, joined, quoted, relation, scalar_relation


def known(v, what: str):
    """What an argument says, which must be a constant."""
    if isinstance(v, Value) and v.known is not ABSENT:
        return v.known.pattern if isinstance(v.known, t.Regex) else v.known
    raise Untyped(f"{what} must be a constant")


def call(c: Compiler, node: t.Call, at):
    name = node.name
    if node.spread:
        raise Untyped("a spread argument")
    if name in ("and", "or"):
        return logical(c, node, at)
    if name in ("sort_by", "max_by", "min_by") and not isinstance(node.args[1], t.Literal):
        return by_callback(c, node, at)
    if name == "s_sub" and t.mentions_input(node.args[2]):
        p = c.eval(node.args[1], at)
        return c.lift(lambda x: in_python("s_sub", x, s.STRING, p.known, callback=node.args[2]), c.eval(node.args[0], at))
    if name == "s_slice" and isinstance(node.args[1], t.Slice):
        place = node.args[1].parts
        return c.lift(lambda x: sliced(x, place), c.eval(node.args[0], at))
    args = [None if isinstance(a, t.Literal) and a.value is None and i else c.eval(a, at) for i, a in enumerate(node.args)]
    if name in AGGREGATES:
        return aggregate(c, name, args[0])
    if name in WHOLE:
        return WHOLE[name](c, *args)
    if name in ELEMENTS:
        f = ELEMENTS[name]
        rest = args[1:]
        if any(isinstance(r, (Relation, Groups)) for r in rest) and name != "ifelse":
            raise Untyped(f"{name} with a relation as a later argument")
        if name == "ifelse":
            return c.lift(lambda *xs: f(*xs), *args)
        return c.lift(lambda x: f(x, *rest), args[0])
    raise Untyped(f"{name} in the typed lane")


def logical(c: Compiler, node: t.Call, at):
    """Later arguments are evaluated only if they are needed, as branches of a CASE."""
    values = [c.eval(a, at) for a in node.args]

    def one(*xs: Value) -> Value:
        out = None
        for x in reversed(xs):
            true = s.truthy(*x.pair)
            if out is None:
                out = true
            else:
                out = F.when(~true, F.lit(False)).otherwise(out) if node.name == "and" else F.when(true, F.lit(True)).otherwise(out)
        return Value(out, s.BOOL)

    if any(isinstance(v, Relation) for v in values):
        raise Untyped(f"{node.name} of whole relations")
    return one(*(c.in_row(v) for v in values))


# --- aggregates

def not_nan(v: Value) -> Column:
    x = s.as_double(*v.pair)
    return F.when(~F.isnan(x), x)


#: Of a relation's items; empty input and NaN as the language has them.
AGGREGATES = {
    "len": lambda v: (F.count(F.lit(1)), s.LONG),
    "sum": lambda v: (F.coalesce(F.sum(s.as_double(*v.pair)), F.lit(0.0)), s.DOUBLE),
    "mean": lambda v: (F.coalesce(F.avg(s.as_double(*v.pair)), F.lit(float("nan"))), s.DOUBLE),
    "avg": lambda v: (F.coalesce(F.avg(s.as_double(*v.pair)), F.lit(float("nan"))), s.DOUBLE),
    "max": lambda v: (F.coalesce(F.max(not_nan(v)), F.lit(float("-inf"))), s.DOUBLE),
    "min": lambda v: (F.coalesce(F.min(not_nan(v)), F.lit(float("inf"))), s.DOUBLE),
    "all": lambda v: (F.coalesce(F.bool_and(v.c), F.lit(True)), s.BOOL),
    "any": lambda v: (F.coalesce(F.bool_or(v.c), F.lit(False)), s.BOOL),
}


def of_array(name: str, v: Value) -> Value:
    """An aggregate of an array."""
    a = v.c
    if name == "len":
        return Value(F.size(a).cast("long"), s.LONG)
    if name in ("all", "any"):
        return Value(F.forall(a, lambda x: x) if name == "all" else F.exists(a, lambda x: x), s.BOOL)
    if not s.is_number(v.type.elementType):
        raise Untyped(f"{name} of an array of {v.type.elementType.simpleString()}")
    d = F.transform(a, lambda x: s.as_double(x, v.type.elementType))
    total = F.aggregate(d, F.lit(0.0), lambda x, y: x + y)
    if name == "sum":
        return Value(total, s.DOUBLE)
    if name in ("mean", "avg"):
        return Value(F.when(F.size(a) > 0, total / F.size(a)).otherwise(F.lit(float("nan"))), s.DOUBLE)
    numbers = F.filter(d, lambda x: ~F.isnan(x))
    if name == "max":
        return Value(F.coalesce(F.array_max(numbers), F.lit(float("-inf"))), s.DOUBLE)
    return Value(F.coalesce(F.array_min(numbers), F.lit(float("inf"))), s.DOUBLE)


def aggregate(c: Compiler, name: str, x):
    if isinstance(x, Unique) and name == "len":
        return Aggregate(x.df, F.count_distinct(x.item.c) + F.max(x.item.c.isNull()).cast("long"), s.LONG, x.source, x.joins)
    if isinstance(x, Relation):
        if name not in ("len", "all", "any") and not s.is_number(x.item.type):
            raise Untyped(f"{name} of {x.item.type.simpleString()}")
        column, kind = AGGREGATES[name](x.item)
        return Aggregate(x.df, column, kind, x.origin, x.joins)
    if isinstance(x, Value) and isinstance(x.type, T.ArrayType):
        return of_array(name, x)
    if isinstance(x, Value) and name == "len" and isinstance(x.type, T.MapType):
        return Value(F.size(x.c).cast("long"), s.LONG)
    if isinstance(x, Value) and name == "len" and isinstance(x.type, T.StructType):
        return constant(len(x.type.fields))
    raise Untyped(f"{name} of that")


# --- whole arguments

class Unique(Relation):
    """A relation of distinct values that still knows where they come from, so that their number is one distinct count."""

    source: object = None


def key_of(x: Relation, key) -> tuple[str, Value]:
    """The name and the value of a key (a string or a position) of a relation's items."""
    k = known(key, "a key")
    if isinstance(k, str) and isinstance(x.item.type, T.StructType):
        if k not in x.item.type.fieldNames():
            raise QueryError(f"no key {k!r}")
        kind = x.item.type[k].dataType
        return k, Value(quoted(k) if isinstance(x.item, Row) else x.item.c.getField(k), kind)
    if isinstance(k, int) and isinstance(x.item.type, T.StructType):
        name = x.item.type.fieldNames()[k]
        return key_of(x, constant(name))
    if isinstance(k, int) and isinstance(x.item.type, T.ArrayType):
        return str(k), Value(F.try_element_at(x.item.c, F.lit(k + 1 if k >= 0 else k)), x.item.type.elementType)
    raise Untyped(f"a key {k!r} of that")


def group_by(c: Compiler, x, key):
    if not isinstance(x, Relation):
        raise Untyped("group_by of other than a relation")
    k = known(key, "a key")
    pairs = [key_of(x, constant(i)) for i in (k if isinstance(k, list) else [k])]
    return Groups(x, tuple(n for n, _ in pairs), tuple(v for _, v in pairs))


def sort_keys(v: Value, descending: bool) -> tuple:
    """NaN sorts lowest."""
    if isinstance(v.type, (T.DoubleType, T.FloatType)):
        keys = (~F.isnan(v.c), v.c)
    else:
        keys = (v.c,)
    return tuple(Order(k, descending) for k in keys)


def sort_by(c: Compiler, x, key, descending=None):
    down = bool(known(descending, "the direction")) if descending is not None else False
    if isinstance(x, Relation):
        _, v = key_of(x, key)
        before = tuple(o.reversed for o in x.order) if down else x.order
        return Relation(x.df, x.item, object(), (*sort_keys(v, down), *before), x.joins)
    raise Untyped("sort_by of an array")


def sorted_(c: Compiler, x, descending=None):
    down = bool(known(descending, "the direction")) if descending is not None else False
    if isinstance(x, Relation):
        return Relation(x.df, x.item, object(), sort_keys(x.item, down), x.joins)
    if isinstance(x, Value) and isinstance(x.type, T.ArrayType):
        return Value(F.sort_array(x.c, not down), x.type)
    raise Untyped("sorted of a scalar")


def by_callback(c: Compiler, node: t.Call, at):
    x = c.eval(node.args[0], at)
    if not isinstance(x, Relation):
        raise Untyped(f"{node.name} with a callback on an array")
    v = c.eval(node.args[1], x.item)
    if node.name == "sort_by":
        down = bool(known(c.eval(node.args[2], at), "the direction")) if len(node.args) > 2 else False
        return Relation(x.df, x.item, object(), (*sort_keys(v, down), *((o.reversed for o in x.order) if down else x.order)), x.joins)
    return best(x, v, node.name == "max_by")


def best(x: Relation, v: Value, most: bool) -> Aggregate:
    """The row with the largest or smallest key; the least row (by all columns) among ties, as rows have no order."""
    if not s.is_number(v.type):
        raise Untyped("a key that is no number")
    k = s.as_double(*v.pair)
    whole = x.item.c
    ties = F.struct((-k if most else k).alias("k"), whole.alias("r"))
    out = F.min(F.when(k.isNotNull(), ties)).getField("r")
    return Aggregate(x.df, out, x.item.type, x.origin, x.joins)


def extreme(most: bool):
    def run(c: Compiler, x, key):
        if isinstance(x, Relation):
            return best(x, key_of(x, key)[1], most)
        k = known(key, "a key")
        element = x.type.elementType
        v = (lambda e: e.getField(k)) if isinstance(k, str) else (lambda e: F.try_element_at(e, F.lit(k + 1 if k >= 0 else k)))
        kind = element[k].dataType if isinstance(k, str) else element.elementType
        keyed = F.transform(x.c, lambda e, i: F.struct((s.as_double(v(e), kind) * (-1 if most else 1)).alias("k"), i.alias("i"), e.alias("e")))
        return Value(F.array_min(keyed).getField("e"), element)

    return run


def distinct(c: Compiler, x, ordered=None):
    if isinstance(x, Relation):
        if isinstance(x.item.type, (T.ArrayType, T.MapType, T.StructType)):
            raise QueryError("unique takes scalars only")
        df = joined(x.df, x.joins).select(x.item.c.alias("value")).distinct()
        out = Unique(df, Value(F.col("value"), x.item.type), object(), (Order(F.col("value")),) if ordered is not None and known(ordered, "the order") else ())
        # its length is one distinct count over the rows before
        out.df, out.joins, out.source = (x.df, x.joins, x.origin) if x.grouped else (df, [], None)
        if x.grouped:
            out.item = x.item
        else:
            out.source = out.origin
        return out
    if isinstance(x, Value) and isinstance(x.type, T.ArrayType):
        out = F.array_distinct(x.c)
        return Value(F.array_sort(out) if ordered is not None and known(ordered, "the order") else out, x.type)
    raise Untyped("unique of a scalar")


def as_set(c: Compiler, x):
    """The canonical texts of the values, each once: the keys of an object whose values are null; a relation of them."""
    if isinstance(x, Relation):
        return scalar_relation(joined(x.df, x.joins).select(s.as_text(*x.item.pair).alias("value")).distinct())
    keys = F.array_distinct(F.transform(x.c, lambda e: s.as_text(e, x.type.elementType)))
    return Value(F.map_from_arrays(keys, F.transform(keys, lambda _: F.lit(None).cast("string"))), T.MapType(s.STRING, s.STRING))


def value_counts(c: Compiler, x, ordered=None):
    if isinstance(x, Relation) and not x.grouped:
        df = joined(x.df, x.joins).groupBy(x.item.c.alias("value")).agg(F.count(F.lit(1)).alias("count"))
        out = relation(df)
        if ordered is not None and known(ordered, "the order"):
            out.order = (Order(F.col("count"), True), Order(F.col("value")))
        return out
    raise Untyped("value_counts of an array")


def quantile(c: Compiler, x, q):
    p = known(q, "the quantile")
    if isinstance(x, Relation):
        return Aggregate(x.df, F.percentile(s.as_double(*x.item.pair), p), s.DOUBLE, x.origin, x.joins)
    a = F.array_sort(F.transform(x.c, lambda e: s.as_double(e, x.type.elementType)))
    place = (F.size(a) - 1) * F.lit(float(p))
    low, high = F.floor(place).cast("int"), F.ceil(place).cast("int")
    none = F.raise_error(F.lit("a quantile of nothing")).cast("double")
    return Value(F.when(F.size(a) == 0, none).otherwise(F.get(a, low) + (F.get(a, high) - F.get(a, low)) * (place - low)), s.DOUBLE)


def concat(c: Compiler, *xs):
    if all(isinstance(x, Relation) for x in xs):
        frames = [joined(x.df, x.joins).select(*map(quoted, x.df.columns)) if isinstance(x.item, Row) else joined(x.df, x.joins).select(x.item.c.alias("value")) for x in xs]
        out = frames[0]
        for f in frames[1:]:
            out = out.unionByName(f)
        return relation(out) if isinstance(xs[0].item, Row) else scalar_relation(out)
    if all(isinstance(x, Value) and isinstance(x.type, T.ArrayType) for x in xs):
        return Value(F.concat(*(x.c for x in xs)), xs[0].type)
    if all(isinstance(x, Value) and isinstance(x.type, T.MapType) for x in xs):
        out = F.map_filter(xs[0].c, lambda k, _: ~F.map_contains_key(xs[1].c, k))
        if len(xs) > 2:
            raise Untyped("concat of three maps")
        return Value(F.map_concat(out, xs[1].c), xs[0].type)
    if all(isinstance(x, Value) and isinstance(x.type, T.StructType) for x in xs):
        fields = {f.name: (x, f.dataType) for x in xs for f in x.type.fields}
        return Value(F.struct(*(c.field(x, n).c.alias(n) for n, (x, _) in fields.items())), T.StructType([T.StructField(n, k) for n, (_, k) in fields.items()]))
    raise Untyped("concat of unlike things")


def append(c: Compiler, x, *more):
    if isinstance(x, Value) and isinstance(x.type, T.ArrayType):
        return Value(F.concat(x.c, F.array(*(m.c.cast(x.type.elementType) for m in more))), x.type)
    raise Untyped("append to a relation")


def add_items(c: Compiler, x, *more):
    if not isinstance(x, Value) or not isinstance(x.type, T.StructType) or len(more) % 2:
        raise Untyped("add_items to other than an object")
    fields = {n: c.field(x, n) for n in x.type.fieldNames()}
    for k, v in zip(more[::2], more[1::2], strict=True):
        fields[known(k, "a key")] = c.in_row(v)
    return Value(F.struct(*(v.c.alias(n) for n, v in fields.items())), T.StructType([T.StructField(n, v.type) for n, v in fields.items()]))


def contains(c: Compiler, x, of):
    if isinstance(of, Relation):
        if isinstance(x, Relation):
            raise Untyped("a relation in a relation")
        return Member(F.lit(False), s.BOOL, known=x.c, of=of)
    if isinstance(of.type, T.ArrayType):
        return Value(F.coalesce(F.exists(of.c, lambda e: e.eqNullSafe(x.c)), F.lit(False)), s.BOOL)
    if isinstance(of.type, T.MapType):
        return Value(F.map_contains_key(of.c, x.c), s.BOOL)
    if isinstance(of.type, T.StructType):
        return Value(x.c.isin(*of.type.fieldNames()), s.BOOL)
    raise Untyped("in of a scalar")


def at_(c: Compiler, x, key):
    if isinstance(x, Groups):
        return Lookup(x, key)
    if isinstance(x.type, T.ArrayType):
        if isinstance(key.type, T.ArrayType):
            return Value(F.transform(key.c, lambda i: F.element_at(x.c, F.when(i >= 0, i + 1).otherwise(i).cast("int"))), x.type)
        i = F.when(key.c >= 0, key.c + 1).otherwise(key.c).cast("int")
        return Value(F.element_at(x.c, i), x.type.elementType)
    if isinstance(x.type, T.MapType):
        found = F.when(F.map_contains_key(x.c, key.c), F.try_element_at(x.c, key.c)).otherwise(F.raise_error(F.lit("no such key")))
        return Value(found, x.type.valueType)
    k = known(key, "a key")
    if k not in x.type.fieldNames():
        raise QueryError(f"no key {k!r}")
    return c.field(x, k)


def index(c: Compiler, x, element, backwards=None):
    last = known(backwards, "the direction") if backwards is not None else False
    found = F.array_position(F.reverse(x.c) if last else x.c, element.c)
    place = F.size(x.c) - found if last else found - 1
    return Value(F.when(found > 0, place.cast("long")).otherwise(F.raise_error(F.lit("no such element")).cast("long")), s.LONG)


def flatten(c: Compiler, x, depth=None):
    for _ in range(known(depth, "the depth") if depth is not None else 1):
        if isinstance(x, Relation) and isinstance(x.item.type, T.ArrayType):
            x = scalar_relation(joined(x.df, x.joins).select(F.explode(x.item.c).alias("value")))
        elif isinstance(x, Value) and isinstance(x.type, T.ArrayType) and isinstance(x.type.elementType, T.ArrayType):
            x = Value(F.flatten(x.c), x.type.elementType)
        elif isinstance(x, Value) and isinstance(x.type, T.ArrayType):
            return x
        else:
            raise Untyped("flatten of that")
    return x


def enumerate_(c: Compiler, x):
    if isinstance(x, Relation):
        df, _, at = indexed(x)
        out = df.select(at.alias("_1"), x.item.c.alias("_2"))
        return relation(out, (Order(F.col("_1")),))
    kind = T.StructType([T.StructField("_1", s.LONG), T.StructField("_2", x.type.elementType)])
    return Value(F.transform(x.c, lambda e, i: F.struct(i.cast("long").alias("_1"), e.alias("_2"))), T.ArrayType(kind))


def zip_(c: Compiler, *xs):
    if all(isinstance(x, Relation) for x in xs):
        if all(x.origin is xs[0].origin for x in xs):
            return relation(joined(xs[0].df, [j for x in xs for j in x.joins]).select(*(x.item.c.alias(f"_{i + 1}") for i, x in enumerate(xs))))
        out = None
        for i, x in enumerate(xs):
            df, _, at = indexed(x)
            df = df.select(at.alias("__zip"), x.item.c.alias(f"_{i + 1}"))
            out = df if out is None else out.join(df, "__zip", "full")
        holes = [F.col(f"_{i + 1}") for i in range(len(xs))]
        return relation(out.orderBy("__zip").select(*holes))
    same = F.lit(True)
    for x in xs[1:]:
        same = same & (F.size(x.c) == F.size(xs[0].c))
    kind = T.StructType([T.StructField(f"_{i + 1}", x.type.elementType) for i, x in enumerate(xs)])
    zipped = F.transform(xs[0].c, lambda e, k: F.struct(e.alias("_1"), *(F.get(x.c, k).alias(f"_{i + 2}") for i, x in enumerate(xs[1:]))))
    return Value(F.when(same, zipped).otherwise(F.raise_error(F.lit("arrays of different lengths"))), T.ArrayType(kind))


def items(c: Compiler, x):
    if isinstance(x.type, T.MapType):
        kind = T.StructType([T.StructField("_1", s.STRING), T.StructField("_2", x.type.valueType)])
        return Value(F.transform(F.map_entries(x.c), lambda e: F.struct(e["key"].alias("_1"), e["value"].alias("_2"))), T.ArrayType(kind))
    if isinstance(x.type, T.StructType) and len({f.dataType.simpleString() for f in x.type.fields}) == 1:
        kind = T.StructType([T.StructField("_1", s.STRING), T.StructField("_2", x.type.fields[0].dataType)])
        return Value(F.array(*(F.struct(F.lit(n).alias("_1"), c.field(x, n).c.alias("_2")) for n in x.type.fieldNames())), T.ArrayType(kind))
    raise Untyped("items of values of several types")


def keys(c: Compiler, x):
    if isinstance(x.type, T.MapType):
        return Value(F.map_keys(x.c), T.ArrayType(s.STRING))
    return Value(F.array(*map(F.lit, x.type.fieldNames())), T.ArrayType(s.STRING))


def dict_(c: Compiler, x):
    if isinstance(x, Value) and isinstance(x.type, T.ArrayType) and isinstance(x.type.elementType, T.StructType):
        a, b = x.type.elementType.fields
        n = F.size(x.c)
        last = F.filter(x.c, lambda e, i: ~F.exists(F.slice(x.c, i + 2, n), lambda later: later[a.name] == e[a.name]))
        return Value(F.map_from_entries(last), T.MapType(s.STRING, b.dataType))
    raise Untyped("dict of that")


def s_join(c: Compiler, sep, x):
    if isinstance(x, Relation):
        if x.grouped or x.order:
            raise Untyped("s_join of an ordered relation")
        return Aggregate(x.df, F.array_join(F.array_sort(F.collect_list(x.item.c)), known(sep, "the separator")), s.STRING, x.origin, x.joins)
    return Value(F.array_join(x.c, known(sep, "the separator")), s.STRING)


def s_cat(c: Compiler, *xs):
    return c.lift(lambda *vs: Value(F.concat(*(s.as_text(*v.pair) for v in vs)), s.STRING), *xs) if not any(isinstance(x, Value) and isinstance(x.type, T.ArrayType) for x in xs) else _no("s_cat of arrays")


def _no(what: str):
    raise Untyped(what)


def pivot(c: Compiler, x, by, val, *more):
    """Values of `by` become keys; each maps to the values of `val`, in the relation's order. As a relation: one row a value."""
    if not isinstance(x, Relation) or more:
        raise Untyped("pivot with more columns")
    (_, k), (_, v) = key_of(x, by), key_of(x, val)
    df = joined(x.df, x.joins)
    order = [o.column for o in x.order] or [v.c]
    at = Window.partitionBy(k.c).orderBy(*order)
    numbered = df.select(s.as_text(*k.pair).alias("key"), v.c.alias("v"), F.row_number().over(at).alias("n"))
    got = numbered.groupBy("key").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "v"))), lambda e: e["v"]).alias("values"))
    return relation(got)


def type_(c: Compiler, x):
    kinds = ((T.BooleanType, "boolean"), (T.StringType, "string"), (T.ArrayType, "array"), ((T.StructType, T.MapType), "object"), (T.NullType, "null"))
    if isinstance(x, Relation):
        return constant("array")
    name = next((n for k, n in kinds if isinstance(x.type, k)), "integer" if s.is_integer(x.type) else "number" if isinstance(x.type, T.NumericType) else "string")
    return Value(F.when(x.c.isNull(), F.lit("null")).otherwise(F.lit(name)), s.STRING)


def range_(c: Compiler, *xs):
    a = [known(x, "a bound") for x in xs if x is not None]
    start, end, step = (0, a[0], 1) if len(a) == 1 else (*a, 1) if len(a) == 2 else a
    if not step:
        raise QueryError("a range's step can't be 0")
    values = range(start, end, step)
    if not values:
        return Value(F.array().cast("array<bigint>"), T.ArrayType(s.LONG), [])
    return Value(F.sequence(F.lit(start).cast("long"), F.lit(values[-1]).cast("long"), F.lit(step).cast("long")), T.ArrayType(s.LONG), list(values))


def rand(c: Compiler):
    return Value(F.rand(), s.DOUBLE)


def randint(c: Compiler, a, b=None):
    low, high = (0, known(a, "a bound")) if b is None else (known(a, "a bound"), known(b, "a bound"))
    return Value(F.floor(F.rand() * (high - low)).cast("long") + low, s.LONG)


def values(c: Compiler, x):
    if isinstance(x.type, T.MapType):
        return Value(F.map_values(x.c), T.ArrayType(x.type.valueType))
    return c.children(x)


def to_records(c: Compiler, x, strategy=None):
    from docloom.operators.tabularize import tabularize

    if not isinstance(x, Relation):
        raise Untyped("to_records of a value")
    return relation(tabularize(joined(x.df, x.joins).select(x.item.c.alias("v")).select("v.*"), known(strategy, "the strategy") if strategy is not None else "d"))


def iterable(c: Compiler, x):
    return constant(isinstance(x, (Relation, Groups)) or isinstance(x.type, (T.ArrayType, T.MapType, T.StructType)))


WHOLE = {
    "group_by": group_by, "sort_by": sort_by, "sorted": sorted_, "max_by": extreme(True), "min_by": extreme(False), "unique": distinct, "set": as_set, "value_counts": value_counts,
    "quantile": quantile, "concat": concat, "append": append, "add_items": add_items, "in": contains, "at": at_, "index": index, "flatten": flatten, "enumerate": enumerate_, "zip": zip_,
    "items": items, "keys": keys, "values": values, "dict": dict_, "s_join": s_join, "s_cat": s_cat, "pivot": pivot, "type": type_, "range": range_, "rand": rand, "randint": randint,
    "to_records": to_records, "iterable": iterable,
}


# --- elements

def number(v: Value) -> tuple[Column, T.DataType]:
    return s.as_number(*v.pair)


def text(v: Value) -> Column:
    if not s.is_text(v.type):
        raise Untyped(f"a string function on a {v.type.simpleString()}")
    return v.c.cast("string")


def to_double(v: Value) -> Value:
    return Value(text(v).cast("double") if s.is_text(v.type) else s.as_double(*v.pair), s.DOUBLE)


def to_int(v: Value) -> Value:
    if s.is_text(v.type):
        return Value(text(v).cast("long"), s.LONG)
    c, kind = number(v)
    return Value(c if kind == s.LONG else F.rint(c).cast("long"), s.LONG)


def rounded(v: Value, places: Value | None = None) -> Value:
    c, kind = number(v)
    if kind == s.LONG:
        return Value(c, kind)
    if places is None:
        return Value(F.rint(c).cast("long"), s.LONG)
    scale = F.pow(F.lit(10.0), F.lit(float(known(places, "the places"))))
    return Value(F.when(F.isnan(c) | (F.abs(c) == float("inf")), c).otherwise(F.rint(c * scale) / scale), s.DOUBLE)


def pattern_of(v: Value) -> str:
    raw = known(v, "a pattern")
    return s.java_pattern(raw) if isinstance(v.known, t.Regex) else raw


def find_all(v: Value, pattern: Value, whole: Value | None = None, *numbers: Value) -> Value:
    raw = known(pattern, "a pattern")
    p = s.java_pattern(raw)
    groups = s.groups_of(p)
    with_whole = bool(known(whole, "the flag")) if whole is not None else False
    take = lambda g: F.regexp_extract_all(text(v), F.lit(p), F.lit(g))
    columns = [0] if not groups else [*([0] if with_whole else []), *range(1, groups + 1)]
    as_numbers = {known(n, "a group") % len(columns) for n in numbers}
    if len(columns) == 1:
        out = take(columns[0])
        if as_numbers:
            return Value(F.transform(out, s.parse_number), T.ArrayType(s.DOUBLE))
        return Value(out, T.ArrayType(s.STRING))
    kind = T.StructType([T.StructField(f"_{i + 1}", s.DOUBLE if i in as_numbers else s.STRING) for i in range(len(columns))])
    if not as_numbers:
        return Value(F.transform(take(columns[0]), lambda e, k: F.array(e, *(F.get(take(g), k) for g in columns[1:]))), T.ArrayType(T.ArrayType(s.STRING)))
    part = lambda i, e: (s.parse_number(e) if i in as_numbers else e).alias(f"_{i + 1}")
    return Value(F.transform(take(columns[0]), lambda e, k: F.struct(part(0, e), *(part(i + 1, F.get(take(g), k)) for i, g in enumerate(columns[1:])))), T.ArrayType(kind))


def substitute(v: Value, pattern: Value, by: Value) -> Value:
    if by.known is ABSENT or not isinstance(by.known, str):
        raise Untyped("s_sub with a callback")
    raw = known(pattern, "a pattern")
    if isinstance(pattern.known, t.Regex):
        return Value(F.regexp_replace(text(v), s.java_pattern(raw), by.known), s.STRING)
    return Value(F.replace(text(v), F.lit(raw), F.lit(by.known)), s.STRING)


def split(v: Value, pattern: Value | None = None) -> Value:
    raw = known(pattern, "a pattern") if pattern is not None else r"\s+"
    if s.groups_of(raw):  # the groups are among the parts
        return in_python("s_split", v, T.ArrayType(s.STRING), pattern.known)
    return Value(F.split(text(v), s.java_pattern(raw) if pattern is not None and isinstance(pattern.known, t.Regex) else raw, -1), T.ArrayType(s.STRING))


def sliced(v: Value, place) -> Value:
    """place: an index, or the (start, stop, step) of a slice with step 1."""
    c, n = text(v), F.length(text(v))
    if isinstance(place, Value):
        i = known(place, "the place")
        at = F.lit(i) if i >= 0 else n + i
        return Value(F.when((at >= 0) & (at < n), c.substr((at + 1).cast("int"), F.lit(1))).otherwise(F.raise_error(F.lit("no such character"))), s.STRING)
    a, b, step = place
    if (step or 1) != 1:
        raise Untyped("s_slice with a step")
    bound = lambda i, other: other if i is None else F.lit(i) if i >= 0 else F.greatest(n + i, F.lit(0))
    low, high = bound(a, F.lit(0)), F.least(bound(b, n), n)
    return Value(c.substr((low + 1).cast("int"), F.greatest(high - low, F.lit(0)).cast("int")), s.STRING)


def in_python(name: str, v: Value, kind: T.DataType, *rest, callback: t.Node | None = None) -> Value:
    """A function that Column expressions can't say: the dynamic lane's, in Arrow batches. rest: its other arguments, constants; callback: an expression instead of the last."""
    from docloom.dynamic.lane import root

    as_json = not s.is_text(v.type)
    where = root()

    @pandas_udf(kind)
    def run(texts: pd.Series) -> pd.Series:
        import sys

        sys.path[:0] = [where] if where not in sys.path else []
        from docloom.dynamic import library, reader
        from docloom.dynamic.evaluator import Box, Evaluator, boxed

        e = Evaluator(Box(None))
        more = [*rest, *([lambda b: e.eval(callback, b)] if callback is not None else [])]

        def one(x):
            if x is None:
                return None
            value = reader.parse(x) if as_json else x
            if name in library.ELEMENTWISE:
                return library.ELEMENTWISE[name](e, value, *more)
            return library.FUNCTIONS[name](e, boxed(value), *map(Box, more)).v

        return texts.map(one)

    c = F.to_json(v.c, {"ignoreNullFields": "false"}) if as_json and isinstance(v.type, (T.StructType, T.ArrayType, T.MapType)) else s.as_text(*v.pair) if as_json else v.c.cast("string")
    return Value(run(c), kind)


def given(args) -> list:
    return [None if a is None else a.known if isinstance(a, Value) and isinstance(a.known, t.Regex) else known(a, "an argument") for a in args]


def s_csv(v: Value, columns: Value, *more: Value) -> Value:
    """Rows of strings (header n or h); objects and numbers are the dynamic lane's."""
    rest = given((columns, *more))
    if len(rest) > 5 or len(rest) == 5 and rest[4] == "d":
        raise Untyped("s_csv with objects or numbers")
    kind = T.ArrayType(s.STRING) if rest[0] == 1 else T.ArrayType(T.ArrayType(s.STRING))
    return in_python("s_csv", v, kind, *rest)


def csv_regex(c: Compiler, n, *more):
    from docloom.dynamic.library import csv_marks
    from docloom.functions.regexes import csv_row

    pattern = csv_row(known(n, "the number of columns"), *csv_marks(*given(more)))
    return Value(F.lit(pattern), s.STRING, t.Regex(pattern))


def stringify(c: Compiler, x, *more):
    if isinstance(x, Relation):
        raise Untyped("stringify of a relation")
    style, sort_keys = (*given(more), None, None)[:2]
    if len(more) <= 2 and (style or "m") in ("m", "c"):
        marks = (",", ":") if (style or "m") == "m" else (", ", ": ")
        try:
            return Value(s.json_text(*x.pair, *marks, sort_keys is None or bool(sort_keys)), s.STRING)
        except Untyped:  # maps
            pass
    return in_python("stringify", x, s.STRING, *given(more))


def to_csv(c: Compiler, x, *more):
    if isinstance(x, Relation):
        raise Untyped("to_csv of a relation; write it with sources.sinks.write_csv")
    return in_python("to_csv", x, s.STRING, *given(more))


def zero_filled(v: Value, n: Value) -> Value:
    c, width = s.as_text(*v.pair), known(n, "the length")
    return Value(F.when(F.length(c) < width, F.lpad(c, width, "0")).otherwise(c), s.STRING)


def parsed(v: Value) -> Value:
    raise Untyped("parse without a schema")


def is_number_value(v: Value) -> Value:
    return Value(F.lit(s.is_number(v.type)) & v.c.isNotNull(), s.BOOL)


def choose(x: Value, yes: Value, no: Value) -> Value:
    a, b = yes, no
    if a.type != b.type and s.is_number(a.type) and s.is_number(b.type):
        a, b = (Value(s.as_double(*y.pair), s.DOUBLE) for y in (a, b)) if s.DOUBLE in (number(a)[1], number(b)[1]) else (Value(s.as_long(*y.pair), s.LONG) for y in (a, b))
    elif a.type != b.type and not isinstance(a.type, T.NullType) and not isinstance(b.type, T.NullType):
        raise Untyped("ifelse with branches of several types")
    return Value(F.when(s.truthy(*x.pair), a.c).otherwise(b.c), b.type if isinstance(a.type, T.NullType) else a.type)


def absolute(v: Value) -> Value:
    c, kind = number(v)
    return Value(F.abs(c), kind)


#: Element-wise in the first argument.
ELEMENTS = {
    "abs": absolute,
    "bool": lambda v: Value(s.truthy(*v.pair), s.BOOL),
    "float": to_double,
    "ifelse": choose,
    "int": to_int,
    "is_expr": lambda v: Value(F.lit(isinstance(v.type, (T.ArrayType, T.MapType, T.StructType))), s.BOOL),
    "is_num": is_number_value,
    "is_str": lambda v: Value(F.lit(s.is_text(v.type)) & v.c.isNotNull(), s.BOOL),
    "isna": lambda v: Value(F.coalesce(F.isnan(s.as_double(*v.pair)), F.lit(False)), s.BOOL),
    "isnull": lambda v: Value(v.c.isNull(), s.BOOL),
    "log": lambda v, base=None: Value(s.logarithm(s.as_double(*v.pair), known(base, "the base") if base is not None else None), s.DOUBLE),
    "log2": lambda v: Value(s.logarithm(s.as_double(*v.pair), 2), s.DOUBLE),
    "num": lambda v: Value(s.parse_number(text(v)) if s.is_text(v.type) else s.as_double(*v.pair), s.DOUBLE),
    "parse": parsed,
    "round": rounded,
    "s_count": lambda v, p: Value(F.regexp_count(text(v), F.lit(pattern_of(p))).cast("long"), s.LONG),
    "s_fa": find_all,
    "s_csv": s_csv,
    "s_format": lambda v, *more: in_python("s_format", v, s.STRING, *given(more)),
    "s_find": lambda v, p: Value(F.regexp_extract_all(text(v), F.lit(pattern_of(p)), F.lit(0)), T.ArrayType(s.STRING)),
    "s_len": lambda v: Value(s.utf16_length(text(v)), s.LONG),
    "s_lines": lambda v: Value(F.split(text(v), r"\r\n?|\n", -1), T.ArrayType(s.STRING)),
    "s_lower": lambda v: Value(F.lower(text(v)), s.STRING),
    "s_upper": lambda v: Value(s.upper(text(v)), s.STRING),
    "s_lpad": lambda v, pad, n: Value(s.padded(text(v), known(pad, "the padding"), known(n, "the length"), True), s.STRING),
    "s_rpad": lambda v, pad, n: Value(s.padded(text(v), known(pad, "the padding"), known(n, "the length"), False), s.STRING),
    "s_mul": lambda v, n: Value(F.repeat(text(v), F.greatest(n.c, F.lit(0)).cast("int")), s.STRING),
    "s_slice": sliced,
    "s_split": split,
    "s_strip": lambda v: Value(F.regexp_replace(text(v), r"(?U)^\s+|\s+$", ""), s.STRING),
    "s_sub": substitute,
    "str": lambda v: Value(s.as_text(*v.pair), s.STRING),
    "zfill": zero_filled,
}
WHOLE |= {"csv_regex": csv_regex, "stringify": stringify, "to_csv": to_csv}
