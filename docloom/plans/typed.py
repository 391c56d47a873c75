"""The typed lane: compiles a query to DataFrame and Column expressions.

The input is a relation: an array of objects, whose rows are in no order unless the query sorts them. An expression is
evaluated in relation scope, where `@` is the whole relation, or in row scope, where `@` is a row, a value in it, or an
element of an array in it. Aggregates of a relation stay unevaluated until something needs them: a group_by that is
projected becomes one groupBy with all its aggregates, a projection over the relation one aggregation, and an aggregate
that a row is compared with a one-row table that is broadcast. Whatever can't be typed raises Untyped.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field, replace
from itertools import count

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from docloom.errors import QueryError, Untyped
from docloom.functions import scalars as s
from docloom.plans import tree as t

_fresh = count()
ABSENT = object()


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


@dataclass
class Value:
    """A value in row scope, or a constant (then known says which)."""

    c: Column
    type: T.DataType
    known: object = ABSENT

    @property
    def pair(self) -> tuple[Column, T.DataType]:
        return self.c, self.type


@dataclass
class Row(Value):
    """A whole row of a relation: its columns by name."""


@dataclass
class Relation:
    """A sequence of rows (item: what each row stands for). order: sort columns, if the rows have an order."""

    df: DataFrame
    item: Value
    origin: object
    order: tuple = ()
    #: Tables that items refer to: (DataFrame, condition, how), joined before the items are used.
    joins: list = field(default_factory=list)
    grouped: bool = False


@dataclass
class Aggregate:
    """An aggregate over a relation, not evaluated yet."""

    df: DataFrame
    c: Column
    type: T.DataType
    origin: object
    joins: list = field(default_factory=list)


@dataclass
class Groups:
    """A relation grouped by keys."""

    relation: Relation
    names: tuple
    keys: tuple


@dataclass
class Member(Value):
    """Whether a value is in a relation."""

    of: Relation = None
    negated: bool = False


@dataclass
class Lookup:
    """The rows of a group, found by key from another relation's row."""

    groups: Groups
    key: Value


def constant(v: object) -> Value:
    if v is None:
        return Value(F.lit(None), s.NULL, None)
    if isinstance(v, bool):
        return Value(F.lit(v), s.BOOL, v)
    if isinstance(v, int):
        return Value(F.lit(v).cast("long"), s.LONG, v)
    if isinstance(v, float):
        return Value(F.lit(v), s.DOUBLE, v)
    if isinstance(v, str):
        return Value(F.lit(v), s.STRING, v)
    if isinstance(v, list) and v:
        parts = [constant(x) for x in v]
        kind = parts[0].type
        if any(p.type != kind for p in parts):
            if not all(isinstance(p.type, (T.LongType, T.DoubleType)) for p in parts):
                raise Untyped("an array of several types")
            kind, parts = s.DOUBLE, [Value(s.as_double(*p.pair), s.DOUBLE) for p in parts]
        return Value(F.array(*(p.c for p in parts)), T.ArrayType(kind), v)
    raise Untyped(f"a literal {v!r}")


def relation(df: DataFrame, order: tuple = ()) -> Relation:
    return Relation(df, Row(F.struct(*map(quoted, df.columns)), df.schema), object(), order)


def scalar_relation(df: DataFrame, order: tuple = ()) -> Relation:
    """A relation of scalars, from a DataFrame of one column."""
    return Relation(df, Value(quoted(df.columns[0]), df.schema[0].dataType), object(), order)


class Compiler:
    """Evaluates syntax trees to values, relations, aggregates and groups. variables: what names stand for."""

    def __init__(self, variables: dict) -> None:
        self.variables = dict(variables)
        self.joins: list[list] = []  # of the rows that are being compiled, innermost last

    # --- expressions

    def eval(self, node: t.Node, at):
        if isinstance(node, t.Literal):
            return constant(node.value)
        if isinstance(node, t.Regex):
            return Value(F.lit(node.pattern), s.STRING, node)
        if isinstance(node, t.JsonLiteral):
            from docloom.dynamic.reader import parse

            return constant(parse(node.text))
        if isinstance(node, t.Current):
            return at
        if isinstance(node, t.Variable):
            return self.variables[node.name]
        if isinstance(node, t.Chain):
            return self.chain(self.eval(node.base, at), node.indexers)
        if isinstance(node, t.Unary):
            x = self.eval(node.operand, at)
            if isinstance(x, Member) and node.op == "not":
                return replace(x, c=~x.c, negated=not x.negated)
            return self.lift(lambda a: Value(*s.unary(node.op, a.pair)), x)
        if isinstance(node, t.Binary):
            return self.binary(node.op, self.eval(node.left, at), self.eval(node.right, at))
        if isinstance(node, t.Call):
            return self.call(node, at)
        raise Untyped(f"{type(node).__name__} in the typed lane")

    def binary(self, op: str, x, y):
        def one(a: Value, b: Value) -> Value:
            if op == "=~":
                pattern = b.known.pattern if isinstance(b.known, t.Regex) else b.known
                if pattern is ABSENT:
                    return Value(*s.binary(op, a.pair, b.pair))
                if not s.is_text(a.type):
                    raise Untyped("=~ needs a string")
                return Value(a.c.rlike(s.java_pattern(pattern, False) if isinstance(b.known, t.Regex) else pattern), s.BOOL)
            return Value(*s.binary(op, a.pair, b.pair))

        return self.lift(one, x, y)

    def lift(self, f: Callable, *xs):
        """f over all elements of whatever is an array or relation; aggregates and constants go along."""
        xs = tuple(self.in_row(x) if isinstance(x, Member) else x for x in xs)
        relations = [x for x in xs if isinstance(x, Relation)]
        if relations:
            first = relations[0]
            if any(r.origin is not first.origin for r in relations):
                raise Untyped("two relations element by element")
            joins = list(first.joins)
            self.joins.append(joins)
            try:
                items = []
                for x in xs:
                    if isinstance(x, Relation):
                        joins += [j for j in x.joins if j not in joins]
                        items.append(x.item)
                    else:
                        items.append(self.in_row(x))
                return replace(first, item=self.lift(f, *items), joins=joins)
            finally:
                self.joins.pop()
        if any(isinstance(x, Aggregate) for x in xs):
            first = next(x for x in xs if isinstance(x, Aggregate))
            if all(isinstance(x, Value) and x.known is not ABSENT or isinstance(x, Aggregate) and x.origin is first.origin for x in xs):
                out = f(*(Value(x.c, x.type) if isinstance(x, Aggregate) else x for x in xs))
                return replace(first, c=out.c, type=out.type)
            xs = [self.in_row(x) for x in xs]
        if any(not isinstance(x, Value) for x in xs):
            raise Untyped("an operator on groups")
        arrays = [x for x in xs if isinstance(x.type, T.ArrayType)]
        if not arrays:
            return f(*xs)
        if len(arrays) == 1:
            k = next(i for i, x in enumerate(xs) if x is arrays[0])
            made = []

            def each(c: Column) -> Column:
                out = f(*(Value(c, x.type.elementType) if i == k else x for i, x in enumerate(xs)))
                made.append(out.type)
                return out.c

            c = F.transform(arrays[0].c, each)
            return Value(c, T.ArrayType(made[0]))
        if len(xs) == 2:
            made = []

            def both(a: Column, b: Column) -> Column:
                out = f(Value(a, xs[0].type.elementType), Value(b, xs[1].type.elementType))
                made.append(out.type)
                return out.c

            zipped = F.zip_with(xs[0].c, xs[1].c, both)
            same = F.size(xs[0].c) == F.size(xs[1].c)
            return Value(F.when(same, zipped).otherwise(F.raise_error(F.lit("arrays of different lengths"))), T.ArrayType(made[0]))
        raise Untyped("several arrays element by element")

    def in_row(self, x) -> Value:
        """A value that a row can use: an aggregate becomes a broadcast one-row table beside the row's relation."""
        if isinstance(x, Aggregate):
            if not self.joins:
                raise Untyped("an aggregate of one relation beside another's")
            name = f"__one_{next(_fresh)}"
            self.joins[-1].append((joined(x.df, x.joins).agg(x.c.alias(name)), None, "cross"))
            return Value(F.col(name), x.type)
        if isinstance(x, Member):
            if not self.joins:
                raise Untyped("membership outside of a row")
            key, flag = f"__key_{next(_fresh)}", f"__in_{next(_fresh)}"
            table = joined(x.of.df, x.of.joins).select(x.of.item.c.alias(key)).distinct().withColumn(flag, F.lit(True))
            self.joins[-1].append((table, x.known.eqNullSafe(F.col(key)), "left"))
            found = F.coalesce(F.col(flag), F.lit(False))
            return Value(~found if x.negated else found, s.BOOL)
        if isinstance(x, Value):
            return x
        raise Untyped("a relation where a row's value is needed")

    # --- indexers

    def chain(self, x, indexers: tuple):
        if not indexers:
            return x
        first, rest = indexers[0], indexers[1:]
        if isinstance(x, Lookup):
            return self.looked_up(x, indexers)
        if isinstance(x, Groups):
            return self.of_groups(x, indexers)
        if isinstance(first, t.Mask):
            return self.masked(x, first, rest)
        if isinstance(first, t.Apply):
            return self.chain(self.eval(first.body, x), rest)
        if isinstance(first, (t.MakeArray, t.MakeObject)):
            return self.chain(self.projected(x, first), rest)
        if isinstance(x, Relation) and isinstance(first, (t.Slots, t.Star)):
            if isinstance(first, t.Star) and first.deep:
                return self.leaves(x)
            return self.each(self.sliced(x, first), rest)
        if isinstance(x, Aggregate):
            raise Untyped("an index on an aggregate")
        if isinstance(first, t.Keys):
            if isinstance(x, Relation):
                raise QueryError("a key can't be selected from an array; use [:] first") if not first.deep else Untyped("deep keys of a relation")
            out, one = self.keyed(x, first)
            return self.chain(out, rest) if one else self.each(out, rest)
        if isinstance(first, t.Star):
            if first.deep:
                return self.each(self.leaves_of(x), rest)
            return self.each(self.children(x), rest)
        out, one = self.positions(x, first)
        return self.chain(out, rest) if one else self.each(out, rest)

    def each(self, x, rest: tuple):
        """The rest of a chain on each element; masks on single elements drop them."""
        if not rest:
            return x
        if isinstance(x, Relation):
            joins = list(x.joins)
            self.joins.append(joins)
            try:
                if isinstance(rest[0], t.Mask):
                    condition = self.eval(rest[0].condition, x.item)
                    if isinstance(condition, Value) and not isinstance(condition.type, T.ArrayType):
                        return self.each(self.kept(replace(x, joins=joins), condition), rest[1:])
                if isinstance(rest[0], t.Keys) and t.yields_one(rest[0]) and isinstance(x.item.type, T.StructType) and rest[0].items[0] not in x.item.type.fieldNames():
                    return scalar_relation(joined(x.df, x.joins).where(F.lit(False)).select(F.lit(None).cast("string").alias("value")))  # no row has the key
                taken = 1
                while taken < len(rest) and t.yields_one(rest[taken - 1]) and not isinstance(rest[taken], t.Mask):
                    taken += 1
                item = self.chain(x.item, rest[:taken])
                if not isinstance(item, Value):
                    item = self.in_row(item)
                out = replace(x, item=item, joins=joins)
                if isinstance(rest[0], t.Keys) and t.yields_one(rest[0]) and isinstance(item.type, (T.ArrayType, T.MapType)):
                    # empty values are dropped on the way
                    if taken < len(rest):
                        out = self.kept(out, Value(F.size(item.c) > 0, s.BOOL))
                if taken < len(rest):
                    if t.yields_one(rest[taken - 1]):
                        return self.each(out, rest[taken:])
                    raise Untyped("an index into the elements of a row's selection")
                return out
            finally:
                self.joins.pop()
        if not isinstance(x, Value) or not isinstance(x.type, (T.ArrayType, T.MapType)):
            return self.chain(x, rest) if isinstance(x, Value) and isinstance(x.type, T.StructType) else self._no("elements of a scalar")
        if isinstance(x.type, T.MapType):
            made = []

            def value(_: Column, v: Column) -> Column:
                out = self.chain(Value(v, x.type.valueType), rest)
                made.append(out.type)
                return out.c

            c = F.transform_values(x.c, value)
            return Value(c, T.MapType(s.STRING, made[0]))
        element = x.type.elementType
        if isinstance(rest[0], t.Mask):
            kept = F.filter(x.c, lambda c: s.truthy(*self.eval(rest[0].condition, Value(c, element)).pair))
            return self.each(Value(kept, x.type), rest[1:])
        made = []

        def one(c: Column) -> Column:
            out = self.chain(Value(c, element), rest)
            made.append(out.type)
            return out.c

        c = F.transform(x.c, one)
        return Value(c, T.ArrayType(made[0]))

    def _no(self, what: str):
        raise Untyped(what)

    def kept(self, x: Relation, condition: Value) -> Relation:
        if isinstance(condition, Member):
            return self.semi(x, condition)
        columns = x.df.columns
        df = joined(x.df, x.joins).where(s.condition(*condition.pair)).select(*map(quoted, columns))
        # joins stay for items that refer to them
        out = Relation(df, x.item, object(), x.order, list(x.joins) if _refers(x.item, x.joins) else [])
        if isinstance(x.item, Row):
            out.item = Row(F.struct(*map(quoted, columns)), df.schema)
        return out

    def semi(self, x: Relation, m: Member) -> Relation:
        other = joined(m.of.df, m.of.joins).select(m.of.item.c.alias("__member"))
        name = f"__key_{next(_fresh)}"
        df = joined(x.df, x.joins).withColumn(name, m.known)
        out = df.join(other, df[name].eqNullSafe(other["__member"]), "left_anti" if m.negated else "left_semi").select(*map(quoted, x.df.columns))
        return replace(x, df=out, origin=object())

    def masked(self, x, first: t.Mask, rest: tuple):
        if isinstance(x, Relation):
            condition = self.eval(first.condition, x)
            if isinstance(condition, Relation) and condition.origin is x.origin:
                joins = list(x.joins) + [j for j in condition.joins if j not in x.joins]
                return self.each(self.kept(replace(x, joins=joins), condition.item), rest)
            if isinstance(condition, Value) and not isinstance(condition, Member) and condition.known is not ABSENT:
                return self.each(x if condition.known else replace(x, df=x.df.where(F.lit(False)), origin=object()), rest)
            if isinstance(condition, (Aggregate, Member)):
                joins = list(x.joins)
                self.joins.append(joins)
                try:
                    one = self.in_row(condition)
                finally:
                    self.joins.pop()
                return self.each(self.kept(replace(x, joins=joins), one), rest)
            raise Untyped("a mask of another shape than what it filters")
        if not isinstance(x, Value):
            raise Untyped("a mask on groups")
        condition = self.eval(first.condition, x)
        if isinstance(x.type, T.ArrayType) and isinstance(condition.type, T.ArrayType):
            same = F.size(x.c) == F.size(condition.c)
            kept = F.transform(F.filter(F.zip_with(x.c, condition.c, lambda v, k: F.struct(v.alias("v"), k.alias("k"))), lambda p: p["k"]), lambda p: p["v"])
            return self.each(Value(F.when(same, kept).otherwise(F.raise_error(F.lit("a mask of another length"))), x.type), rest)
        ok = s.truthy(*condition.pair)
        if isinstance(x.type, T.ArrayType):
            return self.each(Value(F.when(ok, x.c).otherwise(F.slice(x.c, 1, 0)), x.type), rest)
        return self.chain(Value(F.when(ok, x.c), x.type), rest)

    def keyed(self, x: Value, first: t.Keys) -> tuple[Value, bool]:
        if isinstance(x.type, T.MapType):
            if first.deep:
                raise Untyped("deep keys of a map")
            if t.yields_one(first):
                return Value(F.try_element_at(x.c, F.lit(first.items[0])), x.type.valueType), True
            fits = lambda k: _any(k.rlike(s.java_pattern(i.pattern, False)) if isinstance(i, t.Regex) else k == i for i in first.items)
            return Value(F.map_filter(x.c, lambda k, _: ~fits(k) if first.negated else fits(k)), x.type), False
        if isinstance(x.type, T.ArrayType) and first.deep:
            return self.deep(x, first), False
        if not isinstance(x.type, T.StructType):
            raise Untyped(f"a key of a {x.type.simpleString()}")
        if first.deep:
            return self.deep(x, first), False
        names = x.type.fieldNames()
        if t.yields_one(first):
            if first.items[0] not in names:
                return Value(F.lit(None), s.NULL), True
            return self.field(x, first.items[0]), True
        chosen = []
        for i in first.items:
            chosen += [n for n in names if n not in chosen and (re.search(i.pattern, n, re.M) if isinstance(i, t.Regex) else n == i)]
        if first.negated:
            chosen = [n for n in names if n not in chosen]
        if not chosen:
            raise Untyped("no key is left")
        fields = [self.field(x, n) for n in chosen]
        kind = T.StructType([T.StructField(n, f.type) for n, f in zip(chosen, fields, strict=True)])
        return Value(F.struct(*(f.c.alias(n) for n, f in zip(chosen, fields, strict=True))), kind), True

    def field(self, x: Value, name: str) -> Value:
        kind = x.type[name].dataType
        return Value(quoted(name) if isinstance(x, Row) else x.c.getField(name), kind)

    def deep(self, x: Value, first: t.Keys) -> Value:
        """All values of the keys on any level, none below another: an array, in document order."""
        found: list[Value] = []

        def walk(v: Value) -> None:
            if isinstance(v.type, T.StructType):
                for n in v.type.fieldNames():
                    f = self.field(v, n)
                    if any(re.search(i.pattern, n, re.M) if isinstance(i, t.Regex) else n == i for i in first.items):
                        found.append(Value(F.array(f.c), T.ArrayType(f.type)))
                    else:
                        walk(f)
            elif isinstance(v.type, T.ArrayType) and isinstance(v.type.elementType, (T.StructType, T.ArrayType)):
                inner: list[T.DataType] = []

                def one(c: Column) -> Column:
                    got = self.deep(Value(c, v.type.elementType), first)
                    inner.append(got.type)
                    return got.c

                try:
                    c = F.flatten(F.transform(v.c, one))
                except Untyped:
                    return
                found.append(Value(c, inner[0]))

        walk(x)
        return _concatenated(found)

    def leaves_of(self, x: Value) -> Value:
        """All scalars below a value, in document order, as one array; numbers of several types as doubles."""
        found: list[Value] = []

        def walk(v: Value) -> None:
            if isinstance(v.type, T.StructType):
                for n in v.type.fieldNames():
                    walk(self.field(v, n))
            elif isinstance(v.type, T.ArrayType):
                if isinstance(v.type.elementType, (T.StructType, T.ArrayType)):
                    inner: list[T.DataType] = []

                    def one(c: Column) -> Column:
                        got = self.leaves_of(Value(c, v.type.elementType))
                        inner.append(got.type)
                        return got.c

                    c = F.flatten(F.transform(v.c, one))
                    found.append(Value(c, inner[0]))
                else:
                    found.append(v)
            else:
                found.append(Value(F.array(v.c), T.ArrayType(v.type)))

        walk(x)
        return _concatenated(found)

    def leaves(self, x: Relation) -> Relation:
        got = self.leaves_of(x.item)
        df = joined(x.df, x.joins).select(F.explode(got.c).alias("value"))
        return scalar_relation(df)

    def children(self, x: Value) -> Value:
        if isinstance(x.type, (T.ArrayType, T.MapType)):
            return x
        if isinstance(x.type, T.StructType):
            return _concatenated([Value(F.array(f.c), T.ArrayType(f.type)) for n in x.type.fieldNames() for f in [self.field(x, n)]])
        raise Untyped("a star on a scalar")

    def positions(self, x: Value, first: t.Slots) -> tuple[Value, bool]:
        if not isinstance(x.type, T.ArrayType):
            raise Untyped(f"a position in a {x.type.simpleString()}")
        if t.yields_one(first):
            i = first.items[0]
            return Value(F.try_element_at(x.c, F.lit(i + 1 if i >= 0 else i)), x.type.elementType), True
        n = F.size(x.c)
        chosen = [_positions(i, n) for i in first.items]
        at = F.concat(*chosen) if len(chosen) > 1 else chosen[0]
        if first.negated:
            at = F.filter(F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>")), lambda i: ~F.array_contains(at, i))
        whole = len(first.items) == 1 and first.items[0] == (None, None, None) and not first.negated
        return Value(x.c if whole else F.transform(at, lambda i: F.get(x.c, i)), x.type), False

    def sliced(self, x: Relation, first) -> Relation:
        if isinstance(first, t.Star) or first.items == ((None, None, None),) and not first.negated:
            return x
        if x.grouped:
            raise Untyped("positions in a group")
        if len(first.items) == 1 and not first.negated and isinstance(first.items[0], tuple):
            a, b, step = first.items[0]
            if (step or 1) == 1 and (a or 0) >= 0 and (b is None or b >= 0):
                df = ordered(x.df, x.order)
                if a:
                    df = df.offset(a)
                if b is not None:
                    df = df.limit(max(0, b - (a or 0)))
                return replace(x, df=df, origin=object())
        df, n, at = indexed(x)
        chosen = []
        for i in first.items:
            i = (i, i + 1 if i != -1 else None, 1) if isinstance(i, int) else i
            step = i[2] or 1
            if step < 0:
                raise Untyped("a slice of a relation that goes backwards")
            bound = lambda v, other: other if v is None else F.lit(v) if v >= 0 else F.greatest(n + v, F.lit(0))
            low, high = bound(i[0], F.lit(0)), bound(i[1], n)
            chosen.append((at >= low) & (at < high) & ((at - low) % step == 0))
        ok = _any(chosen)
        df = df.where(~ok if first.negated else ok).orderBy(at).select(*map(quoted, x.df.columns))
        out = replace(x, df=df, origin=object())
        if t.yields_one(first):
            return replace(out, origin=object())
        return out

    def projected(self, x, first):
        named = isinstance(first, t.MakeObject)
        pairs = list(first.items) if named else [(f"_{i + 1}", e) for i, e in enumerate(first.items)]
        values = [(n, self.eval(e, x)) for n, e in pairs]
        if isinstance(x, Relation) and not x.grouped:
            if all(isinstance(v, Aggregate) or isinstance(v, Value) and v.known is not ABSENT for _, v in values) and any(isinstance(v, Aggregate) for _, v in values):
                first_one = next(v for _, v in values if isinstance(v, Aggregate))
                if all(isinstance(v, Value) or v.origin is first_one.origin for _, v in values):
                    joins = first_one.joins
                    return relation(joined(first_one.df, joins).agg(*((v.c if isinstance(v, Aggregate) else F.first(v.c)).alias(n) for n, v in values)))
                frames = [joined(v.df, v.joins).agg(v.c.alias(n)) for n, v in values if isinstance(v, Aggregate)]
                out = frames[0]
                for f in frames[1:]:
                    out = out.crossJoin(F.broadcast(f))  # one row each
                return relation(out)
            raise Untyped("a projection of a whole relation that isn't aggregates")
        got = [(n, self.in_row(v)) for n, v in values]
        if not named and len({str(v.type) for _, v in got}) == 1:
            return Value(F.array(*(v.c for _, v in got)), T.ArrayType(got[0][1].type))
        kind = T.StructType([T.StructField(n, v.type) for n, v in got])
        return Value(F.struct(*(v.c.alias(n) for n, v in got)), kind)

    # --- groups

    def of_groups(self, g: Groups, indexers: tuple):
        first, rest = indexers[0], indexers[1:]
        if isinstance(first, t.Apply) and g.names and not rest:
            raise Untyped("a projection of all groups")
        for _ in g.names:
            if not isinstance(first, t.Star):
                raise Untyped("groups that aren't projected")
            if _ is not g.names[-1]:
                first, rest = rest[0], rest[1:]
        if not rest:
            raise Untyped("groups that aren't projected")
        inner = replace(g.relation, grouped=True)
        body, rest = rest[0], rest[1:]
        df = joined(g.relation.df, g.relation.joins)
        keys = [k.c.alias(n) for n, k in zip(g.names, g.keys, strict=True)]
        if isinstance(body, t.Apply):
            out = self.eval(body.body, inner)
            if isinstance(out, Aggregate):
                made = df.groupBy(*keys).agg(out.c.alias("__made"))
                if isinstance(out.type, T.StructType):
                    extra = [n for n in g.names if n not in out.type.fieldNames()]
                    made = made.select(*map(quoted, extra), "__made.*")
                else:
                    made = made.withColumnRenamed("__made", "value")
                return self.chain(relation(made), rest)
            raise Untyped("a projection of groups that isn't an aggregate")
        if isinstance(body, t.Slots) and t.yields_one(body) and body.items[0] in (0, -1) and g.relation.order:
            window = Window.partitionBy(*(k.c for k in g.keys)).orderBy(*((o if body.items[0] == 0 else o.reversed).column for o in g.relation.order))
            got = df.withColumn("__n", F.row_number().over(window)).where("__n = 1").drop("__n")
            return self.each(relation(got), rest)
        if not isinstance(body, (t.MakeArray, t.MakeObject)):
            raise Untyped("groups that aren't projected")
        pairs = list(body.items) if isinstance(body, t.MakeObject) else [(f"_{i + 1}", e) for i, e in enumerate(body.items)]
        aggregates = []
        for n, e in pairs:
            v = self.eval(e, inner)
            if isinstance(v, Aggregate):
                aggregates.append(v.c.alias(n))
            elif isinstance(v, Value) and v.known is not ABSENT:
                aggregates.append(F.first(v.c).alias(n))
            else:
                raise Untyped(f"{n} isn't one value for each group")
        made = df.groupBy(*keys).agg(*aggregates)
        shown = [n for n in g.names if n not in [k for k, _ in pairs]]
        return self.each(relation(made.select(*map(quoted, shown), *(quoted(n) for n, _ in pairs))), rest)

    def looked_up(self, x: Lookup, indexers: tuple) -> Value:
        if len(indexers) < 2 or not (isinstance(indexers[0], t.Slots) and indexers[0].items == (0,)) or not (isinstance(indexers[1], t.Keys) and t.yields_one(indexers[1])):
            raise Untyped("a lookup of other than the first row's key")
        if not self.joins:
            raise Untyped("a lookup outside of a row")
        r, name, key = x.groups.relation, f"__found_{next(_fresh)}", f"__key_{next(_fresh)}"
        wanted = self.field(r.item, indexers[1].items[0])
        of_key = x.groups.keys[0]
        table = joined(r.df, r.joins).groupBy(s.as_text(*of_key.pair).alias(key)).agg(F.first(wanted.c).alias(name))
        self.joins[-1].append((table, s.as_text(*x.key.pair) == F.col(key), "left"))
        missing = F.raise_error(F.concat(F.lit("no group of the key "), s.as_text(*x.key.pair))).cast(wanted.type)
        return self.chain(Value(F.when(F.col(key).isNull(), missing).otherwise(F.col(name)), wanted.type), indexers[2:])

    # --- functions

    def call(self, node: t.Call, at):
        from docloom.plans import typed_functions

        return typed_functions.call(self, node, at)


def joined(df: DataFrame, joins: list) -> DataFrame:
    for table, condition, how in joins:
        df = df.crossJoin(F.broadcast(table)) if how == "cross" else df.join(table, condition, how)  # a crossed table has one row
    return df


def _refers(item: Value, joins: list) -> bool:
    text = str(item.c)
    return any(n in text for j in joins for n in j[0].columns if n.startswith("__"))


@dataclass(frozen=True)
class Order:
    """A sort column: descending ones have nulls last, others first."""

    c: Column
    descending: bool = False

    @property
    def column(self) -> Column:
        return self.c.desc_nulls_last() if self.descending else self.c.asc_nulls_first()

    @property
    def reversed(self) -> Order:
        return Order(self.c, not self.descending)


def ordered(df: DataFrame, order: tuple) -> DataFrame:
    return df.orderBy(*(o.column for o in order)) if order else df


def _any(conditions) -> Column:
    out = None
    for c in conditions:
        out = c if out is None else out | c
    return out


def _positions(i, n: Column) -> Column:
    """The positions that an index or slice selects in an array of n elements."""
    none = F.array().cast("array<int>")
    if isinstance(i, int):
        at = F.lit(i) if i >= 0 else n + i
        return F.when((at >= 0) & (at < n), F.array(at)).otherwise(none)
    a, b, step = i
    step = step or 1
    clip = lambda v, low, high: F.least(F.greatest(F.lit(v) if v >= 0 else n + v, low), high)
    if step > 0:
        low, high = (F.lit(0) if a is None else clip(a, F.lit(0), n)), (n if b is None else clip(b, F.lit(0), n))
        return F.when(low < high, F.sequence(low, high - 1, F.lit(step))).otherwise(none)
    high, low = (n - 1 if a is None else clip(a, F.lit(-1), n - 1)), (F.lit(-1) if b is None else clip(b, F.lit(-1), n - 1))
    return F.when(high > low, F.sequence(high, low + 1, F.lit(step))).otherwise(none)


def _concatenated(found: list[Value]) -> Value:
    """One array of several; numbers of several types become doubles."""
    found = [v for v in found if not isinstance(v.type.elementType, T.NullType)] or found
    if not found:
        raise Untyped("nothing is selected")
    kinds = [v.type.elementType for v in found]
    if len({k.simpleString() for k in kinds}) > 1:
        if not all(isinstance(k, T.NumericType) for k in kinds):
            raise Untyped("values of several types in one array")
        kind = s.LONG if all(map(s.is_integer, kinds)) else s.DOUBLE
        found = [Value(v.c.cast(T.ArrayType(kind)), T.ArrayType(kind)) for v in found]
    return Value(F.concat(*(v.c for v in found)), found[0].type) if len(found) > 1 else found[0]


def shared_checkpoints(spark: SparkSession) -> None:
    """Checkpoints go to the folder that spark.checkpoint.dir names; only a local session without that setting gets a folder of its own."""
    if spark.sparkContext.getCheckpointDir() is None:
        found = spark.conf.get("spark.checkpoint.dir", None)
        if not found:
            if not spark.sparkContext.master.startswith("local"):
                raise QueryError("spark.checkpoint.dir must name a folder that all executors share")
            import tempfile

            found = tempfile.mkdtemp(prefix="docloom-")
        spark.sparkContext.setCheckpointDir(found)


def indexed(x: Relation) -> tuple[DataFrame, Column, Column]:
    """The relation's rows with their number, and the column of the number of rows. The sorted rows are checkpointed, so that numbers stay; a partition's rows are numbered from the sum of those before it."""
    shared_checkpoints(x.df.sparkSession)
    df = joined(x.df, x.joins)
    df = ordered(df, x.order).withColumn("__mono", F.monotonically_increasing_id()).checkpoint()
    part, within = F.shiftright("__mono", 33), F.col("__mono").bitwiseAND((1 << 33) - 1)
    sizes = df.groupBy(part.alias("__part")).agg(F.count(F.lit(1)).alias("__size"))
    by_part = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    starts = sizes.select("__part", F.coalesce(F.sum("__size").over(by_part), F.lit(0)).alias("__start")).crossJoin(F.broadcast(sizes.agg(F.coalesce(F.sum("__size"), F.lit(0)).alias("__rows"))))
    out = df.withColumn("__part", part).join(F.broadcast(starts), "__part").withColumn("__at", F.col("__start") + within)
    return out, F.col("__rows"), F.col("__at")
