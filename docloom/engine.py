"""Entry point: runs queries of the query language on DataFrames (typed lane) and on documents (dynamic lane)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.errors import QueryError, Untyped
from docloom.plans import tree as t
from docloom.plans.parser import parse
from docloom.plans.typed import ABSENT, Aggregate, Compiler, Groups, Order, Relation, Row, Value, joined, ordered, quoted, relation


class Engine:
    """query() compiles a query to a DataFrame; tables are the variables that it can name."""

    def __init__(self, spark: SparkSession, **tables: DataFrame) -> None:
        self.spark, self.tables = spark, tables

    def query(self, text: str, df: DataFrame, order: tuple = ()) -> DataFrame:
        """The result of a query whose input is the rows of df, sorted by the columns that order names (`-` before a name: descending). An array of objects is a DataFrame of their keys; of scalars, one of a column `value`; a single value is one row."""
        names = {n: relation(d) for n, d in self.tables.items()}
        try:
            return self._typed(text, df, order, names)
        except Untyped as e:
            raise Untyped(f"{e} (query_documents() runs it on each document, in the dynamic lane)") from e

    def _typed(self, text: str, df: DataFrame, order: tuple, names: dict) -> DataFrame:
        compiler = Compiler(names)
        at = relation(df, tuple(Order(quoted(c.lstrip("-")), c.startswith("-")) for c in order))
        out = at
        for statement in parse(text, frozenset(names)):
            if isinstance(statement, t.Define):
                out = compiler.variables[statement.name] = compiler.eval(statement.value, at)
            elif isinstance(statement, t.Assign):
                at = assigned(compiler, statement, at)
                out = at
            elif isinstance(statement, t.Statement):
                out = compiler.eval(statement.expression, at)
            else:
                raise Untyped("a loop in the typed lane")
        return frame(self.spark, out)

    def query_documents(self, text: str, documents: DataFrame, column: str = "value") -> DataFrame:
        """documents with `result` (JSON text) and `error`: the query, run on each document (JSON text) by the dynamic lane."""
        from docloom.dynamic.lane import run

        return run(text, documents, column)


def frame(spark: SparkSession, x) -> DataFrame:
    """A compiled result as a DataFrame."""
    if isinstance(x, Relation):
        df = joined(x.df, x.joins)
        if isinstance(x.item, Row):
            out = df.select(*map(quoted, x.item.type.fieldNames()))
        elif hasattr(x.item.type, "fields"):
            out = df.select(x.item.c.alias("__item")).select("__item.*")
        else:
            out = df.select(x.item.c.alias("value"))
        return ordered(df, x.order).select(*_columns(x)) if x.order else out
    if isinstance(x, Aggregate):
        out = joined(x.df, x.joins).agg(x.c.alias("value"))
        return out.select("value.*") if hasattr(x.type, "fields") else out
    if isinstance(x, Groups):
        r = x.relation
        return joined(r.df, r.joins).groupBy(*(k.c.alias(n) for n, k in zip(x.names, x.keys, strict=True))).agg(F.collect_list(r.item.c).alias("rows"))
    if isinstance(x, Value):
        if x.known is ABSENT and not spark:
            raise QueryError("no input")
        return spark.range(1).select(x.c.alias("value"))
    raise QueryError(f"a result of kind {type(x).__name__}")


def _columns(x: Relation) -> list:
    if isinstance(x.item, Row):
        return [quoted(n) for n in x.item.type.fieldNames()]
    if hasattr(x.item.type, "fields"):
        return [x.item.c.getField(f.name).alias(f.name) for f in x.item.type.fields]
    return [x.item.c.alias("value")]


def assigned(compiler: Compiler, statement: t.Assign, at: Relation) -> Relation:
    """The relation after `@[:]...key = value` (masks between [:] and the key choose the rows): a new DataFrame."""
    target = statement.target
    if not isinstance(target, t.Chain) or not isinstance(target.base, t.Current) or not isinstance(target.indexers[-1], t.Keys) or target.indexers[-1].deep or target.indexers[-1].negated:
        raise Untyped("an assignment to other than keys of rows")
    *before, last = target.indexers
    condition = F.lit(True)
    for i in before:
        if isinstance(i, t.Slots) and i.items == ((None, None, None),):
            continue
        if not isinstance(i, t.Mask):
            raise Untyped("an assignment below the rows' keys")
        try:
            got = compiler.eval(i.condition, at.item)
        except (Untyped, QueryError):
            got = compiler.eval(i.condition, at)
        item = got.item if isinstance(got, Relation) else got
        if isinstance(got, Relation) and got.joins:
            raise Untyped("an assignment that compares with an aggregate")
        from docloom.functions.scalars import truthy

        condition = condition & truthy(*item.pair)
    keyed, one = compiler.keyed(at.item, last)
    names = [last.items[0]] if t.yields_one(last) else keyed.type.fieldNames()
    df = at.df
    new = {}
    for n in names:
        old = compiler.field(at.item, n)
        value = compiler.eval(statement.value, Value(old.c, old.type))
        if not isinstance(value, Value):
            raise Untyped("an assignment of other than a value")
        plain = before and any(isinstance(i, t.Mask) for i in before)
        if plain and value.type != old.type:
            raise Untyped("an assignment that changes some rows' type")
        new[n] = F.when(condition, value.c).otherwise(old.c) if plain else value.c
    return relation(df.withColumns(new), at.order)
