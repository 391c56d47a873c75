"""Sorting and shuffling: arrays inside documents, and relations."""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.dynamic.lane import mapped
from docloom.errors import JsonError, QueryError
from docloom.plans.typed import quoted


def sort_documents(documents: DataFrame, path: str = "@", by: str | None = None, descending: bool = False, ignore_case: bool = False, as_text: bool = False, many: bool = False, seed: int | None = None, column: str = "value") -> DataFrame:
    """documents with result (JSON text) and error: the array that the query path leads to is sorted, the rest of the document stays.

    by: a query on each element whose result is the key (a key or index of the elements, or any expression); ignore_case:
    texts without regard to case; as_text: by the elements' JSON text; many: path leads to an array or object of arrays, each
    of which is sorted; seed: shuffle instead (the same document and seed have the same order). Ties keep their order.
    """
    from docloom.plans.parser import parse

    parse(path)
    if by is not None:
        parse(by)

    def one(text: str | None) -> tuple:
        from docloom.dynamic import reader, writer
        from docloom.dynamic.evaluator import Box, Evaluator, boxed, order, plain
        from docloom.plans.parser import parse

        if text is None:
            return None, "no document"

        def key_of(e: Evaluator, x: Box):
            if by is not None:
                x = e.eval(parse(by)[0].expression, x)
            if as_text or isinstance(x.v, (list, dict)):
                return writer.text_of(plain(x))
            return x.v

        def arranged(e: Evaluator, x: Box) -> None:
            if not isinstance(x.v, list):
                raise QueryError("only an array can be sorted")
            if seed is not None:
                random.Random(f"{seed}{text}").shuffle(x.v)
                return
            keyed = [(key_of(e, v), v) for v in x.v]
            if ignore_case:
                keyed = [(k.lower() if isinstance(k, str) else k, v) for k, v in keyed]
            from functools import cmp_to_key

            keyed.sort(key=cmp_to_key(lambda a, b: order(a[0], b[0])), reverse=descending)
            x.v[:] = [v for _, v in keyed]

        try:
            document = boxed(reader.parse(text))
            e = Evaluator(document)
            found = e.eval(parse(path)[0].expression, document)
            for x in (found.v.values() if isinstance(found.v, dict) else found.v) if many else [found]:
                arranged(e, x)
            return writer.compact(plain(document), False), None
        except (QueryError, JsonError) as e:
            return None, str(e)

    return mapped(documents, column, one, "result string, error string")


def sort_relation(df: DataFrame, *columns: str, ignore_case: bool = False) -> DataFrame:
    """The rows sorted by columns (`-` before a name: descending); nulls are lowest."""
    def key(name: str) -> Column:
        c = quoted(name.removeprefix("-"))
        if ignore_case and dict(df.dtypes)[name.removeprefix("-")] == "string":
            c = F.lower(c)
        return c.desc_nulls_last() if name.startswith("-") else c.asc_nulls_first()

    return df.orderBy(*map(key, columns))


def shuffle(df: DataFrame, seed: int = 0) -> DataFrame:
    """The rows in an order drawn by the seed: by a hash of each row, equal rows side by side."""
    return df.orderBy(F.xxhash64(F.lit(seed), F.to_json(F.struct(*map(quoted, df.columns)))))
