"""Row-scoped queries on streaming DataFrames, and grouped ones in complete mode.

A query that only selects, filters and projects rows compiles to the same plan on a stream as on a table. A grouped one
compiles to a streaming aggregation, for output mode complete (or update). Queries that sort, slice or number rows need a
table, as a stream has no end.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from docloom.engine import Engine
from docloom.errors import Untyped


def stream_query(spark: SparkSession, text: str, stream: DataFrame, **tables: DataFrame) -> DataFrame:
    """The streaming DataFrame of a query's results. tables: static relations that the query can name."""
    if not stream.isStreaming:
        raise Untyped("not a stream")
    out = Engine(spark, **tables).query(text, stream)
    if not out.isStreaming:
        raise Untyped("the query doesn't read the stream")
    return out
