"""Exact top-k search by inner product with multi-resolution segment statistics.

A vector is cut into segments; of each, the mean and the standard deviation are kept. For a query q and a vector x, the sum
over segments of length * (mean_q * mean_x + deviation_q * deviation_x) is never below their inner product (which is to say
that it bounds their distance from below). Coarse segments rule out most of a block of vectors, finer ones more, and only
survivors are scored exactly. A pair goes only if its bound is below the query's k-th best score so far, so ties survive.

The queries are taken in blocks of QUERY_BLOCK; each block is broadcast, and each task returns its k best of every query.
Vectors that are null, or hold null or non-finite components, take no part. Vectors are compared with those of their own
length; empty ones score 0 with each other. Ties go to the smaller vec_id. A row never matches rows with its own vec_id; of
several queries with one vec_id the smallest vector counts; repeated candidate rows count each. Rows with a null vec_id take
no part. Scores must fit 64 bits; larger ones are an error. An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docloom.llm._shared import only, small_batches

QUERY_BLOCK = 4096
#: Segments of a vector, coarse to fine.
RESOLUTIONS = (4, 16)
#: Vectors that are bounded and scored at a time; the first few only set the first thresholds.
FIRST_BLOCK, BLOCK = 128, 1024


def features(x: np.ndarray, segments: int) -> np.ndarray:
    """For each row, sqrt(length) * mean and sqrt(length) * deviation of each segment, so that a product of two rows is the bound."""
    edges = np.unique(np.linspace(0, x.shape[1], min(segments, x.shape[1]) + 1).astype(int))
    out = []
    for a, b in zip(edges, edges[1:], strict=False):
        part = x[:, a:b]
        root = np.sqrt(b - a)
        out += [root * part.mean(axis=1), root * part.std(axis=1)]
    return np.stack(out, axis=1) if out else np.zeros((len(x), 1))


def exact(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Integer inner products, exactly: as doubles while all sums stay below 2**53, else as integers of any size."""
    most = (np.abs(q).max(initial=0.0) * np.abs(x).max(initial=0.0)) * max(1, q.shape[1])
    if most < 2.0**53:
        return q @ x.T
    as_int = lambda m: np.array([[int(v) for v in row] for row in m], dtype=object).reshape(m.shape)
    return as_int(q) @ as_int(x).T


class Best:
    """The k best (score, then smaller id) for each query of one length."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int) -> None:
        self.ids, self.vectors, self.k = ids, vectors, k
        self.levels = [features(vectors, s) for s in RESOLUTIONS]
        self.floor = np.full(len(ids), -np.inf)
        self.found: tuple[np.ndarray, np.ndarray, np.ndarray] = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64))

    def take(self, ids: np.ndarray, x: np.ndarray) -> None:
        """Compare with a block of vectors."""
        alive = self.ids[:, None] != ids[None, :]
        rows, columns = np.arange(len(self.ids)), np.arange(len(ids))
        for segments, level in zip(RESOLUTIONS, self.levels, strict=True):
            bound = level[rows] @ features(x[columns], segments).T
            slack = 1e-9 * (1 + np.abs(level[rows]).sum(axis=1) * np.abs(x).max(initial=0.0) * np.sqrt(x.shape[1] + 1))
            alive = alive & (bound + slack[:, None] >= self.floor[rows][:, None])
            some_row, some_column = alive.any(axis=1), alive.any(axis=0)
            alive, rows, columns = alive[some_row][:, some_column], rows[some_row], columns[some_column]
            if not len(rows):
                return
        scores = exact(self.vectors[rows], x[columns])
        r, c = np.nonzero(alive & (scores >= self.floor[rows][:, None]))
        if not len(r):
            return
        new = (rows[r], ids[columns[c]], np.array(scores[r, c], dtype=np.int64))
        q, i, s = (np.concatenate([a, b]) for a, b in zip(self.found, new, strict=True))
        order = np.lexsort((i, -s, q))
        q, i, s = q[order], i[order], s[order]
        rank = np.arange(len(q)) - np.searchsorted(q, q, side="left")
        keep = rank < self.k
        self.found = (q[keep], i[keep], s[keep])
        last = rank == self.k - 1
        self.floor[q[last]] = s[last]


def matrices(ids: list[int], vectors: list) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ids and integer components (floor of 256 times) of the valid vectors, for each length."""
    by: dict[int, tuple[list, list]] = {}
    for i, v in zip(ids, vectors, strict=True):
        if i is None or v is None or any(x is None for x in v):
            continue
        a = np.asarray(v, np.float64)
        if np.isfinite(a).all():
            at = by.setdefault(len(a), ([], []))
            at[0].append(i)
            at[1].append(a)
    for n, (i, v) in by.items():
        yield np.array(i, np.int64), np.floor(256 * np.array(v).reshape(len(v), n))


def top_k(vectors: DataFrame, k: int = 5, every: int = 50) -> DataFrame:
    """query_id, rank (from 1), vec_id and score: for each row whose vec_id is divisible by `every`, its k best of all rows (vec_id, embedding)."""
    spark = vectors.sparkSession
    small_batches(spark)
    vectors = only(vectors, "vec_id", "embedding")
    usable = F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    vectors = vectors.where(usable)
    queries = vectors.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    blocks = -(-queries.count() // QUERY_BLOCK)
    schema = "query_id long, vec_id long, score long"
    parts = []
    for block in range(blocks):
        # about QUERY_BLOCK vectors come to the driver at a time
        mine = queries.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == block).collect()
        asked = spark.sparkContext.broadcast(list(matrices([r[0] for r in mine], [r[1] for r in mine])))

        def run(batches: Iterator[pa.RecordBatch], asked=asked) -> Iterator[pa.RecordBatch]:
            best = {q.shape[1]: Best(i, q, k) for i, q in asked.value}
            seen: set[int] = set()
            for b in batches:
                for ids, x in matrices(b.column("vec_id").to_pylist(), [None if v is None else v.values.to_numpy(zero_copy_only=False) if v.values.null_count == 0 else v.as_py() for v in b.column("embedding")]):
                    if not (mine := best.get(x.shape[1])):
                        continue
                    at = 0
                    while at < len(ids):
                        step = BLOCK if x.shape[1] in seen else FIRST_BLOCK
                        seen.add(x.shape[1])
                        mine.take(ids[at : at + step], x[at : at + step])
                        at += step
            for mine in best.values():
                q, i, s = mine.found
                yield pa.RecordBatch.from_pydict({"query_id": pa.array(mine.ids[q], pa.int64()), "vec_id": pa.array(i, pa.int64()), "score": pa.array(s, pa.int64())})

        parts.append(vectors.mapInArrow(run, schema))
    if not parts:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return reduce(DataFrame.unionAll, parts).withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
