"""Helpers that the operators of this subpackage share: session folders, Arrow batches, byte-level words and hashes."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterator
from functools import wraps
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: An operator handles texts in slices of about so many bytes at a time; one longer text is a slice by itself.
SLICE_BYTES = 4 << 20
#: Bytes that are hashed at a time.
HASH_BYTES = 1 << 18


def small_batches(spark: SparkSession) -> None:
    """Keep Arrow batches between the JVM and Python small, as rows may hold long texts; and let Python workers find this package where it stands beside the driver."""
    spark.sparkContext.environment.setdefault("PYTHONPATH", str(Path(__file__).resolve().parents[2]))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(2 * SLICE_BYTES))


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share (spark.checkpoint.dir); a temporary one only where the setting is absent and everything runs in one process, as in tests."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="docloom-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, free: bool = False) -> DataFrame:
    """The same rows, written as Parquet into the shared folder and read again: lineage ends there, and a lost executor costs no more than one stage. free: also have Spark remove the shuffle files of plans that nothing refers to any longer, which it else does at the driver's next full garbage collection."""
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.docloom_folder = path
    if free:
        del df
        gc.collect()
        spark.sparkContext._jvm.System.gc()
    return out


def discard(*tables: DataFrame) -> None:
    """Delete the folders of tables that written() returned and that no later result reads."""
    for t in tables:
        context = t.sparkSession.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(t.docloom_folder)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def hash_sample(df: DataFrame, key: str, most: int) -> DataFrame:
    """About `most` rows of df, all of them if there are no more: those whose key's hash is below the share that they make up. No task hands on more than its own share."""
    n = df.count()
    if n <= most:
        return df
    chosen = df.where(F.xxhash64(key) < F.lit(int(-(1 << 63) + (1 << 64) * most / n)))
    # rows that share a key share its hash; beyond twice as many, the same ones go in each run
    return chosen.orderBy(F.xxhash64(key), F.xxhash64(*df.columns)).limit(2 * most)


def only(df: DataFrame, *columns: str) -> DataFrame:
    """Just these columns, found by exact name: extra columns with clashing names (other case, or dots) do no harm."""
    at = {}
    for i, c in enumerate(df.columns):
        at.setdefault(c, i)
    if missing := [c for c in columns if c not in at]:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    if len({c.lower() for c in df.columns}) < len(df.columns):
        df = df.toDF(*(c if c in columns and at[c] == i else f"__extra_{i}" for i, c in enumerate(df.columns)))
    return df.select(*(F.col(f"`{c}`") for c in columns))


def keeps_names(stage):
    """For a function of documents that returns their columns: while it works, columns whose names clash with those of documents (other case) have other names."""
    @wraps(stage)
    def run(docs: DataFrame, *args, **kwargs) -> DataFrame:
        names = docs.columns
        own = {c for c in ("doc_id", "text", "lang", "source", "n_chars") if c in names}
        out = stage(docs.toDF(*(c if c in own else f"__extra_{i}" for i, c in enumerate(names))), *args, **kwargs)
        return out.toDF(*names)

    return run


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows in slices of about `most` bytes of the column."""
    for b in batches:
        if not b.num_rows:
            continue
        offsets = string_offsets(b.column(b.schema.get_field_index(column)))
        begin = 0
        while begin < b.num_rows:
            end = int(np.searchsorted(offsets, offsets[begin] + most, side="left"))
            end = min(max(end, begin + 1), b.num_rows)
            yield b.slice(begin, end - begin)
            begin = end


def string_offsets(a: pa.Array) -> np.ndarray:
    """Byte offsets of a string array, one more than it has rows."""
    wide = pa.types.is_large_string(a.type) or pa.types.is_large_binary(a.type)
    kind = np.int64 if wide else np.int32
    return np.frombuffer(a.buffers()[1], kind)[a.offset : a.offset + len(a) + 1].astype(np.int64)


def utf8(a: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string array's rows, one after the other, and their offsets; null rows have no bytes."""
    offsets = string_offsets(a)
    data = a.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
    return raw, offsets - offsets[0]


_A, _Z = ord("A"), ord("Z")
#: Each byte with A-Z as a-z.
LOWER = np.array([b + 32 if _A <= b <= _Z else b for b in range(256)], np.uint8)
with np.errstate(over="ignore"):

    def mix(x: np.ndarray) -> np.ndarray:
        """Spread 64-bit values (the finalizer of splitmix64)."""
        x = x.astype(np.uint64, copy=True)
        x += np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))

    #: A spread value for each byte, A-Z as a-z.
    BYTE_VALUES = mix(LOWER.astype(np.uint64) + np.uint64(1))
    _P = 0x9E3779B97F4A7C15 | 1
    _INV_P = pow(_P, -1, 1 << 64)
    #: Powers of the base and of its inverse, for a chunk of bytes.
    POWERS, INVERSES = (np.cumprod(np.array([1, *[base] * HASH_BYTES], np.uint64), dtype=np.uint64) for base in (_P, _INV_P))

    def words(raw: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First byte, end and row of each word: maximal runs of bytes for which is_word holds; no word crosses rows."""
        n = len(raw)
        if not n:
            none = np.zeros(0, np.int64)
            return none, none, none
        w = is_word[raw]
        new = np.zeros(n + 1, bool)
        new[offsets[:-1]] = True
        new = new[:n]
        starts = w.copy()
        starts[1:] &= ~w[:-1] | new[1:]
        ends = w.copy()
        ends[:-1] &= ~w[1:] | new[1:]
        s, e = np.flatnonzero(starts), np.flatnonzero(ends) + 1
        return s, e, np.searchsorted(offsets, s, side="right") - 1

    def hashed(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, values: np.ndarray = BYTE_VALUES) -> np.ndarray:
        """A 64-bit hash of each raw[start:end] (in order, none inside another); the same bytes have the same hash anywhere. Memory is bounded: HASH_BYTES are handled at a time."""
        out = np.empty(len(starts), np.uint64)
        first = 0
        while first < len(starts):
            a = int(starts[first])
            last = int(np.searchsorted(ends, a + HASH_BYTES, side="right"))
            if last <= first:  # one that is longer
                total = 0
                for k, at in enumerate(range(a, int(ends[first]), HASH_BYTES)):
                    part = values[raw[at : min(at + HASH_BYTES, int(ends[first]))]]
                    total += int((part * POWERS[: len(part)]).sum(dtype=np.uint64)) * pow(_P, k * HASH_BYTES, 1 << 64)
                out[first] = total & 0xFFFFFFFFFFFFFFFF
                first += 1
                continue
            some = slice(first, last)
            sums = np.zeros(int(ends[last - 1]) - a + 1, np.uint64)
            np.cumsum(values[raw[a : a + len(sums) - 1]] * POWERS[: len(sums) - 1], out=sums[1:])
            out[some] = (sums[ends[some] - a] - sums[starts[some] - a]) * INVERSES[starts[some] - a]
            first = last
        return mix(out + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def table(members) -> np.ndarray:
    t = np.zeros(256, bool)
    t[list(members)] = True
    return t


#: Words as whatever is between ASCII white space.
NOT_SPACE = ~table([0x20, *range(0x09, 0x0E)])
#: Words of ASCII letters and digits and of all characters beyond ASCII.
ALNUM = table([*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)])
