"""Jaccard join of documents on word shingles, size-aware.

Words stand between ASCII white space, A-Z lower-cased. A document's set holds its distinct shingles; with fewer words than
a shingle has, the whole sequence is one. Two documents link when limit[1] * |intersection| >= limit[0] * |union|. Sets
are either light or heavy, by size:

* light sets enumerate fixed-size subsets: two sets of sizes s and t that link share a subset of as many elements as their
  least overlap, so each emits a key for each such subset of its own, for each size t that a light partner may have;
* heavy sets (and light ones that may have a heavy partner) go into inverted lists: of a set's shingles, in one order for
  the whole corpus (those in often used buckets last, else by hash), a prefix so long that two sets that link share an entry.

The boundary is the largest size up to which enumerating costs no more keys than the list entries that a set of that size
makes and meets; the mean length of a list comes from counts of all shingles of all documents, in BUCKETS buckets.

The lists and subset keys aren't read pair by pair. The set with the least id in a list is its head, and the list's sets
are members of the head's neighbourhood, once for all its lists: rows in proportion to the entries, not to the pairs. Two
sets that link are together in at least one neighbourhood. Neighbourhoods are searched in three steps, the large ones in
blocks of bounded size, each block with each other:

1. by parity sketches: a member stays if it has another beside it whose sketch differs in no more places than linked sets
   can (the sketch never rules out a pair that links);
2. the same among those that stay, but a pair counts only in the first of its common neighbourhoods;
3. by the whole sets: shared elements are counted by products of incidence matrices, and each pair that links is counted for
   both its sets. A task gives a row for each linked set of a block, with its number of links and its least partner reached.

No list is cut short, and no pair of sets is a row. links() gives the pairs themselves, a row each, for those who want them.

Shingles are known by 64-bit hashes, sets by 128-bit ones; a set stands for all documents with it. Null and empty texts, and
rows with a null doc_id, have no links; a null doc_id has a null component_id. Equal rows have equal results. Repeated doc_ids
with different texts are different documents. An empty table gives no rows. Extra columns are ignored, or carried along by
keep_one().
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import combinations
from math import comb, floor, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from docloom.llm._shared import NOT_SPACE, discard, hashed, keeps_names, mix, only, slices, small_batches, utf8, words, written

#: Buckets (as a power of two) in which shingles are counted, and how many counts go in one row.
BUCKETS, BUCKETS_A_ROW = 18, 1 << 12
#: Sets beyond this size are never light: their subsets are too many.
LARGEST_LIGHT = 40
#: Bits of a sketch: the power of two from a set's size on, between these.
LEAST_BITS, MOST_BITS = 512, 1 << 16
#: The last bits of a set's id say the class of its size: sets that link are of one class or of neighbouring ones.
CLASS_BITS = 8
#: A block of a neighbourhood has about so many sets and bytes of sketches, or so many whole sets and elements, at most.
BLOCK_SKETCHES, BLOCK_BYTES = 4096, 1 << 22
BLOCK_SETS, BLOCK_ELEMENTS = 1024, 1 << 19
#: Columns of an incidence matrix that are multiplied at a time, and pairs up to which sets are compared one by one.
COLUMNS, FEW_PAIRS = 2048, 24
#: Rows of small groups that are handled together.
TOGETHER = 8192
#: Bytes of text that are handled at a time; distinct sets that a task remembers.
SLICE, REMEMBERED = 1 << 20, 1 << 18
#: Bits (as a power of two) of the filters that say which keys are shared and which sets a verification needs.
FILTER_BITS = 27
ROUNDS = 60


def least_overlap(a: int, b: int, limit: tuple[int, int]) -> int:
    return -(-limit[0] * (a + b) // (limit[0] + limit[1]))


def partner_sizes(n: int, limit: tuple[int, int]) -> range:
    return range(max(1, -(-n * limit[0] // limit[1])), n * limit[1] // limit[0] + 1)


def prefix_length(n: int, limit: tuple[int, int]) -> int:
    return n - -(-n * limit[0] // limit[1]) + 1


def subset_keys(n: int, limit: tuple[int, int]) -> int:
    """How many keys a light set of size n emits at most."""
    return sum(comb(n, n - least_overlap(n, t, limit)) for t in partner_sizes(n, limit) if least_overlap(n, t, limit) <= min(n, t))


def boundary(mean_list: float, limit: tuple[int, int]) -> int:
    """The largest light size: up to it, no size has more subset keys than list entries made and met."""
    x = 0
    while x < LARGEST_LIGHT and subset_keys(x + 1, limit) <= prefix_length(x + 1, limit) * (1 + mean_list):
        x += 1
    return x


def size_class(n: int, limit: tuple[int, int]) -> int:
    """Classes of sizes a little wider than the ratio of two sizes that link, so that these differ by one class at most."""
    return min((1 << CLASS_BITS) - 1, floor(log(n) / (1.001 * max(1e-3, log(limit[1] / limit[0]))))) if n else 0


def shingle_sets(b: pa.RecordBatch, k: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each row's text."""
    raw, offsets = utf8(b.column("text"))
    s, e, row = words(raw, offsets, NOT_SPACE)
    none = np.zeros(0, np.uint64)
    if not len(s):
        return [none] * b.num_rows
    h = hashed(raw, s, e)
    with np.errstate(over="ignore"):
        factors = [np.uint64(pow(0x9E3779B97F4A7C15, j + 1, 1 << 64)) for j in range(k)]
        m = max(0, len(h) - k + 1)
        sums = np.zeros(m, np.uint64)
        for j in range(k):
            sums += h[j : j + m] * factors[j]
        sums = mix(sums)
        first = np.searchsorted(row, np.arange(b.num_rows + 1))
        out = []
        for r in range(b.num_rows):
            a, z = first[r], first[r + 1]
            if z - a >= k:
                u = np.sort(sums[a : z - k + 1])
                out.append(u[np.concatenate([[True], u[1:] != u[:-1]])])
            elif z > a:
                short = sum((h[a + j : a + j + 1] * factors[j] for j in range(z - a)), np.zeros(1, np.uint64))
                out.append(mix(short + np.uint64(z - a)))
            else:
                out.append(none)
    return out


def set_hash(u: np.ndarray) -> bytes:
    """128 bits that tell sets apart."""
    with np.errstate(over="ignore"):
        sums = np.array([u.sum(dtype=np.uint64), mix(u).sum(dtype=np.uint64)]) + np.uint64(len(u))
    return mix(sums).tobytes()


def set_id(of: bytes, n: int, limit: tuple[int, int]) -> int:
    """Bits of the set's hash, and its size class."""
    h = int.from_bytes(of[:8], "little", signed=True)
    return h >> CLASS_BITS << CLASS_BITS | size_class(n, limit)


def sketch(u: np.ndarray) -> bytes:
    """The parity of the number of elements in each of a number of cells, by the low bits of the hash."""
    bits = min(MOST_BITS, max(LEAST_BITS, 1 << (len(u) - 1).bit_length()))
    cell = (u & np.uint64(bits - 1)).astype(np.int64)
    return np.packbits((np.bincount(cell, minlength=bits) & 1).astype(bool)).tobytes()


def folded(sketches: list[bytes], size: int) -> np.ndarray:
    """Sketches of one length as rows of 64-bit words, folded to size bytes: fewer cells, each the sum of several."""
    out = np.frombuffer(b"".join(sketches), np.uint8).reshape(len(sketches), -1)  # lengths are powers of two
    while out.shape[1] > size:
        half = out.shape[1] // 2
        out = out[:, :half] ^ out[:, half:]
    return np.ascontiguousarray(out).view(np.uint64)


class Sketches:
    """Sketches of several lengths, two of which are compared at the shorter one's."""

    def __init__(self, sketches: list[bytes]) -> None:
        self.size = np.array([len(x) for x in sketches], np.int64)
        self.at: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for size in np.unique(self.size).tolist():
            mine = [np.flatnonzero(self.size == longer) for longer in np.unique(self.size[self.size >= size])]
            rows = np.concatenate([folded([sketches[k] for k in of], size) for of in mine])
            place = np.full(len(sketches), -1)
            place[np.concatenate(mine)] = np.arange(len(rows))
            self.at[size] = rows, place

    def apart(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """In how many cells the sketches x and y differ: never more than their sets' elements that the other lacks."""
        size = np.minimum(self.size[x], self.size[y])
        out = np.zeros(len(x), np.int64)
        for bits, (rows, place) in self.at.items():
            mine = np.flatnonzero(size == bits)
            if len(mine):
                out[mine] = np.bitwise_count(rows[place[x[mine]]] ^ rows[place[y[mine]]]).sum(axis=1)
        return out


def light_keys(u: np.ndarray, largest: int, limit: tuple[int, int]) -> list[int]:
    """A key for each subset that a light partner of each size must share."""
    n, out = len(u), []
    values = [int(x) for x in u]
    total = sum(values)
    for t in partner_sizes(n, limit):
        o = least_overlap(n, t, limit)
        if t > largest or o > min(n, t):
            continue
        tag = (min(n, t) << 20 | max(n, t)) * 0xD6E8FEB86659FD93
        out += [(total - sum(left) + tag) & 0xFFFFFFFFFFFFFFFF for left in combinations(values, n - o)]
    return out


def corpus_counts(docs: DataFrame, k: int) -> np.ndarray:
    """How many shingles of all documents' sets fall into each bucket."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(1 << BUCKETS, np.int64)
        for b in slices(batches, most=SLICE):
            every = np.concatenate(shingle_sets(b, k))
            sums += np.bincount((every >> np.uint64(64 - BUCKETS)).astype(np.int64), minlength=1 << BUCKETS)
        parts = sums.reshape(-1, BUCKETS_A_ROW)
        some = np.flatnonzero(parts.any(axis=1))
        yield pa.RecordBatch.from_pydict({"part": pa.array(some, pa.int32()), "counts": pa.array([zlib.compress(parts[i].tobytes(), 1) for i in some], pa.binary())})

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for part, counts in zip(b.column("part").to_pylist(), b.column("counts").to_pylist(), strict=True):
                sums[part] = sums.get(part, 0) + np.frombuffer(zlib.decompress(counts), np.int64)
        yield pa.RecordBatch.from_pydict({"part": pa.array(list(sums), pa.int32()), "counts": pa.array([x.tobytes() for x in sums.values()], pa.binary())})

    schema = "part int, counts binary"
    out = np.zeros((1 << BUCKETS) // BUCKETS_A_ROW * BUCKETS_A_ROW, np.int64).reshape(-1, BUCKETS_A_ROW)
    for r in docs.mapInArrow(count, schema).repartition("part").mapInArrow(add, schema).collect():  # 2 MB in all
        out[r["part"]] = np.frombuffer(r["counts"], np.int64)
    return out.ravel()


def order_and_mean(counts: np.ndarray) -> tuple[np.ndarray, float]:
    """The level of each bucket (0: used no more than most; a step for each factor of the square root of two), and the mean number of other sets in a shingle's list, both from the counts."""
    total, buckets = int(counts.sum()), len(counts)
    if not total:
        return np.zeros(buckets, np.uint8), 0.0
    level = np.maximum(0, np.floor(2 * np.log2(np.maximum(counts, 1e-9) * buckets / total)))
    # two shingles fall into one bucket by chance in a share of 1 / buckets
    squares = (float((counts.astype(float) ** 2).sum()) - total * total / buckets) * buckets / (buckets - 1)
    return level.astype(np.uint8), max(0.0, squares / total - 1)


def signatures(docs: DataFrame, k: int, limit: tuple[int, int]) -> DataFrame:
    """doc_id, n (set size) and set (its hash; null for an empty one) of each row of docs, and, in the first row of a task with the set, id, sketch and keys (subset keys and list entries)."""
    level, mean_list = order_and_mean(corpus_counts(docs, k))
    model = docs.sparkSession.sparkContext.broadcast((level, boundary(mean_list, limit)))

    def keys_of(u: np.ndarray, level: np.ndarray, largest: int) -> np.ndarray:
        mine = [np.zeros(0, np.uint64)]
        if len(u) <= largest:
            mine.append(mix(np.array(light_keys(u, largest, limit), np.uint64)))
        if len(u) > largest or partner_sizes(len(u), limit)[-1] > largest:
            late = level[(u >> np.uint64(64 - BUCKETS)).astype(np.int64)]
            mine.append(u[np.argsort(late, kind="stable")][: prefix_length(len(u), limit)])
        return np.unique(np.concatenate(mine)).astype(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level, largest = model.value
        seen: set[bytes] = set()
        for b in slices(batches, most=SLICE):
            rows = []
            for u, doc_id in zip(shingle_sets(b, k), b.column("doc_id").to_pylist(), strict=True):
                of = set_hash(u) if len(u) else None
                if of is None or doc_id is None or of in seen:
                    rows.append((len(u), of, None, None, None))
                    continue
                if len(seen) >= REMEMBERED:
                    seen.clear()
                seen.add(of)
                rows.append((len(u), of, set_id(of, len(u), limit), sketch(u), keys_of(u, level, largest)))
            n, of, ids, sketches, keys = zip(*rows, strict=True)
            yield pa.RecordBatch.from_pydict({"doc_id": b.column("doc_id"), "n": pa.array(n, pa.int64()), "set": pa.array(of, pa.binary()), "id": pa.array(ids, pa.int64()), "sketch": pa.array(sketches, pa.binary()), "keys": pa.array(keys, pa.list_(pa.int64()))})

    return docs.mapInArrow(run, "doc_id long, n long, set binary, id long, sketch binary, keys array<long>")


def most_apart(n: int | np.ndarray, limit: tuple[int, int]) -> int | np.ndarray:
    """The largest symmetric difference of two sets that link and have n elements together (counted twice if shared)."""
    return n - 2 * -(-limit[0] * n // (limit[0] + limit[1]))


def bit_filter(ids: DataFrame) -> np.ndarray:
    """A filter of fixed size (16 MB) that holds at least the values of a long column."""
    place = F.shiftrightunsigned(ids.columns[0], 64 - FILTER_BITS)
    parts = ids.select(place.alias("p")).groupBy(F.expr("bitmap_bucket_number(p)").alias("bucket")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(p))").alias("bits")).collect()  # 4097 of 4 KB at most
    held = np.zeros((1 << FILTER_BITS) // 8 + 4096, np.uint8)
    for r in parts:
        held[r["bucket"] * 4096 : (r["bucket"] + 1) * 4096] = np.frombuffer(bytes(r["bits"]), np.uint8)
    return held


def may_hold(held: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Which ids the filter may hold. Places count from 1 within Spark's buckets of 32768; place 0 has a bucket of its own."""
    p = (ids.astype(np.uint64) >> np.uint64(64 - FILTER_BITS)).astype(np.int64)
    bucket, bit = np.where(p > 0, 1 + (p - 1) // 32768, 0), np.where(p > 0, (p - 1) % 32768, 0)
    return (held[bucket * 4096 + bit // 8] >> (bit % 8).astype(np.uint8)) & 1 == 1


def memberships(sets: DataFrame) -> DataFrame:
    """id and head, each once: the sets of each neighbourhood, but for those that no other one there is near in size. sets: id, keys."""
    spark = sets.sparkSession
    entries = sets.select("id", F.explode("keys").alias("key"))
    ends = entries.groupBy("key").agg(F.min("id").alias("head"), F.max("id").alias("high")).where("head <> high").select("key", "head")
    ends = written(ends, "shared-keys", free=True)
    sent = spark.sparkContext.broadcast(bit_filter(ends.select("key")))

    def likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column("keys")
            keys = lists.flatten().to_numpy()
            ids = np.repeat(b.column("id").to_numpy(), np.diff(lists.offsets.to_numpy()))
            ok = may_hold(sent.value, keys)
            yield pa.RecordBatch.from_pydict({"id": pa.array(ids[ok], pa.int64()), "key": pa.array(keys[ok], pa.int64())})

    few = sets.select("id", "keys").mapInArrow(likely, "id long, key long")
    found = written(few.join(ends.hint("merge"), "key").select("id", "head").distinct(), "memberships", free=True)
    sent.destroy()
    discard(ends)
    kind = F.col("id").bitwiseAND((1 << CLASS_BITS) - 1)
    beside = F.explode(F.array(*(F.struct((F.col("class") + d).alias("class"), F.lit(d == 0).alias("own")) for d in (-1, 0, 1)))).alias("x")
    counts = found.groupBy("head", kind.alias("class")).agg(F.count(F.lit(1)).alias("m"))
    near = counts.select("head", "m", beside).groupBy("head", F.col("x.class").alias("class")).agg(F.sum("m").alias("m"), F.max("x.own").alias("own")).where("own and m > 1")
    out = written(found.withColumn("class", kind).join(near.select("head", "class").hint("merge"), ["head", "class"]).select("id", "head"), "near-memberships", free=True)
    discard(found)
    return out


def dealt(rows: DataFrame, most_rows: int, bytes_of, most_bytes: int) -> DataFrame:
    """rows (head, set and others) with i, j and own: a neighbourhood's sets are dealt into blocks, as many as these bounds ask for, and each pair of blocks (i, j) gets the sets of both."""
    blocks = F.ceil(F.greatest(F.count(F.lit(1)) / most_rows, F.sum(bytes_of) / most_bytes)).cast("int")
    large = written(rows.groupBy("head").agg(blocks.alias("blocks")).where("blocks > 1"), "large-neighbourhoods")
    rows = rows.join(large, "head", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    rows = rows.withColumn("own", F.pmod(F.xxhash64("set", F.lit(5)), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other")}).drop("blocks", "other")
    return rows.repartition("head", "i", "j").sortWithinPartitions("head", "i", "j", "n")


def whole_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of whole groups (head, i, j) of rows that come sorted by them, TOGETHER rows or one group at least."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        held.append(b)
        if sum(x.num_rows for x in held) < TOGETHER:
            continue
        t = pa.Table.from_batches(held).combine_chunks()
        last = np.logical_and.reduce([t.column(c).to_numpy() == t.column(c)[-1].as_py() for c in ("head", "i", "j")])
        end = int(np.argmax(last))  # the last group may go on
        if end:
            yield t.slice(0, end)
        held = t.slice(end).to_batches()
    if held and sum(x.num_rows for x in held):
        yield pa.Table.from_batches(held).combine_chunks()


def first_common(t: pa.Table, group: np.ndarray) -> np.ndarray:
    """Rows of bits, one for each smaller head that several sets of a group are members of, too: two sets without a common bit meet here first."""
    lists = t.column("heads").combine_chunks()
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.chunk(0) if lists.num_chunks else pa.array([], pa.list_(pa.int64()))
    row = np.repeat(np.arange(t.num_rows), pa.compute.list_value_length(lists).to_numpy(zero_copy_only=False))
    heads = lists.flatten().to_numpy()
    smaller = heads < t.column("head").to_numpy()[row]
    row, heads = row[smaller], heads[smaller]
    order = np.lexsort((heads, group[row]))
    row, heads = row[order], heads[order]
    g = group[row]
    new = np.ones(len(row), bool)
    new[1:] = (g[1:] != g[:-1]) | (heads[1:] != heads[:-1])
    run = np.cumsum(new) - 1
    several = (np.bincount(run, minlength=1) > 1)[run] if len(run) else np.zeros(0, bool)
    row, g, run = row[several], g[several], run[several]
    if not len(row):
        return np.zeros((t.num_rows, 1), np.uint64)
    first = np.ones(len(row), bool)
    first[1:] = run[1:] != run[:-1]
    nth = np.cumsum(first) - 1
    group_at = np.ones(len(row), bool)
    group_at[1:] = g[1:] != g[:-1]
    bit = nth - nth[np.flatnonzero(group_at)][np.cumsum(group_at) - 1]
    out = np.zeros((t.num_rows, int(bit.max()) // 64 + 1), np.uint64)
    np.bitwise_or.at(out, (row, bit // 64), np.uint64(1) << (bit % 64).astype(np.uint64))
    return out


def close_pairs(t: pa.Table, sketches: Sketches, limit: tuple[int, int], masked: bool, once: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The pairs of rows of each group, from blocks i and j, whose sizes and sketches don't rule out a link. masked: only where the pair meets first. once: leave out pairs of rows that both were in a pair before."""
    column = {c: t.column(c).to_numpy() for c in ("head", "i", "j", "own", "n")}
    n, rows = column["n"], t.num_rows
    new = np.ones(rows, bool)
    new[1:] = np.logical_or.reduce([column[c][1:] != column[c][:-1] for c in ("head", "i", "j")])
    group = np.cumsum(new)
    bits = first_common(t, group) if masked else None
    inside = column["i"] == column["j"]
    done = np.zeros(rows, bool)
    at, step = np.arange(rows), 0
    while len(at):
        step += 1
        at = at[at + step < rows]
        z = at + step
        at = at[(group[at] == group[z]) & (n[z] * limit[0] <= n[at] * limit[1])]  # sizes rise in a group
        z = at + step
        ok = inside[at] | (column["own"][at] != column["own"][z])
        if once:
            ok &= ~(done[at] & done[z])
        x, y = at[ok], z[ok]
        if not len(x):
            continue
        close = sketches.apart(x, y) <= most_apart(n[x] + n[y], limit)
        x, y = x[close], y[close]
        if masked and len(x):
            meet = ~(bits[x] & bits[y]).any(axis=1)
            x, y = x[meet], y[meet]
        if len(x):
            done[x] = done[y] = True
            yield x, y


def with_near_ones(rows: DataFrame, limit: tuple[int, int], masked: bool) -> DataFrame:
    """set, id, n, sketch and heads: for each set the neighbourhoods in which it has a near one by sketches. rows: head and these (heads only if masked)."""
    kept = ["head", "set", "id", "n", "sketch"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches):
            near = np.zeros(t.num_rows, bool)
            for x, y in close_pairs(t, Sketches(t.column("sketch").to_pylist()), limit, masked, once=True):
                near[x] = near[y] = True
            if near.any():
                yield from t.select(kept).filter(pa.array(near)).combine_chunks().to_batches()

    size = F.octet_length("sketch")
    found = dealt(rows, BLOCK_SKETCHES, size, BLOCK_BYTES).mapInArrow(run, "head long, set binary, id long, n long, sketch binary")
    return found.groupBy("set", "id", "n", "sketch").agg(F.sort_array(F.collect_set("head")).alias("heads"))  # a set has no more heads than keys


def settled(count: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The least row that each of so many rows reaches by the pairs."""
    root = np.arange(count)
    while len(x):
        low = np.minimum(root[x], root[y])
        before = root.copy()
        np.minimum.at(root, root[x], low)
        np.minimum.at(root, root[y], low)
        root = root[root]
        if (root == before).all():
            break
    return root


def overlaps(sets: list[np.ndarray], x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """How many elements the sets x and y share, for each pair: one by one if there are few, else by products of incidence matrices for sets that pairs connect."""
    out = np.zeros(len(x), np.int64)
    rows = np.unique(np.concatenate([x, y]))
    root = settled(len(rows), np.searchsorted(rows, x), np.searchsorted(rows, y))
    of = root[np.searchsorted(rows, x)]
    order = np.argsort(of, kind="stable")
    for mine in np.split(order, np.flatnonzero(np.diff(of[order])) + 1):
        if len(mine) <= FEW_PAIRS:
            for p in mine.tolist():
                a, b = sets[x[p]], sets[y[p]]
                out[p] = (a[np.minimum(np.searchsorted(a, b), len(a) - 1)] == b).sum()
            continue
        left, at_left = np.unique(x[mine], return_inverse=True)
        right, at_right = np.unique(y[mine], return_inverse=True)
        every = np.unique(np.concatenate([left, right]))
        element = np.concatenate([sets[r] for r in every])
        holder = np.repeat(np.arange(len(every)), [len(sets[r]) for r in every])
        by = np.argsort(element, kind="stable")
        element, holder = element[by], holder[by]
        new = np.ones(len(element), bool)
        new[1:] = element[1:] != element[:-1]
        column = np.cumsum(new) - 1
        shared = (np.bincount(column) > 1)[column]  # elements of one set tell nothing
        holder, column = holder[shared], column[shared]
        rank = np.cumsum(np.concatenate([[True], column[1:] != column[:-1]])) - 1 if len(column) else column
        sums = np.zeros((len(left), len(right)), np.float32)  # exact: sets have fewer than 2**24 elements in common here, or else:
        if max(len(sets[r]) for r in every) >= 1 << 24:
            sums = sums.astype(np.float64)
        in_left, in_right = np.searchsorted(every, left), np.searchsorted(every, right)
        for begin in range(0, int(rank[-1]) + 1 if len(rank) else 0, COLUMNS):
            a, z = np.searchsorted(rank, [begin, begin + COLUMNS])
            held = np.zeros((len(every), COLUMNS), sums.dtype)
            held[holder[a:z], rank[a:z] - begin] = 1
            sums += held[in_left] @ held[in_right].T
        out[mine] = sums[at_left, at_right].astype(np.int64)
    return out


def counted_links(rows: DataFrame, limit: tuple[int, int], pairs: bool) -> DataFrame:
    """set, root (the least set reached in a task's group) and links (over all documents of the partners), for the sets of a group that link; or each pair of sets that link (a, b), once. rows: head, set, n, m (documents with the set), heads and elements."""
    def linked(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        offsets = t.column("elements").combine_chunks()
        if isinstance(offsets, pa.ChunkedArray):
            offsets = offsets.chunk(0)
        every = offsets.flatten().to_numpy().view(np.uint64)
        bounds = np.cumsum(np.concatenate([[0], pa.compute.list_value_length(offsets).to_numpy(zero_copy_only=False)])).astype(np.int64)
        sets = [every[a:z] for a, z in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
        found = list(close_pairs(t, Sketches([sketch(u) for u in sets]), limit, masked=True, once=False))
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        x, y = (np.concatenate([p[side].astype(np.int32) for p in found]) for side in (0, 1))
        n = t.column("n").to_numpy()
        fit = (limit[0] + limit[1]) * overlaps(sets, x, y) >= limit[0] * (n[x] + n[y])
        return x[fit].astype(np.int64), y[fit].astype(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches):
            x, y = linked(t)
            if not len(x):
                continue
            of = t.column("set").to_pylist()
            if pairs:
                both = [(min(of[a], of[b]), max(of[a], of[b])) for a, b in zip(x.tolist(), y.tolist(), strict=True)]
                yield pa.RecordBatch.from_pydict({"a": pa.array([p[0] for p in both], pa.binary()), "b": pa.array([p[1] for p in both], pa.binary())})
                continue
            m, root = t.column("m").to_numpy().astype(float), settled(t.num_rows, x, y)
            links = np.bincount(x, weights=m[y], minlength=t.num_rows) + np.bincount(y, weights=m[x], minlength=t.num_rows)
            some = np.flatnonzero(links)
            yield pa.RecordBatch.from_pydict({"set": pa.array([of[r] for r in some], pa.binary()), "root": pa.array([of[root[r]] for r in some], pa.binary()), "links": pa.array(links[some].astype(np.int64), pa.int64())})

    # both bounds count elements: a row has n of them
    return dealt(rows, BLOCK_SETS, F.col("n"), BLOCK_ELEMENTS).mapInArrow(run, "a binary, b binary" if pairs else "set binary, root binary, links long")


def searched(docs: DataFrame, k: int, limit: tuple[int, int], pairs: bool) -> tuple[DataFrame, DataFrame]:
    """Two written tables: doc_id, n and set of each row of docs, and what counted_links() gives."""
    small_batches(docs.sparkSession)
    docs = only(docs, "doc_id", "text")
    table = written(signatures(docs, k, limit), "signatures", free=True)
    plain = written(table.select("doc_id", "n", "set"), "documents-sets")
    sets = written(table.where("keys is not null").select("set", "id", "n", "sketch", "keys").dropDuplicates(["set"]), "sets", free=True)
    discard(table)
    members = memberships(sets)
    rows = members.join(sets.select("set", "id", "n", "sketch").hint("merge"), "id")
    near = written(with_near_ones(rows, limit, masked=False), "near-sets", free=True)
    discard(members, sets)
    again = near.withColumn("head", F.explode("heads"))
    # each with the heads of the first search, which say where a pair meets first
    first = written(with_near_ones(again, limit, masked=True).select("set", F.col("heads").alias("here")), "meeting-sets", free=True)
    many = plain.where("doc_id is not null and n > 0").groupBy("set").agg(F.count(F.lit(1)).alias("m"))
    sent = docs.sparkSession.sparkContext.broadcast(bit_filter(near.join(first.select("set").hint("merge"), "set", "left_semi").select("id")))

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for b in slices(batches, most=SLICE):
            got = [(set_hash(u), u) for u in shingle_sets(b, k) if len(u)]
            wanted = may_hold(sent.value, np.array([set_id(of, len(u), limit) for of, u in got], np.int64))
            got = [(of, u) for (of, u), yes in zip(got, wanted, strict=True) if yes and of not in seen]
            if len(seen) >= REMEMBERED:
                seen.clear()
            seen.update(of for of, _ in got)
            if got:
                yield pa.RecordBatch.from_pydict({"set": pa.array([of for of, _ in got], pa.binary()), "elements": pa.array([u.view(np.int64) for _, u in got], pa.list_(pa.int64()))})

    elements = docs.mapInArrow(whole, "set binary, elements array<long>").dropDuplicates(["set"])
    rows = first.join(near.select("set", "n", "heads").hint("merge"), "set").join(many.hint("merge"), "set")
    rows = written(rows.join(elements.hint("merge"), "set").withColumn("head", F.explode("here")).drop("here"), "meeting-elements", free=True)
    found = written(counted_links(rows, limit, pairs), "links", free=True)
    sent.destroy()
    discard(near, first, rows)
    return plain, found


def links(docs: DataFrame, k: int = 4, limit: tuple[int, int] = (85, 100)) -> tuple[DataFrame, DataFrame]:
    """Two written tables: doc_id, n and set of each row of docs; and a and b, every pair of different sets that link, each once. In a group of near copies the pairs grow with the square of its size; cluster() counts them without making rows of them."""
    return searched(docs, k, limit, pairs=True)


def components(links: DataFrame) -> DataFrame:
    """set and root (the least set it is connected to) of all sets in links (a, b): least labels spread over the links and then jump to the label's own label, until nothing changes."""
    both = written(links.union(links.select("b", "a")).toDF("u", "v").distinct(), "both-ways")
    label = written(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("root")).withColumnRenamed("u", "set"), "labels")
    for _ in range(ROUNDS):
        beside = both.join(label.toDF("v", "beside"), "v").groupBy("u").agg(F.min("beside").alias("beside")).withColumnRenamed("u", "set")
        spread = label.join(beside, "set").select("set", F.col("root").alias("was"), F.least("root", "beside").alias("root"))
        jumped = spread.join(label.toDF("root", "beyond"), "root").select("set", F.least("root", "beyond").alias("root"), "was")
        after = written(jumped, "labels")
        discard(label)
        label = after
        if after.where("root <> was").isEmpty():
            discard(both)
            return after.select("set", "root")
        label = after.select("set", "root")
        label.docloom_folder = after.docloom_folder
    raise RuntimeError("labels haven't settled")


def join(docs: DataFrame, k: int = 4, limit: tuple[int, int] = (85, 100)) -> tuple[DataFrame, DataFrame]:
    """doc_id, n and set of each row of docs (a written table); and, of each set that links to another or that several rows have, m (its rows), links (rows of other sets that link to it), root (a set of its component) and component_id (the smallest doc_id that links reach)."""
    table, found = searched(docs, k, limit, pairs=False)
    roots = components(found.where("set <> root").select(F.col("set").alias("a"), F.col("root").alias("b")))
    sums = found.groupBy("set").agg(F.sum("links").alias("links"))
    sets = table.where("doc_id is not null and n > 0").groupBy("set").agg(F.count(F.lit(1)).alias("m"), F.min("doc_id").alias("first"))
    known = sets.join(roots.hint("merge"), "set", "left").join(sums.hint("merge"), "set", "left").where("m > 1 or root is not null")
    known = written(known.select("set", "m", "first", F.coalesce("root", "set").alias("root"), F.coalesce("links", F.lit(0)).alias("links")), "linked-sets", free=True)
    heads = known.groupBy("root").agg(F.min("first").alias("component_id"))
    return table, known.join(heads.hint("merge"), "root")


def cluster(docs: DataFrame, k: int = 4, limit: tuple[int, int] = (85, 100)) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id that links reach) and n_links (how many other rows link to the row, those with an equal set among them) of each row of docs."""
    table, known = join(docs, k, limit)
    out = table.join(known.select("set", "component_id", (F.col("m") - 1 + F.col("links")).alias("n_links")).hint("merge"), "set", "left")
    linked = F.col("doc_id").isNotNull()  # a row with a null doc_id may have a set that others have
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(linked, F.coalesce("component_id", "doc_id")).alias("component_id"), F.when(linked, F.coalesce("n_links", F.lit(0))).otherwise(F.lit(0)).cast("long").alias("n_links"))


def with_set(docs: DataFrame, k: int) -> DataFrame:
    """The rows of docs, and __set, the hash of each row's set (null for an empty one)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, most=SLICE):
            yield b.append_column("__set", pa.array([set_hash(u) if len(u) else None for u in shingle_sets(b, k)], pa.binary()))

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField("__set", BinaryType())]))


@keeps_names
def keep_one(docs: DataFrame, k: int = 5, limit: tuple[int, int] = (80, 100)) -> DataFrame:
    """The rows of docs, with all columns: of each component one row, of its smallest doc_id (of several sets with that doc_id, the one with the least hash). Rows with a null doc_id or an empty set stay."""
    table, known = join(docs, k, limit)
    found = written(table.where("doc_id is not null and n > 0").join(known.select("set", "root", "component_id").hint("merge"), "set"), "components")
    if table.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").isEmpty():
        gone = found.where("doc_id <> component_id").select("doc_id")
        return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
    # a doc_id may have several texts, so the set decides, too: the rows that go are those of other sets or ids than their component's
    heads = found.groupBy("root").agg(F.min(F.struct("doc_id", "set")).alias("head")).select(F.col("head.doc_id").alias("doc_id"), F.col("head.set").alias("__set"))
    apart = found.select("doc_id", F.col("set").alias("__set")).distinct()
    rows = with_set(docs, k)
    loose = F.col("doc_id").isNull() | F.col("__set").isNull()
    alone = rows.where(~loose).join(apart.hint("merge"), ["doc_id", "__set"], "left_anti")
    heads = rows.where(~loose).join(heads.hint("merge"), ["doc_id", "__set"], "left_semi").dropDuplicates(["doc_id", "__set"])
    return heads.select(*docs.columns).unionByName(alone.select(*docs.columns)).unionByName(rows.where(loose).select(*docs.columns))
