"""Quality classifier by importance resampling.

Two generative models over hashed n-grams (characters: 1 to 3; words: 1 and 2, both as written): the target from labelled
good documents, the raw one from all documents. A document's log-weight is the log-ratio of its likelihoods, target over raw:
the sum over all its n-grams. Gumbel top-k samples without replacement by these weights: a document's key is its log-weight
plus Gumbel noise (from doc_id and a seed, so a lost task draws the same), and the k largest keys are kept. k, the size of
the sample, is the number of documents whose log-weight reaches a cut, which labelled documents fix: it parts good from junk
(quality not 1) best while at least KEEP of the good reach it. Documents far from the boundary are certain; near it, the
noise decides.

Toxic documents are measured apart, as a few words in a long text hardly move its likelihood: two more generative models, of
toxic and of good documents, say for whole words and their beginnings (STEMS bytes, A-Z lower-cased) which share of documents
holds them, and a document's toxicity is the sum of the WORST largest log-ratios, toxic over good, among what it holds, so
length doesn't dilute it. Where it reaches its own cut, fixed like the other by good and toxic labels, the log-weight is less
by TOXIC, which nothing makes up.

The models and the cuts are fitted on the LABELLED labelled documents whose doc_id hashes lowest, half of them (by another
hash) for the models and half for the cuts, which so see weights as they are for documents that the models haven't seen;
counts, weights and the sampling cover all documents. Good: quality 1 and not toxic, by all labels of the doc_id. Null or empty texts have weight 0
and hold nothing toxic. Without good labels all weights are 0 and all documents are kept. Equal keys at the boundary are all kept, so copies of a
row share their fate. Texts are read whole. An empty table gives no rows. Extra columns are ignored, or carried along by keep().
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm._shared import ALNUM, NOT_SPACE, hash_sample, hashed, keeps_names, mix, only, slices, small_batches, utf8, words, written

#: The target model and the cut are fitted on about so many labelled documents (twice as many at the very most).
LABELLED = 20_000
KEEP = 0.997
#: Losing a share of the good counts so many times as much as keeping that share of the bad.
LOSS = 10
SEED = 20240229
BITS = 16
SMOOTHING = 0.5
#: Lengths in bytes of the beginnings of words that toxicity looks at, beside whole words.
STEMS = (4, 5, 6, 7, 8)
#: Words and beginnings that so many toxic documents hold are in the toxic model, at most so many of them.
TOXIC_SEEN, TOXIC_MOST = 2, 1 << 16
#: Log-ratios from here on count.
TELLING = 1.0
TOXIC = 1e15
#: A document's toxicity adds up so many of its largest log-ratios.
WORST = 3
AS_WRITTEN = mix(np.arange(1, 257, dtype=np.uint64))


def features(b: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """First bucket of a model, buckets and rows of the n-grams of a batch's texts: characters', then words'."""
    texts = [t or "" for t in b.column("text").to_pylist()]
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    row = np.repeat(np.arange(len(texts), dtype=np.int32), [len(t) for t in texts])
    with np.errstate(over="ignore"):
        for n in (1, 2, 3):
            m = len(points) - n + 1
            if m <= 0:
                continue
            key = points[:m].copy()
            for k in range(1, n):
                key = (key << np.uint64(21)) | points[k : m + k]
            key = (key + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)
            key ^= key >> np.uint64(29)
            key *= np.uint64(0xBF58476D1CE4E5B9)
            whole = row[:m] == row[n - 1 :]
            yield 0, (key >> np.uint64(64 - BITS)).astype(np.int64)[whole], row[:m][whole]
        raw, offsets = utf8(b.column("text"))
        s, e, of = words(raw, offsets, NOT_SPACE)
        if len(s):
            h = hashed(raw, s, e, AS_WRITTEN)
            yield 1 << BITS, (h >> np.uint64(64 - BITS)).astype(np.int64), of
            whole = of[1:] == of[:-1]
            pair = mix(h[:-1] * np.uint64(0xD6E8FEB86659FD93) + h[1:])
            yield 1 << BITS, (pair >> np.uint64(64 - BITS)).astype(np.int64)[whole], of[1:][whole]


def stems(b: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Hashes and rows of the words of a batch's texts, and of their beginnings (of words that are longer)."""
    raw, offsets = utf8(b.column("text"))
    s, e, of = words(raw, offsets, ALNUM)
    if not len(s):
        return
    yield hashed(raw, s, e), of
    for n in STEMS:
        longer = e - s > n
        if longer.any():
            yield hashed(raw, s[longer], s[longer] + n), of[longer]


class Toxic:
    """Log-ratios (toxic over good, TELLING or more) of hashes of words and beginnings; a document's toxicity is the sum of its WORST largest, 0 without any."""

    def __init__(self, hashes: np.ndarray, ratios: np.ndarray) -> None:
        order = np.argsort(hashes)
        self.hashes, self.ratios = hashes[order], ratios[order]
        self.cut = np.inf
        self.sieve = np.zeros(1 << 20, bool)
        self.sieve[hashes >> np.uint64(44)] = True

    def measure(self, b: pa.RecordBatch) -> np.ndarray:
        held = [np.zeros(0, np.int64)]
        if len(self.hashes):
            for h, of in stems(b):
                maybe = np.flatnonzero(self.sieve[h >> np.uint64(44)])
                h, of = h[maybe], of[maybe]
                at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
                known = self.hashes[at] == h
                held.append(of[known] * len(self.hashes) + at[known])
        pair = np.unique(np.concatenate(held))  # once a document
        of, ratio = pair // max(1, len(self.hashes)), self.ratios[pair % max(1, len(self.hashes))] if len(pair) else np.zeros(0)
        order = np.lexsort((-ratio, of))
        of, ratio = of[order], ratio[order]
        rank = np.arange(len(of)) - np.searchsorted(of, of)
        return np.bincount(of[rank < WORST], weights=ratio[rank < WORST], minlength=b.num_rows)


def labelled_sample(labels: DataFrame) -> dict[int, tuple[bool, bool]]:
    """doc_id -> quality 1, toxic, of the LABELLED lowest hashes; rows with a null doc_id or no label teach nothing."""
    labels = only(labels, "doc_id", "quality", "toxic").where("doc_id is not null and quality is not null")
    good = F.min(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good")
    toxic = F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic")
    return {r[0]: (r[1], r[2]) for r in hash_sample(labels.groupBy("doc_id").agg(good, toxic), "doc_id", LABELLED).collect()}


def for_target(ids: np.ndarray) -> np.ndarray:
    """Which labelled documents teach the models; the others fix the cuts."""
    return mix(ids.astype(np.int64).astype(np.uint64)) & np.uint64(1) == 0


def fit_toxic(docs: DataFrame, sample: dict[int, tuple[bool, bool]]) -> Toxic:
    """The toxic model, from the labelled documents that teach."""
    spark = docs.sparkSession
    ids = np.array(sorted(i for i, (good, toxic) in sample.items() if good or toxic), np.int64)
    ids = ids[for_target(ids)]
    bad = np.array([sample[int(i)][1] for i in ids], bool)
    none = Toxic(np.zeros(0, np.uint64), np.zeros(0))
    if bad.all() or not bad.any():
        return none
    teachers = spark.sparkContext.broadcast((ids, bad))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, bad = teachers.value
        for b in batches:
            mine = np.array([-1 if i is None else i for i in b.column("doc_id").to_pylist()], np.int64)
            known = np.isin(mine, ids) & np.array([i is not None for i in b.column("doc_id").to_pylist()], bool)
            for one in slices([b.filter(pa.array(known))]):
                toxic = bad[np.searchsorted(ids, one.column("doc_id").to_numpy())]
                found = list(stems(one))
                if not found:
                    continue
                h, of = np.concatenate([x for x, _ in found]), np.concatenate([x for _, x in found])
                order = np.lexsort((of, h))
                h, of = h[order], of[order]
                new = np.concatenate([[True], (h[1:] != h[:-1]) | (of[1:] != of[:-1])])  # once a document
                h, t = h[new], toxic[of[new]]
                heads = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
                of_toxic = np.add.reduceat(t.astype(np.int64), heads)
                every = np.diff(np.append(heads, len(h)))
                yield pa.RecordBatch.from_pydict({"hash": pa.array(h[heads].astype(np.int64), pa.int64()), "toxic": pa.array(of_toxic, pa.int64()), "good": pa.array(every - of_toxic, pa.int64())})

    counted = only(docs, "doc_id", "text").mapInArrow(count, "hash long, toxic long, good long").groupBy("hash").agg(F.sum("toxic").alias("toxic"), F.sum("good").alias("good"))
    ratio = F.log((F.col("toxic") + SMOOTHING) / (bad.sum() + 2 * SMOOTHING)) - F.log((F.col("good") + SMOOTHING) / ((~bad).sum() + 2 * SMOOTHING))
    telling = counted.where(F.col("toxic") >= TOXIC_SEEN).select("hash", ratio.alias("ratio")).where(F.col("ratio") >= TELLING)
    got = telling.orderBy(F.desc("ratio"), "hash").limit(TOXIC_MOST).toPandas()
    return Toxic(got["hash"].to_numpy(np.int64).astype(np.uint64), got["ratio"].to_numpy(float)) if len(got) else none


def fit(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, dict[int, tuple[bool, bool]]]:
    """The log-ratios (characters' buckets, then words') and the labelled sample."""
    spark = docs.sparkSession
    small_batches(spark)
    sample = labelled_sample(labels)
    ids = np.array(sorted(i for i, (g, toxic) in sample.items() if g and not toxic), np.int64)
    good = spark.sparkContext.broadcast(ids[for_target(ids)])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, 2 << BITS), np.int64)
        for b in slices(batches, most=1 << 20):
            ids = np.array([-1 if i is None else i for i in b.column("doc_id").to_pylist()], np.int64)
            known = np.isin(ids, good.value) & np.array([i is not None for i in b.column("doc_id").to_pylist()])
            for base, bucket, row in features(b):
                sums[0, base : base + (1 << BITS)] += np.bincount(bucket, minlength=1 << BITS)
                sums[1, base : base + (1 << BITS)] += np.bincount(bucket[known[row]], minlength=1 << BITS)
        at = np.flatnonzero(sums[0])
        yield pa.RecordBatch.from_pydict({"bucket": pa.array(at, pa.int32()), "raw": pa.array(sums[0, at], pa.int64()), "target": pa.array(sums[1, at], pa.int64())})

    counted = only(docs, "doc_id", "text").mapInArrow(count, "bucket int, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))
    sums = np.zeros((2, 2 << BITS))
    got = counted.toPandas()  # a row for each bucket at most
    sums[0, got["bucket"]], sums[1, got["bucket"]] = got["raw"], got["target"]
    if not sums[1].sum():
        return np.zeros(2 << BITS), sample
    parts = []
    for half in (sums[:, : 1 << BITS], sums[:, 1 << BITS :]):
        p = np.log(half + SMOOTHING) - np.log(half.sum(axis=1, keepdims=True) + SMOOTHING * (1 << BITS))
        parts.append(p[1] - p[0])
    return np.concatenate(parts), sample


def log_weights(b: pa.RecordBatch, ratios: np.ndarray) -> np.ndarray:
    """The log-ratio of each row's likelihoods, target over raw."""
    total = np.zeros(b.num_rows)
    for base, bucket, row in features(b):
        total += np.bincount(row, weights=ratios[base + bucket], minlength=b.num_rows)
    return total


def noise(ids: list[int | None], seed: int = SEED) -> np.ndarray:
    """Gumbel noise of each doc_id (a null one as -1)."""
    with np.errstate(over="ignore"):
        h = mix(mix(np.array([-1 if i is None else i for i in ids], np.int64).astype(np.uint64)) + mix(np.array([seed], np.uint64)))
    u = ((h >> np.uint64(12)).astype(float) + 0.5) / 2.0**52
    return -np.log(-np.log(u))


def weigh(docs: DataFrame, ratios: np.ndarray, toxic: Toxic, seed: int = SEED) -> DataFrame:
    """doc_id, log_weight (without regard to toxicity), toxicity and noise of each row of docs."""
    model = docs.sparkSession.sparkContext.broadcast((ratios, toxic))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ratios, toxic = model.value
        for b in slices(batches, most=1 << 20):
            yield pa.RecordBatch.from_pydict({"doc_id": b.column("doc_id"), "log_weight": pa.array(log_weights(b, ratios), pa.float64()), "toxicity": pa.array(toxic.measure(b), pa.float64()), "noise": pa.array(noise(b.column("doc_id").to_pylist(), seed), pa.float64())})

    return only(docs, "doc_id", "text").mapInArrow(run, "doc_id long, log_weight double, toxicity double, noise double")


def best_cut(weights: np.ndarray, good: np.ndarray) -> float:
    """The cut that parts good from others best, among those that at least KEEP of the good reach; no cut without both kinds."""
    if not good.any() or good.all():
        return -np.inf
    order = np.argsort(weights, kind="stable")
    w, g = weights[order], good[order]
    # a cut at w[i] loses what stands before i
    lost_good, lost_bad = np.cumsum(g) - g, np.cumsum(~g) - ~g
    first = np.concatenate([[True], w[1:] != w[:-1]])
    gain = np.where(first & (lost_good <= (1 - KEEP) * g.sum()), lost_bad / (~g).sum() - LOSS * lost_good / g.sum(), -1.0)
    i = int(np.argmax(gain))
    return float((w[i] + w[i - 1]) / 2) if i else -np.inf


def kth_largest(scored: DataFrame, k: int) -> float:
    """The k-th largest key, exactly, by narrowing a histogram of at most 4096 bins a round."""
    low, high, n = scored.agg(F.min("key"), F.max("key"), F.count(F.lit(1))).first()
    if k >= n:
        return -np.inf
    above = 0
    while low < high:
        width = (high - low) / 4096
        if not width or low + width == low:
            break
        bin_of = F.least(F.lit(4095), F.floor((F.col("key") - low) / width)).alias("bin")
        inside = scored.where(F.col("key").between(low, high)).groupBy(bin_of).agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("a"), F.max("key").alias("b"))
        for r in sorted(inside.collect(), key=lambda r: -r["bin"]):
            if above + r["n"] >= k:
                low, high = r["a"], r["b"]
                break
            above += r["n"]
    return high


def choose(docs: DataFrame, labels: DataFrame, seed: int = SEED) -> tuple[DataFrame, np.ndarray, Toxic, float]:
    """doc_id, log_weight and key of all documents (of a written table), the models, and the least key that is kept."""
    ratios, sample = fit(docs, labels)
    toxic = fit_toxic(docs, sample) if ratios.any() else Toxic(np.zeros(0, np.uint64), np.zeros(0))
    weighed = written(weigh(docs, ratios, toxic, seed), "quality-scores")
    spark = docs.sparkSession
    cut = -np.inf
    if sample:
        ids = np.array(list(sample), np.int64)
        known = F.broadcast(spark.createDataFrame([(int(i), *sample[int(i)]) for i in ids[~for_target(ids)]], "doc_id long, good boolean, bad boolean"))  # LABELLED rows at most
        fitted = weighed.join(known, "doc_id").groupBy("doc_id", "good", "bad").agg(F.max("log_weight").alias("w"), F.max("toxicity").alias("t")).toPandas()
        good, bad = fitted["good"].to_numpy(bool), fitted["bad"].to_numpy(bool)
        if len(fitted):
            cut = best_cut(fitted["w"].to_numpy()[~(good & bad)], good[~(good & bad)])  # junk apart from toxic
            toxic.cut = -best_cut(-fitted["t"].to_numpy()[good | bad], ~bad[good | bad])
    weight = F.col("log_weight") - F.when(F.col("toxicity") > F.lit(float(toxic.cut)), F.lit(TOXIC)).otherwise(0.0)
    scored = weighed.select("doc_id", weight.alias("log_weight"), (weight + F.col("noise")).alias("key"))
    if cut == -np.inf and toxic.cut == np.inf:
        return scored, ratios, toxic, -np.inf
    k = weighed.where((F.col("log_weight") >= cut) & (F.col("toxicity") <= F.lit(float(toxic.cut)))).count()
    return scored, ratios, toxic, kth_largest(scored, k) if k else np.inf


def classify(docs: DataFrame, labels: DataFrame, seed: int = SEED) -> DataFrame:
    """doc_id, log_weight, key and kept of each row of docs."""
    scored, _, _, least = choose(docs, labels, seed)
    return scored.withColumn("kept", F.col("key") >= F.lit(float(least)))


@keeps_names
def keep(docs: DataFrame, labels: DataFrame, seed: int = SEED) -> DataFrame:
    """The rows of docs that the sample keeps, with all their columns; texts are not shuffled."""
    _, ratios, toxic, least = choose(docs, labels, seed)
    model = docs.sparkSession.sparkContext.broadcast((ratios, toxic))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ratios, toxic = model.value
        for b in slices(batches, most=1 << 20):
            weight = log_weights(b, ratios) - np.where(toxic.measure(b) > toxic.cut, TOXIC, 0.0)
            yield b.filter(pa.array(weight + noise(b.column("doc_id").to_pylist(), seed) >= least))

    return docs.mapInArrow(run, docs.schema)
