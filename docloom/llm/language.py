"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training counts, per language, the hashed n-grams (1 to 3 characters of the lower-cased text) of every training row; the
counts of all tasks are added up in Spark, and the smoothed log-probabilities (buckets x languages, at most MOST_LANGUAGES
languages) are broadcast. Scoring adds up, in numpy, the rows of that matrix that a text's n-grams select.

Null texts and texts without any letter get `und` and score 0. If there is nothing to learn from, every text gets `und`.
Texts are read whole. Ties go to the language that sorts first. Repeated rows each give a row; extra columns, also ones whose
names clash, are ignored. An empty table gives no rows. More than MOST_LANGUAGES labels are an error: the matrix, which every
worker holds, has a column of 256 KB for each, and ISO 639-1 knows fewer than 200.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.llm._shared import only, slices, small_batches

BUCKETS = 1 << 15
ORDERS = (1, 2, 3)
SMOOTHING = 0.5
#: Languages beyond this number are refused, as the broadcast matrix grows with them.
MOST_LANGUAGES = 1000
LETTER = regex.compile(r"\p{L}")


def has_letter(text: str | None) -> bool:
    return bool(text) and LETTER.search(text) is not None


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of all n-grams of the texts, and the text each belongs to. No n-gram crosses texts."""
    lowered = [t.lower() for t in texts]
    points = np.frombuffer("".join(lowered).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    lengths = np.array([len(t) for t in lowered], np.int64)
    row = np.repeat(np.arange(len(texts), dtype=np.int32), lengths)
    found, owner = [], []
    with np.errstate(over="ignore"):
        for n in ORDERS:
            if len(points) < n:
                continue
            key = points[: len(points) - n + 1].copy()
            for k in range(1, n):
                key = (key << np.uint64(21)) | points[k : len(points) - n + 1 + k]
            key = (key + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)
            key ^= key >> np.uint64(29)
            key *= np.uint64(0xBF58476D1CE4E5B9)
            whole = row[: len(row) - n + 1] == row[n - 1 :]
            found.append((key >> np.uint64(49)).astype(np.int32)[whole])
            owner.append(row[: len(row) - n + 1][whole])
    if not found:
        return np.zeros(0, np.int32), np.zeros(0, np.int32)
    return np.concatenate(found), np.concatenate(owner)


def train(rows: DataFrame, label: str = "lang") -> tuple[list[str], np.ndarray]:
    """The languages, sorted, and the matrix of log-probabilities (buckets + 1 rows: the last holds the priors). rows: text and label; rows with a null label or no letter teach nothing."""
    spark = rows.sparkSession
    small_batches(spark)
    rows = only(rows, "text", label).where(F.col(label).isNotNull())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for b in slices(batches, most=1 << 20):
            by: dict[str, list[str]] = {}
            for text, lang in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if has_letter(text):
                    by.setdefault(lang, []).append(text)
            for lang, texts in by.items():
                if lang not in sums:
                    if len(sums) >= MOST_LANGUAGES:
                        raise ValueError(f"more than {MOST_LANGUAGES} languages")
                    sums[lang] = np.zeros(BUCKETS + 1, np.int64)
                found, _ = grams(texts)
                sums[lang][:BUCKETS] += np.bincount(found, minlength=BUCKETS)
                sums[lang][BUCKETS] += len(texts)
        for lang, counts in sums.items():
            at = np.flatnonzero(counts)
            yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(at), pa.string()), "bucket": pa.array(at, pa.int32()), "n": pa.array(counts[at], pa.int64())})

    counted = rows.mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    parts = counted.groupBy("lang").agg(F.collect_list(F.struct("bucket", "n")).alias("counts")).limit(MOST_LANGUAGES + 1)  # BUCKETS + 1 a language
    by = {}
    for r in parts.toLocalIterator():
        by[r["lang"]] = np.zeros(BUCKETS + 1)
        by[r["lang"]][[x["bucket"] for x in r["counts"]]] = [x["n"] for x in r["counts"]]
    if len(by) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    langs = sorted(by)
    if not langs:
        return [], np.zeros((BUCKETS + 1, 0))
    all_counts = np.stack([by[x] for x in langs], axis=1)
    weights = all_counts[:BUCKETS] + SMOOTHING
    matrix = np.log(weights) - np.log(weights.sum(axis=0))
    priors = np.log(all_counts[BUCKETS] / all_counts[BUCKETS].sum())
    return langs, np.vstack([matrix, priors])


def score(texts: list[str], matrix: np.ndarray) -> np.ndarray:
    """The log-joint of each text with each language."""
    out = np.tile(matrix[BUCKETS], (len(texts), 1))
    found, owner = grams(texts)
    for k in range(matrix.shape[1]):
        out[:, k] += np.bincount(owner, weights=matrix[found, k], minlength=len(texts))
    return out


def identify(docs: DataFrame, langs: list[str], matrix: np.ndarray) -> DataFrame:
    """doc_id, lang_pred and score (the posterior of lang_pred, from 0 to 1) of every row of docs (doc_id, text)."""
    spark = docs.sparkSession
    small_batches(spark)
    model = spark.sparkContext.broadcast((langs, matrix))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, m = model.value
        columns = [np.ascontiguousarray(m[:, k]) for k in range(len(names))]
        m = np.stack(columns, axis=1) if columns else m
        for b in slices(batches, most=1 << 20):
            texts = b.column("text").to_pylist()
            known = [i for i, t in enumerate(texts) if names and has_letter(t)]
            pred, sure = ["und"] * len(texts), np.zeros(len(texts))
            if known:
                joint = score([texts[i] for i in known], m)
                best = joint.argmax(axis=1)
                odds = np.exp(joint - joint.max(axis=1, keepdims=True))
                posterior = odds[np.arange(len(best)), best] / odds.sum(axis=1)
                for i, k, p in zip(known, best, posterior, strict=True):
                    pred[i], sure[i] = names[k], p
            yield pa.RecordBatch.from_pydict({"doc_id": b.column("doc_id"), "lang_pred": pa.array(pred, pa.string()), "score": pa.array(sure, pa.float64())})

    return only(docs, "doc_id", "text").mapInArrow(run, "doc_id long, lang_pred string, score double")


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether a document is kept from training: crc32 of doc_id as text, modulo 3, is 1. A null doc_id teaches nothing either."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(True))


def predict_documents(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred and score of all documents, learnt from those that are not held out."""
    docs = only(docs, "doc_id", "text", "lang")
    langs, matrix = train(docs.where(~held_out()))
    return identify(docs, langs, matrix).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
