"""The corpus pipeline: documents -> quality classifier -> near copies -> benchmark decontamination -> secrets -> tokens.

Each stage takes (spark, docs, sf_dir), docs being what the stage before kept, and returns a DataFrame; all but the last
return the columns of documents. run() writes each stage's result into the shared folder and reads it for the next.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from docloom.llm import bpe, decontaminate, jaccard, quality, secrets
from docloom.llm._shared import discard, written


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the importance sample keeps."""
    return quality.keep(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by Jaccard similarity of at least 0.8 on five-word shingles."""
    return jaccard.keep_one(docs, 5, (80, 100))


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of the benchmark are cut out."""
    return decontaminate.remove(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark."""
    return secrets.redact(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids and the digests of ids and of the decoded text."""
    return bpe.encode_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality classifier", good_documents),
    ("near copies", one_of_near_copies),
    ("benchmark decontamination", without_benchmark),
    ("secrets", without_secrets),
    ("tokens", tokens),
]

#: The models of the first and fourth stage can't be expressed in SQL; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; the result is the last stage's."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = None
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        if kept is not None:
            discard(kept)  # what the stage before kept has been read
        kept = docs
    return STAGES[-1][1](spark, docs, sf_dir)
