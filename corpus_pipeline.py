"""A corpus pipeline of five stages: what passes the quality rules, one of each group of near duplicates, without benchmark passages and secrets, packed.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept; run() writes each stage's rows to the shared folder and rereads them.

Null and empty texts fail the quality rules. Rows that share a doc_id, or have none, are rows of their own: of equal ones, one stays, like any copy. Other
columns come through, whatever their names (those that start with two underscores are the stages' own). Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tribunal.llm import decontamination, jaccard, packing, quality, secrets
from tribunal.llm.common import staged, table
from tribunal.llm.tokens import tokenizer_path


def _measured(docs: DataFrame) -> DataFrame:
    """n_chars follows the text."""
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a quality rule rejects go."""
    return quality.keep_good(docs)


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: shingles of five words, similarity 0.8."""
    return jaccard.keep_one(docs, jaccard.Shingles(5, 80))


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages are cut; documents that mostly consist of them go."""
    return _measured(decontamination.cleaned(docs, table(spark, sf_dir, "benchmark")))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are blacked out."""
    return _measured(secrets.redact(docs))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 2048 tokens."""
    return packing.pack(docs, tokenizer_path("word_bpe_49k.json"))


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", jaccard_join),
    ("benchmark decontamination", benchmark_decontamination),
    ("secret scans", secret_scan),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES[:-1]):
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{k}")
    return STAGES[-1][1](spark, docs, sf_dir)


#: The Jaccard join's components and the tokenizer are beyond SQL; tests compare the stages with brute force.
ORACLE_SQL = None
