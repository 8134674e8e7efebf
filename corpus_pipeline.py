"""The corpus pipeline: quality classifier, near-duplicates, decontamination, personal data, packing.

Each stage takes (spark, docs, sf_dir) and gives the next one's documents; all but the last return the
columns of docs. Each works on all rows that the stage before kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from claimweave.llm import crf, decontamination, near_dedup, packing, pii, store


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    model = crf.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return crf.keep_good(docs, model)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, by shingles of 5 words, stays."""
    return near_dedup.keep_one(docs, size=5)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontamination.keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in the texts is replaced by its kind."""
    return pii.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces and their places in sequences of at most 1024 tokens."""
    return packing.pack(docs, keep_ids=False)


STAGES = [("quality_classifier", quality), ("minhash_near_dedup", near_duplicates), ("benchmark_decontamination", decontaminate), ("pii", personal_data), ("packing", pack)]
ORACLE_SQL = None  # tokens, classifier and signatures are beyond SQL; tests hold the stages against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = store.write(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


def queries() -> dict:
    """The pipeline as a query."""
    return {"pipeline": run}


def oracle_sql() -> dict:
    """No stage but the personal data could be said in SQL."""
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
