"""The queries of the training-data operators, with production parameters over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import crf, decontamination, licenses, near_dedup, packing, pii, quality_rules, sharding, sql, suffix_dedup, token_count


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 1024 tokens."""
    return packing.pack(documents(spark, sf_dir), keep_ids=False)


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated passages removed from every document."""
    return suffix_dedup.remove(documents(spark, sf_dir), with_bytes=False)


def op3_quality_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of every document."""
    docs = documents(spark, sf_dir)
    return crf.score(docs, crf.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document."""
    found = pii.find(documents(spark, sf_dir))

    def joined(spans):
        rank = F.array_position(F.array(*map(F.lit, pii.KINDS)), spans["kind"])
        return F.struct(rank.alias("k"), spans["start"].alias("s"), spans["end"].alias("e"))

    def text(column):
        ordered = F.array_sort(F.transform(column, joined))
        return F.array_join(F.transform(ordered, lambda x: F.concat_ws(":", F.element_at(F.array(*map(F.lit, pii.KINDS)), x["k"].cast("int")), x["s"], x["e"])), ",")

    def count(kind):
        return F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(kind) for kind in pii.KINDS]
    return found.select("doc_id", *counts, F.sha2(text("base"), 256).alias("base_sha256"), text(F.concat("base", "added")).alias("spans"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule measures of every document, and whether it and its host pass."""
    return quality_rules.apply_rules(documents(spark, sf_dir)).drop("host_rate")


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-duplicate component of every document."""
    return near_dedup.link(documents(spark, sf_dir), size=2)


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of every document."""
    return token_count.count_tokens(documents(spark, sf_dir))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents dealt into 24 shards."""
    return sharding.shard(documents(spark, sf_dir))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases and notices in every document."""
    return licenses.scan(documents(spark, sf_dir))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The benchmark items found in documents: a row for each document and item."""
    return decontamination.find_leaks(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def queries() -> dict:
    """Query name to callable."""
    return {f.__name__: f for f in (op1_packing, op2_suffix_dedup, op3_quality_crf, op4_pii, op5_quality_rules, op6_near_dedup, op7_token_counts, op8_sharding, op9_license_scan, op10_decontamination)}


def oracle_sql() -> dict:
    """Query name to DuckDB SQL, where SQL can express it."""
    return sql.oracle_sql()
