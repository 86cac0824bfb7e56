"""The corpus pipeline: documents of fair quality, without near copies, repeated passages and secrets,
packed into training sequences. Each stage takes (spark, docs, sf_dir) and returns a DataFrame."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from millrace.llm import jaccard, packing, quality, secrets, suffix
from millrace.llm.base import documents, shared_dir, tokenizer_path


def drop_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return quality.stage(spark, docs, sf_dir)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked ones stays (five-word shingles, similarity 0.8)."""
    return jaccard.stage(spark, docs, sf_dir)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes of strings of 200 bytes that occur again leave the texts; every document stays a row."""
    return suffix.stage(spark, docs, sf_dir)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mask in the texts."""
    return secrets.stage(spark, docs, sf_dir)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents, each with its place in a sequence."""
    return packing.stage(spark, docs, tokenizer_path("byte_bpe_50k.json"))


STAGES = [("quality classifier", drop_poor), ("n-gram Jaccard join", drop_near_copies), ("suffix-array dedup", cut_repeats), ("secret scans", mask_secrets), ("packing", pack)]

#: No SQL expresses trained models, linked groups and tokens; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies STAGES to the documents; each stage's result is a Parquet table in the shared folder."""
    docs = documents(spark, sf_dir)
    at = f"{shared_dir(spark)}/millrace-pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        out.write.option("compression", "zstd").parquet(f"{at}/{k}")
        docs = spark.read.schema(out.schema).parquet(f"{at}/{k}")
    return docs
