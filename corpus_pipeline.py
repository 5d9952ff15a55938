"""The corpus pipeline: ``documents`` through five stages, each written as Parquet and read
again as the next one's input.

1. language ID drops documents whose language cannot be determined (null or letterless text);
2. exact de-duplication leaves one document of each group of equal texts;
3. near-duplicate removal leaves one document of each component (5-word shingles, 0.8);
4. benchmark decontamination drops documents that hold a test item;
5. byte-level BPE returns the token digests of what is left.

The first four return the columns of ``documents`` unchanged, extra columns included. An
empty table passes through every stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from vetta.llm import byte_bpe, decontaminate, exact_dedup, language_id, near_dedup
from vetta.llm.common import table


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language_id.drop_undetermined(docs)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.drop_exact(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.drop_near(docs)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return byte_bpe.token_digests(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"))


STAGES = [
    ("language_id", language_stage),
    ("exact_dedup", exact_stage),
    ("near_dedup", near_stage),
    ("decontaminate", benchmark_stage),
    ("byte_bpe", token_stage),
]

#: SQL can express neither the trained stage nor the tokeniser.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = table(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
