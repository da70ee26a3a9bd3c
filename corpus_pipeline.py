"""The corpus pipeline: stages over ``documents``, each written as Parquet and read again by the next.

A stage takes ``(spark, docs, sf_dir)``. Its decisions take effect: later stages
see only what it kept. All but the last return the columns of ``documents``.
Each stage handles nulls, empty and repeated rows, empty tables and extra columns
as its operator's docstring says.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from martspark.llm.bpe import default_tokenizer
from martspark.llm.decontaminate import drop_contaminated
from martspark.llm.mixing import sample_mixture
from martspark.llm.quality_rules import keep_good
from martspark.llm.simhash import drop_near_duplicates
from martspark.llm.token_files import token_digests
from martspark.session import ship_package, written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go (op 3)."""
    return keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash group stays (op 5)."""
    ship_package(spark)
    return drop_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go (op 8)."""
    ship_package(spark)
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents sampled so that token shares meet the target margins (op 7)."""
    ship_package(spark)
    return sample_mixture(docs)


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of what is left, digested per document (op 2)."""
    ship_package(spark)
    return token_digests(docs, default_tokenizer())


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("benchmark_decontamination", decontamination),
    ("mixing_weights", mixture),
    ("token_files", token_files),
]

# Hashing, model fitting and tokenizing stages have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = written(docs, f"stage-{name}")
    return docs
