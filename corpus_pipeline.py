"""From raw documents to a training mix: five stages, each on what the one before kept."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from furrow.llm import decontam, mixing, neardup, pii, quality
from furrow.llm.queries import HOST_LIMIT, PII_KEY
from furrow.session import shared_root

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _documents(df: DataFrame) -> DataFrame:
    """The columns of documents, with n_chars of the text as it is now."""
    return df.selectExpr("doc_id", "text", "lang", "source", "CAST(length(text) AS bigint) AS n_chars")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Boilerplate lines go from the texts, and documents that the rules reject go."""
    return _documents(quality.kept_documents(docs.select(*COLUMNS), max_docs=HOST_LIMIT))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates stays."""
    return _documents(neardup.one_of_each(docs.select(*COLUMNS)))


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return _documents(decontam.without_leaks(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet")))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by surrogates; all documents stay."""
    return _documents(pii.pseudonymise(docs.select(*COLUMNS), PII_KEY, added=False))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sampled documents, with their topic and probability."""
    mixed = mixing.mix(docs.select(*COLUMNS)).where("sampled")
    return mixed.select(*COLUMNS, "n_tokens", "topic", "probability")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("ngram_jaccard_join", near_duplicates),
    ("benchmark_decontamination", benchmark_leaks),
    ("pii_surrogates", personal_data),
    ("target_mixing", mixture),
]

# Alignment, keyed surrogates and raking can't be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another, each written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = f"{shared_root(spark)}/furrow/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs


QUERIES = {"pipeline": run}
ORACLE = {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
