"""A training-data pipeline over the documents table, one operator a stage.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next stage's
``docs``; :func:`run` does so in the shared folder and drops what the next stage has read. All but the last stage return the
columns of ``docs`` as they came, extra ones of any name included; the last returns the encoded documents. An empty table
gives an empty result at every stage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from gritsieve.llm import bpe, decontaminate, near_dup, quality, secrets
from gritsieve.llm.shared import Stored


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that the quality classifier rejects, and null texts and those without a word.

    Texts of any length are scored whole; equal texts, also of repeated rows, go or stay together; a null id is scored like
    any other. Without labels of both classes only texts without a word go.
    """
    return quality.keep_good(docs, quality.fit_model(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document of least id of every group of near duplicates.

    Null texts stay; texts without a word are in a group with exact copies alone; a null id counts as greater than all
    others; of equal ids the least text hash stays; of exactly repeated rows one stays.
    """
    return near_dup.dedup(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a benchmark item.

    Null and empty texts and texts of fewer than 3 words stay; texts of any length are searched whole; equal texts go or stay
    together, whatever their ids; null items and items of fewer than 3 words match nothing.
    """
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mask secrets in the texts; every document stays.

    Null and empty texts stay as they are; texts and tokens of any length are tested whole; equal texts are masked alike;
    ``n_chars`` follows a text that changes and is left as it was, null included, where none does.
    """
    return secrets.redact(docs)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encode the texts and check that they decode to the same bytes.

    One row for each of ``docs``, repeated ones included; a null text has null tokens, an empty one none; texts of any length
    are encoded whole; a null id stays null; other columns don't count.
    """
    return bpe.encode(docs)


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality_rules),
    ("simhash_near_dedup", near_duplicates),
    ("benchmark_decontamination", benchmark_decontamination),
    ("secret_scans", secret_scans),
    ("byte_bpe", byte_bpe),
]

#: Training a model, neighbour search and BPE have no SQL; tests hold the rows against a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over the whole documents table."""
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for _, stage in STAGES[:-1]:
        kept = Stored(stage(spark, docs, sf_dir))
        if last is not None:
            last.drop()
        docs, last = kept.df, kept
    return STAGES[-1][1](spark, docs, sf_dir)
