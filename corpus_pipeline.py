"""From raw documents to packed sequences: five stages, each one operator over all rows.

Quality rules drop what they reject, line dedup drops repeated lines, near-dedup keeps
one document of each group, secret scans mask what they find, and best-fit packing
gives the pieces in their sequences. Every stage is written as Parquet in the shared
folder and read again, so a lost executor repeats at most one stage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from postlens.llm import line_dedup, near_dedup, packing, quality, secrets
from postlens.llm.catalog import BPE_FILE, RANK_FILE
from postlens.plans.registry import table
from postlens.session import written

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _measured(docs: DataFrame) -> DataFrame:
    """``n_chars`` follows the text, where the table has it."""
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) \
        if "n_chars" in docs.columns else docs


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep; null and empty texts go."""
    judged = quality.quality_rules(docs, prefix="_quality_")
    return judged.where("_quality_kept").select(*docs.columns)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that a document of smaller id holds."""
    return _measured(line_dedup.dedup_lines(docs, prefix="_lines_").select(*docs.columns))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest document of every near-duplicate group, at similarity 0.8 on five words."""
    return near_dedup.drop_near_duplicates(docs, near_dedup.Similarity(percent=80))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced by a mask."""
    return _measured(secrets.redact(docs, RANK_FILE))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece of at most 1024 tokens, with its sequence and place there."""
    return packing.pack_documents(docs, BPE_FILE, 1024, 2)


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", keep_quality), ("line_dedup", drop_lines), ("near_dedup", drop_near_duplicates),
    ("secret_scan", mask_secrets), ("best_fit_packing", pack),
]

# tokens and zstandard have no SQL form; the tests compare with a brute-force version
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole ``documents`` table."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
