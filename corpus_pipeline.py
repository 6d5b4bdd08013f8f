"""Training-corpus pipeline: quality filter, line dedup, near-duplicate
removal, benchmark decontamination and tokenisation.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run``
writes each stage's rows as Parquet into the shared folder and reads them
back as the next one's documents, so a lost executor costs one stage's tasks
at most.  All but the last stage return the columns of ``documents``.

The classifier is trained and the components are found iteratively, which SQL
cannot express; ORACLE_SQL is None and the tests compare ``run`` with a
brute-force version.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from envspark.llm import bpe, decontaminate, jaccard_join, line_dedup, quality
from envspark.llm.common import table
from envspark.llm.registry import RANKS
from envspark.session import checkpoint_dir

ORACLE_SQL = None


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents the classifier ranks below the threshold."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def line_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take repeated lines out; n_chars follows the text."""
    return line_dedup.remove_lines(docs, length_col="n_chars" if "n_chars" in docs.columns else None, exact_chars=1)


def near_duplicate_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five-word shingles,
    similarity of 0.8 or more) stays."""
    return jaccard_join.keep_first(docs, n=5, share=80)


def leak_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that hold a benchmark item."""
    return decontaminate.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document left."""
    return bpe.encode_texts(docs, public_tokenizers.path(RANKS), public_tokenizers.PATTERN)


STAGES = [
    ("quality", quality_filter),
    ("line_dedup", line_filter),
    ("near_duplicates", near_duplicate_filter),
    ("decontaminate", leak_filter),
    ("tokenise", tokenise),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; the last stage's rows."""
    docs = table(spark, sf_dir, "documents")
    top = f"{checkpoint_dir(spark)}/corpus-pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        out = f"{top}/{name}"
        stage(spark, docs, sf_dir).write.parquet(out)
        docs = spark.read.parquet(out)
    return docs
