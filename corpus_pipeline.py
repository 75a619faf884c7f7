"""From raw documents to packed training sequences: five stages, each an operator on all that the one before it kept.

Every stage's rows are written to the shared folder and read again, so a lost executor costs a stage's tasks and no more.

Odd rows: a null or empty text fails the quality rules and goes; a null source or language is a value like any other; a null id
is kept and comes after all others; equal rows are one document for the near-duplicates, which keep one of them; of near copies
and repeated passages the smallest id stays (ties by the text's hash); very long texts pass whole; extra columns, of whatever
name, are carried to the last stage; an empty table gives no rows at any stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tiermill.llm import line_frequency, mixing_flow, packing_bm25, passage_chains, simhash_pivots
from tiermill.llm.common import keep, prepare, read
from tiermill.llm.queries import tokenizer_file


def _measured(docs: DataFrame) -> DataFrame:
    """Documents whose ``n_chars`` follows their changed text."""
    return docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else docs


def quality_rules(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Rejected documents go; lines that a host repeats over its documents go from the others."""
    prepare(spark)
    return _measured(line_frequency.clean(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """One document of each group of near copies stays, the one with the smallest id."""
    prepare(spark)
    return simhash_pivots.representatives(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Passages that repeat an earlier document go from the later ones."""
    prepare(spark)
    return _measured(passage_chains.without_passages(docs))


def source_mixing(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents as often as the target weights of their sources ask for."""
    prepare(spark)
    return mixing_flow.mixed(docs)


def packing(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Pieces of token sequences."""
    prepare(spark)
    return packing_bm25.pack(docs, tokenizer_file("byte_bpe_50k.json"))


STAGES = [
    ("quality rules", quality_rules),
    ("SimHash near-duplicates", near_duplicates),
    ("substring dedup", substring_dedup),
    ("mixing sources", source_mixing),
    ("packing", packing),
]

# Fingerprints, chains and tokens are beyond SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = keep(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return docs
