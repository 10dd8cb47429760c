"""The corpus pipeline: documents that fail the quality rules or have no language go, of equal and of near-equal documents one
stays, and the rest is packed into training sequences. Part of the subpackage llm."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from millrace.llm.common import written
from millrace.llm.exact_dedup import keep_exact
from millrace.llm.language_id import fit, keep_identified
from millrace.llm.packing import packed
from millrace.llm.quality_rules import Verdicts
from millrace.llm.registry import tokenizer
from millrace.llm.simhash import keep_near


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that neither the base rules nor the certified cutoffs reject."""
    return Verdicts(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), carry=True).keep()


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents in which a language is recognised."""
    return keep_identified(docs, fit(docs))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts: that with the largest doc_id."""
    return keep_exact(docs)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of linked fingerprints: that with the smallest doc_id."""
    return keep_near(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents that are left, with their sequences."""
    return packed(docs, tokenizer("word_bpe_49k.json"))


STAGES = [
    ("quality_rules", quality_rules),
    ("language_id", language_id),
    ("exact_dedup", exact_dedup),
    ("simhash_near_dedup", simhash_near_dedup),
    ("packing", packing),
]
#: The network of language_id isn't expressible in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
