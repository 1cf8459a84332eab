"""Corpus pipeline: classify, deduplicate, decontaminate, mask secrets, encode.

Each stage takes what the stage before kept, with the columns of ``documents``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.llm import bpe, decontaminate, quality, secrets, simhash
from tideline.llm.common import stored, table, without
from tideline.llm.queries import vocabulary

ORACLE_SQL = None  # trained classifier, fingerprints and tokenizer have no SQL form


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, fitted on the labels, predicts to be good."""
    return quality.good(docs, table(spark, sf_dir, "labels"))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least id of each group that fingerprints of four-word shingles link
    (at most four differing bits)."""
    groups = simhash.near_duplicates(docs, words=4, budget=4)
    return without(docs, stored(groups.filter("doc_id > component_id").select("doc_id"), "repeated"))


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def secrets_masked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with every secret masked; ``n_chars`` follows the text."""
    return secrets.masked(docs).withColumn("n_chars", F.length("text").cast("long"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, and the digests of ids and decoded text."""
    return bpe.encoded(docs, vocabulary("byte_bpe_50k.json"))


STAGES = [
    ("quality", good_quality),
    ("near_duplicates", one_of_each),
    ("decontamination", decontaminated),
    ("secrets", secrets_masked),
    ("encoding", encoded),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in turn over ``documents``, each written to the shared folder and reread."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
