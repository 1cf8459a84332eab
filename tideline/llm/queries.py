"""Registered queries of the text operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.llm import bpe, conversations, decontaminate, fim, licenses, minhash, pii, quality, rules, secrets, simhash, token_counts, toxicity
from tideline.llm.common import table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def vocabulary(name: str) -> str:
    """Place of a public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate component of every document."""
    out = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex(F.col("fps")[0]), 16, "0")).alias("fingerprint"), "component_id")


@query
def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of every document under a word-level BPE vocabulary."""
    return token_counts.token_counts(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


@query
def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded with a byte-level BPE vocabulary."""
    return bpe.round_trip(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


@query
def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probability that each document is toxic."""
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every document."""
    return pii.detect(table(spark, sf_dir, "documents"))


@query
def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, and where."""
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict of the quality rules on every document."""
    out = rules.screen(table(spark, sf_dir, "documents"))
    return out.drop("rejected_by")  # which rule was first depends on measured costs, the verdict doesn't


@query
def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probability that each document is of high quality."""
    return quality.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document, through nested encodings."""
    return secrets.scan_documents(table(spark, sf_dir, "documents"))


@query
def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Known licenses that a document, or a line of it, is."""
    return licenses.scan(table(spark, sf_dir, "documents"))

@query
def op11_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Component of every document over links at a shingle similarity of 0.85."""
    return minhash.near_copies(table(spark, sf_dir, "documents"))


@query
def op12_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults of every damaged conversation, and its cheapest repair."""
    rows = table(spark, sf_dir, "conversations")
    return conversations.digests(conversations.repair(conversations.damaged(rows), every=rows.select("conv_id")))


@query
def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document cut into prefix, middle and suffix, and restored."""
    out = fim.fill_in_middle(table(spark, sf_dir, "documents"))
    whole = fim.restored(F.col("form"), F.col("output"))
    return out.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        F.sha2(F.col("output").cast("binary"), 256).alias("output_sha256"), F.sha2(whole.cast("binary"), 256).alias("restored_sha256"),
    )


@query
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus pipeline over ``documents``."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


ORACLE["op10_licenses"] = licenses.oracle()
ORACLE["op13_fill_in_middle"] = fim.oracle()
