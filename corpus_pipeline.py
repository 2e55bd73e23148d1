"""A corpus pipeline: five operators of gridloom.llm, each on what the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm import bpe, decontaminate, near_copies, pii, quality
from gridloom.llm.common import discard, materialise, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go; it learns from its input and `labels`, as op10 does."""
    return quality.accepted(docs, quality.fit(docs, table(spark, sf_dir, "labels"), ~quality.held_out()))


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, the one with the smallest id: SimHash proposes, shingles decide."""
    return near_copies.one_of_each(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    return decontaminate.uncontaminated(docs, table(spark, sf_dir, "benchmark"))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and secrets give way to surrogates; n_chars follows the new text."""
    return pii.pseudonymise(docs).withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, and the digest of what they decode to."""
    encoded = bpe.encode(docs, bpe.tokenizer_file())
    return encoded.select("doc_id", "n_tokens", "ids", F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"))


STAGES = [
    ("quality", quality_stage),
    ("simhash", simhash_stage),
    ("decontamination", decontamination_stage),
    ("pii", pii_stage),
    ("bpe", bpe_stage),
]

#: SQL can't express the classifier, the fingerprints or the surrogates.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to `documents`; each result but the last is written to the shared folder and read again.

    A result is removed once the next one is written; the last but one stays, because the returned table reads it.
    """
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        following = materialise(stage(spark, docs, sf_dir))
        discard(docs)
        docs = following
    return STAGES[-1][1](spark, docs, sf_dir)
