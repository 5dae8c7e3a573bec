"""The corpus pipeline: documents in, token counts and digests of a clean, deduplicated corpus out.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it kept; all but the last return the
columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lexigrid.llm import bpe, decontaminate, quality, secrets, simhash
from lexigrid.llm.common import bounded_batches, stage, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a quality rule rejects go, null and empty texts among them; rows alike go or stay together."""
    bounded_batches(spark)
    return quality.keep_good(docs)


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, that with the smallest doc_id; rows of a null doc_id stay."""
    bounded_batches(spark)
    return simhash.keep_first(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which one word in twenty or more is in a benchmark passage go; null and empty texts have no such word."""
    return decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays, its secrets masked in the text; null texts stay null, n_chars is counted anew."""
    return secrets.redact(docs, path_col="source")


def bpe_round_trip(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each document: its tokens, and the digests of its ids and of the decoded text; null texts have no token."""
    bounded_batches(spark)
    return bpe.round_trip_digests(docs, bpe.vocabulary_path())


STAGES = [
    ("quality_rules", quality_rules),
    ("simhash_dedup", simhash_dedup),
    ("decontamination", decontamination),
    ("secret_scan", secret_scan),
    ("bpe", bpe_round_trip),
]
#: Fingerprints, the forest and the tokenizer are beyond SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole of documents, each written and read again.  An empty table gives an empty result; further
    columns pass through all stages but the last."""
    docs = table(spark, sf_dir, "documents")
    for name, work in STAGES:
        docs = stage(work(spark, docs, sf_dir), name)
    return docs
