"""A training corpus from raw documents in five stages.

Language ID drops documents whose language can't be told; SimHash near-dedup keeps one document of each group; decontamination drops documents that hold
too much of a benchmark and cuts its passages out of the others; the secret scan masks secrets; the last stage encodes the texts. Every stage
works on all rows of the one before, whose result is written as Parquet in the shared folder and read again.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from waymark.llm import bpe, decontam, langid, secret_scan, simhash
from waymark.llm.common import read, written

RANKS = "byte_bpe_multi_50k.tiktoken"


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected: texts without letters, and those of which no language has 0.3 of the words and under 0.3 of the words are told with a marginal of a half."""
    return langid.keep_known(docs, langid.learn(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Kept: of each group of linked fingerprints the document of the smallest doc_id."""
    return simhash.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Dropped: documents with a twentieth of their words or more in windows of benchmark items. In the others these words are cut out."""
    return decontam.remove_hits(docs, read(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets, in the text and in what is encoded in it, are masked. All documents stay."""
    return secret_scan.redact(docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with token_ids, n_tokens and decoded_sha256, the digest of the text decoded from the ids, which is checked against the text."""
    return bpe.round_trip(docs, public_tokenizers.path(RANKS), public_tokenizers.PATTERN).drop("text")


STAGES = [("language_id", language_id), ("near_dedup", near_dedup), ("decontamination", decontamination), ("secrets", secrets), ("encoding", encoding)]

#: The fitted model, the chained links and the encodings are beyond SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage on the documents of sf_dir."""
    docs = read(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = written(docs)
    return docs
