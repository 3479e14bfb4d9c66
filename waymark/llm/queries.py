"""The registered queries of the text operators: each applies its operator, with production parameters, to the whole table."""

from __future__ import annotations

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.llm import alignment, bpe, chat, decontam, exact_dedup, html_text, langid, quality, repeats, secret_scan, simhash, token_count, variants
from waymark.llm.common import read

RANKS, VOCABULARY, BYTE_LEVEL = "byte_bpe_multi_50k.tiktoken", "piece_bpe_32k.model", "byte_bpe_50k.json"


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(read(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hexadecimal("fp").alias("fingerprint"), "component_id")


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    hits = decontam.find_hits(docs, read(spark, sf_dir, "benchmark"))
    return hits.select(
        "doc_id",
        F.col("hit_words").alias("n_words"),
        decontam.hit_count().alias("n_hit"),
        F.size("hit_items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", F.array_sort("hit_items")).cast("binary"), 256).alias("items_sha256"),
        decontam.contaminated().alias("contaminated"),
    )


def op3_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = repeats.remove_repeats(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return cut.select(
        "doc_id",
        "n_bytes",
        (F.col("n_bytes") - F.length("kept")).alias("n_removed"),
        F.size("removed").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
        F.make_valid_utf8(F.col("kept").cast("string")).alias("text"),
    )


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.render_chats(read(spark, sf_dir, "conversations"))


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.digests(docs, public_tokenizers.path(RANKS), public_tokenizers.PATTERN).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.measured(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return token_count.count_tokens(docs, public_tokenizers.path(VOCABULARY)).select("doc_id", "n_words", "n_tokens")


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    found = langid.identify(docs.select("doc_id", "text"), langid.learn(docs))
    return found.select("doc_id", langid.held_out().alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.find_secrets(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(
        "doc_id",
        *[secret_scan.count("base_spans", k).alias(f"n_{k}") for k in secret_scan.KINDS],
        F.sha2(secret_scan.digest("base_spans").cast("binary"), 256).alias("base_sha256"),
        secret_scan.digest("secret_spans").alias("spans"),
    )


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(read(spark, sf_dir, "pages").select("page_id", "url", "html")).select("page_id", "url", "text", "n_chars")


def op11_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(read(spark, sf_dir, "documents").select("doc_id", "text"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.spelling_variants(read(spark, sf_dir, "documents").select("doc_id", "text"))


def op13_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return alignment.aligned_pairs(docs, public_tokenizers.path(BYTE_LEVEL), public_tokenizers.path(VOCABULARY))[0]


QUERIES = {f.__name__: f for f in (op1_simhash_near_dedup, op2_decontamination, op3_repeated_passages, op4_chat_format, op5_byte_bpe, op6_quality_rules, op7_token_counts, op8_language_id, op9_secret_scan, op10_html_text, op11_exact_dedup, op12_spelling_variants, op13_tokenizer_alignment)} | {"pipeline": corpus_pipeline.run}
ORACLE_SQL = {"op6_quality_rules": quality.oracle(), "op11_exact_dedup": exact_dedup.oracle()}
