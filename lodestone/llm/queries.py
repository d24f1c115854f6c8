"""The queries opN_<name> over the whole test tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import backoff_lm, decontamination, line_dedup, quality_rules


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .url_rules import judged

    found = judged(_table(spark, sf_dir, "pages").select("page_id", "url"), _table(spark, sf_dir, "labels").select("doc_id", "quality"))
    return found.select("page_id", "host", "path", "rule", "verdict", "bad_confidence")


def op2_rule_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_rules import judged

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return judged(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op3_simhash_golay(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash_golay import classes

    found = classes(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op5_contained_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contained(_table(spark, sf_dir, "documents").select("doc_id", "text"), _table(spark, sf_dir, "benchmark"))


def op6_backoff_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return backoff_lm.scored(_table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_words", "n_backoff", "lm_score")


def op7_long_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .long_repeats import remove_repeats

    found = remove_repeats(_table(spark, sf_dir, "documents").select("doc_id", "text"), keep=["doc_id"])
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op8_line_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .line_dedup import deduplicate

    found = deduplicate(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_lines", "n_removed", "n_runs", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .bpe import encode_documents

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return encode_documents(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, keep=["doc_id"])


def op4_toxicity_ftrl(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity_ftrl import judged

    return judged(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op10_zstd_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .zstd_quality import judged

    return judged(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_url_rules": op1_url_rules,
    "op2_rule_cascade": op2_rule_cascade,
    "op3_simhash_golay": op3_simhash_golay,
    "op4_toxicity_ftrl": op4_toxicity_ftrl,
    "op5_contained_items": op5_contained_items,
    "op6_backoff_lm": op6_backoff_lm,
    "op7_long_repeats": op7_long_repeats,
    "op8_line_runs": op8_line_runs,
    "op9_byte_bpe": op9_byte_bpe,
    "op10_zstd_quality": op10_zstd_quality,
}

ORACLE_SQL: dict[str, str] = {
    "op2_rule_cascade": quality_rules.SQL,
    "op5_contained_items": decontamination.SQL,
    "op6_backoff_lm": backoff_lm.SQL,
    "op8_line_runs": line_dedup.SQL,
}
