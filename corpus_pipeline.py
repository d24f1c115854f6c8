"""A training-data pipeline over documents, in stages that are each written and reread."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from lodestone.llm.bpe import encode_documents
from lodestone.llm.common import staged
from lodestone.llm.decontamination import decontaminate
from lodestone.llm.line_dedup import LONG, deduplicate as without_repeated_lines
from lodestone.llm.near_copies import deduplicate as without_near_copies
from lodestone.llm.zstd_quality import filter_quality


#: Cuts and pre-tokens that a worker remembers in the last stage: it shares its executor with what the stages before have left there.
REMEMBERED = 1 << 16


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the compression classifier rejects. Null and empty texts have no difference in size and are judged
    by the calibration alone; repeated rows are judged alike; without labels all stay."""
    return filter_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Deletes later copies of repeated line runs and of long lines; n_chars follows the text, other columns stay as they are. A null text
    stays null, a text of which all goes becomes empty; no row is dropped."""
    found = without_repeated_lines(docs, long=LONG, counts=False)
    return found.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else found


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies: five-word shingles, similarity 0.8 or more. SimHash fingerprints linked through Golay keys propose copies,
    MinHash bands those that are further apart; all are verified. Texts without words are copies of
    each other; rows with a null id all stay; rows that share an id are judged by their texts."""
    return without_near_copies(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that contain a benchmark item. Null and empty texts stay; with an empty benchmark all do."""
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encodes the texts that are left: the other columns, and n_tokens, ids (decimal, comma-joined), ids_sha256 and decoded_sha256, which replace
    columns of these names. A null text has no ids."""
    return encode_documents(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, keep=[c for c in docs.columns if c != "text"], with_ids=True, remembered=REMEMBERED)


STAGES = [("quality", quality), ("line_dedup", lines), ("near_dedup", near_copies), ("decontamination", benchmark), ("bpe", tokens)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = staged(docs, f"pipeline-{name}")
    return docs
