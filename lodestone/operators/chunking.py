"""Files' texts into overlapping chunks of words."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.ids import chunk_id
from ..functions.text import words_of


def chunks(files: DataFrame, max_tokens: int = 1200, overlap: int = 80) -> DataFrame:
    """files: file_id, path, mtime, text. One row for each chunk: chunk_id, file_id, path, mtime, idx, token_start, token_end, text, sha256.

    A window of max_tokens words starts at every (max_tokens - overlap)th word; a text without words has none. Narrow: no shuffle."""
    if not 0 <= overlap < max_tokens:
        raise ValueError("overlap must be less than max_tokens")
    step = max_tokens - overlap
    split = files.select("file_id", "path", "mtime", words_of(F.col("text")).alias("w")).where(F.size("w") > 0)
    windows = split.select("*", F.explode(F.sequence(F.lit(0), F.size("w") - 1, F.lit(step))).alias("s"))
    out = windows.select(
        "file_id", "path", "mtime", (F.col("s") / step).cast("long").alias("idx"), F.col("s").cast("long").alias("token_start"),
        F.least(F.col("s") + max_tokens, F.size("w")).cast("long").alias("token_end"), F.array_join(F.slice("w", F.col("s") + 1, F.lit(max_tokens)), " ").alias("text"),
    )
    return out.select(chunk_id(F.col("file_id"), F.col("idx")).alias("chunk_id"), "*", F.sha2("text", 256).alias("sha256"))
