"""Identity of files and chunks, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: The DNS namespace of RFC 4122, in hex.
NAMESPACE = "6ba7b8109dad11d180b400c04fd430c8"


def file_id(path: Column, mtime: Column, size: Column) -> Column:
    """SHA-1 of path|mtime|size, in hex."""
    return F.sha1(F.concat_ws("|", path, mtime, size))


def chunk_id(file: Column, idx: Column) -> Column:
    """Version-5 UUID of file_idx."""
    h = F.sha1(F.concat(F.unhex(F.lit(NAMESPACE)), F.encode(F.concat_ws("_", file, idx), "UTF-8")))
    variant = F.translate(F.substring(h, 17, 1), "0123456789abcdef", "89ab89ab89ab89ab")
    return F.concat(F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-5"), F.substring(h, 14, 3), F.lit("-"), variant, F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12))
