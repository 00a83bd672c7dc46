"""Content hashes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def url_safe_sha1(raw: Column) -> Column:
    """SHA-1 of bytes in base64, without padding, - for / and _ for +."""
    return F.translate(F.rtrim(F.base64(F.unhex(F.sha1(raw))), F.lit("=")), "/+", "-_")


def text_hash(text: Column) -> Column:
    """The same of a text's UTF-16LE bytes."""
    return url_safe_sha1(F.encode(text, "UTF-16LE"))


def file_hash(name: Column, content: Column, first: int = 512 * 1024) -> Column:
    """The same of a file's root name in UTF-16LE and its first 512 KiB."""
    return url_safe_sha1(F.concat(F.encode(name, "UTF-16LE"), F.substring(content, 1, first)))
