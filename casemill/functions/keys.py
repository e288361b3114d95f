"""Keys: from file names, and the strict and lenient casts of key columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from casemill.rules.defaults import FILE_KEY_PATTERN, NO_KEY


def key_from_path(path: Column, pattern: str = FILE_KEY_PATTERN, missing: str = NO_KEY) -> Column:
    """Group 1 of ``pattern`` in a file name, or the ``missing`` marker."""
    return F.coalesce(F.nullif(F.regexp_extract(path, pattern, 1), F.lit("")), F.lit(missing))


def strict_key(key: Column) -> Column:
    """Cast to bigint; a key that is no number is an error (ANSI mode)."""
    return key.cast("bigint")


def nullable_key(key: Column) -> Column:
    """Nearest whole number of a key written as text or float; NULL when it is no number."""
    return F.round(key.try_cast("double")).try_cast("bigint")


def lenient_key(key: Column) -> Column:
    """Whole part of a key written as text or float; 0 when it is no number."""
    return F.coalesce(key.try_cast("double").try_cast("bigint"), F.lit(0).cast("bigint"))


def key_hash(seed: str, keys: list[Column]) -> Column:
    """Repeatable hash of a row key, the same on every engine that has md5."""
    parts = [F.lit(str(seed))] + [F.coalesce(k.cast("string"), F.lit("")) for k in keys]
    return F.md5(F.concat_ws("|", *parts))


def hash_bucket(hashed: Column, buckets: int) -> Column:
    """Bucket 0 .. buckets-1 from the first 8 hex digits of :func:`key_hash`."""
    return F.conv(F.substring(hashed, 1, 8), 16, 10).cast("bigint") % buckets
