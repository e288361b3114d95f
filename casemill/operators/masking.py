"""Masking of personal spans."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F

from casemill.rules.defaults import MASK_CHAR, MASK_LENGTH, PERSON_RULE


# A pattern of classes and plain characters, one of which stands in every match: [a-z]+@[a-z.]+.
_PLAIN = re.compile(r"(?:\[(?:\w-\w|[\w.@%+])+\][*+]?)*([\w@])(?![*+])(?:\[(?:\w-\w|[\w.@%+])+\][*+]?|[\w@](?![*+]))*", re.A)


def _has_span(text: Column, pattern: str) -> Column:
    """``rlike``, after a look for a character that every match holds, if the pattern shows one."""
    plain = _PLAIN.fullmatch(pattern)
    return F.contains(text, F.lit(plain[1])) & text.rlike(pattern) if plain else text.rlike(pattern)


def mask_text(
    text: Column, pattern: str = PERSON_RULE, char: str = MASK_CHAR, length: int = MASK_LENGTH
) -> Column:
    """Replace the last ``length`` characters of every span by ``char``; longer spans keep their head.

    The text between the spans and the masked spans are zipped together again, so the text keeps
    its length. A text without a span is passed on after one look.
    """
    between = F.split(text, pattern, -1)
    masked = F.transform(
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)),
        lambda s: F.concat(
            F.left(s, F.greatest(F.length(s) - length, F.lit(0))),
            F.repeat(F.lit(char), F.least(F.length(s), F.lit(length))),
        ),
    )
    stitched = F.array_join(
        F.zip_with(between, masked, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), ""
    )
    return F.when(_has_span(text, pattern), stitched).otherwise(text)


def mask_column(df: DataFrame, text: str, pattern: str = PERSON_RULE, **options) -> DataFrame:
    """Mask one text column; all other columns, the key included, are kept as they are."""
    return df.withColumn(text, mask_text(F.col(text), pattern, **options))
