"""Arrays in a row."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def sorted_distinct(items: Column) -> Column:
    """Set of the items in a fixed order."""
    return F.array_sort(F.array_distinct(items))


def argmax(scores: Column) -> Column:
    """0-based position of the largest score; the first one on a tie."""
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("int")


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, however often the body refers to it."""
    return F.transform(F.array(value), body)[0]


def empty_texts() -> Column:
    return F.array().cast("array<string>")
