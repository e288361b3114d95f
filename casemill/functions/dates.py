"""Dates written out in English, and lists of them."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from casemill.rules.defaults import (
    BARE_YEAR_PATTERN,
    DATE_FORMAT,
    DATE_SHAPE,
    DATE_PRINT_FORMAT,
    NOISE_DATES,
)


def parse_date(text: Column, fmt: str = DATE_FORMAT) -> Column:
    """Date, or NULL when the text is no valid date.

    Only text of the right shape is parsed, as a failed parse costs far more than the check.
    """
    return F.when(F.trim(text).rlike(DATE_SHAPE), F.try_to_date(F.trim(text), fmt))


def print_date(day: Column, fmt: str = DATE_PRINT_FORMAT) -> Column:
    return F.date_format(day, fmt)


def clean_date_items(items: Column, noise: list[str] = NOISE_DATES) -> Column:
    """Distinct items without the noise dates and without those that start with a bare year."""
    return F.filter(
        F.array_distinct(items), lambda d: ~d.isin(noise) & ~d.rlike(BARE_YEAR_PATTERN)
    )


def parsed_dates(items: Column) -> Column:
    """The items that are dates, as dates."""
    return F.filter(F.transform(items, lambda x: parse_date(x)), lambda d: d.isNotNull())


def latest_date(days: Column) -> Column:
    """Decision date: the latest of the parsed dates, by calendar."""
    return F.array_max(days)


def date_span(days: Column) -> Column:
    """Days from the earliest to the latest of the parsed dates."""
    return F.datediff(F.array_max(days), F.array_min(days))


def without_day_comma(text: Column) -> Column:
    """``may 23, 2017`` as ``may 23 2017``."""
    return F.regexp_replace(text, r"(?<=\d),", "")
