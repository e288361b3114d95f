"""Text expressions. All of them are native Spark expressions on a Column."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

from casemill.functions.arrays import let
from casemill.rules.defaults import FIXUPS, NULL_MARKERS, SEP

# All white space there is, the four separator controls included.
_SPACES = r"(?U)[\s\x1c-\x1f]+"


def normalize_text(text: Column) -> Column:
    """Lower case, every run of white space (line breaks included) as one space."""
    return F.regexp_replace(F.lower(text), _SPACES, " ")


def strip_punctuation(text: Column) -> Column:
    """Keep word characters, white space and brackets; the rest becomes a space; squeeze spaces."""
    return F.regexp_replace(
        F.regexp_replace(text, r"(?U)[^\p{L}\p{N}_\s\x1c-\x1f\[\]]", " "), " +", " "
    )


def collapse_separators(text: Column, sep: str = SEP) -> Column:
    """Write adjacent separators once."""
    return F.regexp_replace(text, rf"(\Q{sep}\E){{2,}}", sep)


def join_features(columns: list[Column], sep: str = SEP) -> Column:
    """Join columns with ``sep``. A null is an empty feature, so the positions stay aligned."""
    return F.array_join(F.array(*[F.coalesce(c, F.lit("")) for c in columns]), sep)


def words(text: Column) -> Column:
    """White-space separated words, without empty ones."""
    return F.filter(F.split(text, _SPACES), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.size(words(text)).cast("bigint")


def count_occurrences(text: Column, needle: str = SEP) -> Column:
    """Number of non-overlapping occurrences of ``needle``."""
    without = F.replace(text, F.lit(needle), F.lit(""))
    return ((F.length(text) - F.length(without)) / len(needle)).cast("bigint")


def apply_fixups(text: Column, fixups: dict[str, str] = FIXUPS) -> Column:
    """Replace each wrong spelling, in the order given."""
    return reduce(
        lambda c, pair: F.replace(c, F.lit(pair[0]), F.lit(pair[1])), fixups.items(), text
    )


def null_if_marker(text: Column, markers: list[str] = NULL_MARKERS) -> Column:
    """NULL where the cell only says that nothing was found."""
    return F.when(~text.isin(markers), text)


def parse_list_repr(text: Column) -> Column:
    """Items of a list or set that was written out as text, e.g. ``['a', 'b']`` or ``{'a', 'b'}``.

    Items holding an apostrophe are written in double quotes, so both quotes are read.
    """
    quoted = F.regexp_extract_all(text, F.lit("'[^']*'|\"[^\"]*\""), F.lit(0))
    return F.transform(quoted, lambda q: F.substring(q, F.lit(2), F.length(q) - 2))


def array_to_text(items: Column, sep: str = ", ") -> Column:
    """Array as display text; an array without items is NULL."""
    return F.nullif(F.array_join(items, sep), F.lit(""))


def clean_lines(block: Column) -> Column:
    """Lower-case lines of a text block, without leading space and without blank lines."""
    lines = F.split(F.lower(block), "\n")
    return F.filter(
        F.transform(lines, lambda x: F.regexp_replace(x, r"(?U)^[\s\x1c-\x1f]+", "")), lambda x: x != ""
    )


def first_match(text: Column, pattern: str) -> Column:
    """First match of the pattern, NULL when there is none."""
    return F.nullif(F.regexp_extract(text, pattern, 0), F.lit(""))


def all_matches(text: Column, pattern: str) -> Column:
    """All matches in text order; an empty array when there is none."""
    return F.coalesce(
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.array().cast("array<string>")
    )


def paragraphs(text: Column) -> Column:
    """Non-blank paragraphs of a text."""
    return F.filter(F.split(text, "\n"), lambda p: F.trim(p) != "")


def tail_paragraphs(text: Column, n: int) -> Column:
    """Last ``n`` non-blank paragraphs of a whole text, in text order; needs no shuffle."""
    return let(
        paragraphs(text),
        lambda p: F.slice(p, F.greatest(F.size(p) - n, F.lit(0)) + 1, F.lit(n)),
    )
