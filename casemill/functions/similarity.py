"""Token-set similarity of two texts, 0 to 100.

The score needs the longest common subsequence, for which Spark has no function (its ``levenshtein`` charges 1 for a
substitution). ``token_set_similarity`` finds it by a fold over the characters, with one bit of a BIGINT for each
character of the other side: a native expression, for texts whose own words have up to ``BITS`` characters. Longer ones
go to an Arrow batch function. Callers pass NULL for rows that need no score.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

from casemill.functions.arrays import let

_NOT_WORD = re.compile(r"\W")
_LATIN1 = dict.fromkeys(range(128, 256))


def _tokens(text: str) -> set[str]:
    return set(_NOT_WORD.sub(" ", text.translate(_LATIN1)).lower().split())


def _common_subsequence(a: str, b: str) -> int:
    """Length of the longest common subsequence, one bit per character of ``a``."""
    where: dict[str, int] = {}
    for i, ch in enumerate(a):
        where[ch] = where.get(ch, 0) | (1 << i)
    all_bits = (1 << len(a)) - 1
    open_bits = all_bits
    for ch in b:
        hit = open_bits & where.get(ch, 0)
        open_bits = ((open_bits + hit) | (open_bits - hit)) & all_bits
    return len(a) - open_bits.bit_count()


def _ratio(a: str, b: str) -> int:
    if not a or not b:
        return 0
    if a == b:
        return 100
    return round(100 * 2 * _common_subsequence(a, b) / (len(a) + len(b)))


def token_set_score(left: str | None, right: str | None) -> int | None:
    """Best agreement of the shared tokens and of each side's shared-plus-own tokens."""
    if left is None or right is None:
        return None
    a, b = _tokens(left), _tokens(right)
    if not a or not b:
        return 0
    shared = " ".join(sorted(a & b))
    whole_a = f"{shared} {' '.join(sorted(a - b))}".strip()
    whole_b = f"{shared} {' '.join(sorted(b - a))}".strip()
    if shared and (shared == whole_a or shared == whole_b):
        return 100
    return max(_ratio(shared, whole_a), _ratio(shared, whole_b), _ratio(whole_a, whole_b))


# Texts of fewer characters in total score 100 only when the words of one are words of the other:
# rounding up to 100 takes a difference of at most 1 in 200.
EXACT_BELOW = 200


def _words(text: Column) -> Column:
    plain = F.lower(F.regexp_replace(F.regexp_replace(text, r"[\x80-\xFF]", ""), r"[^\p{L}\p{N}_]", " "))
    return F.array_distinct(F.filter(F.split(plain, " "), lambda t: t != ""))


def same_words(left: Column, right: Column) -> Column:
    """Whether all words of one text are words of the other (and there are any)."""

    def within(a, b):
        fewer = F.least(F.size(a), F.size(b))
        return (fewer > 0) & (F.size(F.array_intersect(a, b)) == fewer)

    return let(F.struct(_words(left).alias("a"), _words(right).alias("b")), lambda t: within(t["a"], t["b"]))


#: Characters that one BIGINT has bits for: a sum of two such numbers stays below its sign.
BITS = 62


def _bits(a: Column, ch: Column) -> Column:
    """Where the characters ``a`` are ``ch``, the last one at the lowest bit."""
    return F.aggregate(a, F.lit(0).cast("bigint"), lambda n, x: n + n + (x == ch).cast("bigint"))


def _left_open(a: Column, b: Column) -> Column:
    """Characters of ``a`` (an array, ``BITS`` at most) outside a longest common subsequence with ``b``, back to front."""
    one = F.lit(1).cast("bigint")
    full = F.call_function("shiftleft", one, F.size(a)) - one

    def step(state, ch):
        hit = lambda m: state.bitwiseAND(m)
        return let(hit(_bits(a, ch)), lambda h: (state + h).bitwiseOR(state - h).bitwiseAND(full))

    return F.bit_count(F.aggregate(F.reverse(b), full, step))


def _native_score(left: Column, right: Column) -> Column:
    """The score of two texts; NULL where the own words of both have more than ``BITS`` characters.

    The shared words open the joined words of each side, so they are common as a whole, and only the own words
    that follow are compared.
    """

    def ratio(common, total):
        return F.bround(F.lit(200) * common / total, 0).cast("int")

    def scored(t):
        shared, a, b = (F.length(t[c]) for c in ("shared", "a", "b"))
        gap = F.when(shared > 0, 1).otherwise(0)
        chars = F.struct(*(F.split(t[c], "").alias(c) for c in "ab"))
        shorter = lambda c: F.when(a <= b, _left_open(c["a"], c["b"])).otherwise(_left_open(c["b"], c["a"]))
        common = shared + gap + F.least(a, b) - let(chars, shorter)
        both = ratio(common, 2 * (shared + gap) + a + b)
        part = lambda n: F.when(shared > 0, ratio(shared, shared + gap + shared + n)).otherwise(0)
        return (
            F.when((shared == 0) & ((a == 0) | (b == 0)), 0)
            .when((a == 0) | (b == 0), 100)
            .when(F.least(a, b) <= BITS, F.greatest(part(a), part(b), both))
        )

    def sides(w):
        joined = lambda words: F.array_join(F.array_sort(words), " ")
        shared, a, b = F.array_intersect(w["a"], w["b"]), F.array_except(w["a"], w["b"]), F.array_except(w["b"], w["a"])
        return let(F.struct(joined(shared).alias("shared"), joined(a).alias("a"), joined(b).alias("b")), scored)

    words = F.struct(_words(left).alias("a"), _words(right).alias("b"))
    return F.when(left.isNotNull() & right.isNotNull(), let(words, sides))


def token_set_similarity(left: Column, right: Column, short: bool = False) -> Column:
    """Best agreement of the shared words and of each side's shared and own words; NULL if a side is NULL.

    Texts beyond the native form go through Python, unless the caller states that one side is always ``short``: of ``BITS``
    characters at most. A row that breaks this is an error, not a wrong score.
    """
    native = _native_score(left, right)
    known = left.isNotNull() & right.isNotNull()
    if short:
        longer = F.raise_error(F.lit(f"both texts have words of their own of more than {BITS} characters")).cast("int")
        return F.when(known, let(native, lambda n: F.when(n.isNull(), longer).otherwise(n)))
    long = known & (F.least(F.length(left), F.length(right)) > BITS)
    batch = _token_set_batch(F.when(long, left), F.when(long, right))
    return F.when(long, batch).otherwise(native)


@F.pandas_udf(T.IntegerType())
def _token_set_batch(left: pd.Series, right: pd.Series) -> pd.Series:
    scores = [
        None if pd.isna(a) or pd.isna(b) else token_set_score(a, b) for a, b in zip(left, right)
    ]
    return pd.Series(scores, dtype="Int32")
