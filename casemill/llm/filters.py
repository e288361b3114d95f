"""How filters interact: the potential of the removal game.

The players are filters; a coalition is worth the documents that its filters remove together. The
potential of Hart and Mas-Colell is found for all coalitions by recursion: that of a coalition is its worth
plus the potentials of the coalitions that lack one of its filters, over its number of filters. A
filter's Shapley value is the potential of all filters minus the potential without it, and what a step of an
order removes is the difference of two coalitions. No order is ever applied to the documents.
"""

from __future__ import annotations

import math
from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: What stands between two words.
SPACE = r"[\x20\x09-\x0D]+"

__all__ = ["audit_filters", "text_filters"]


def text_filters(text: Column, words: Column) -> dict[str, Column]:
    """A: under 100 words; B: distinct words under 80 percent of them; C: A to Z above 10 percent of the characters;
    D: holds any of ``#$%&*|``."""
    upper = F.length(text) - F.length(F.regexp_replace(text, "[A-Z]", ""))
    return {
        "A": F.size(words) < 100,
        "B": F.size(F.array_distinct(words)) * 100 < F.size(words) * 80,
        "C": upper.cast("long") * 100 > F.length(text).cast("long") * 10,
        "D": text.rlike(r"[#$%&*|]"),
    }


def _failures(df: DataFrame, filters, key: str, text: str, part: str) -> DataFrame:
    """A row for each key, part and text: ``_fails`` (a bit for each filter on the text) and ``n`` rows."""
    rows = df.select(
        F.col(f"`{key}`").alias("_id"),
        F.coalesce(F.col(f"`{part}`").cast("string"), F.lit("")).alias("_part"),
        F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("_text"),
    )
    rows = rows.withColumn("_words", F.array_remove(F.split("_text", SPACE), ""))
    bits = [F.when(c, F.lit(1 << i)).otherwise(F.lit(0)) for i, c in enumerate(filters(F.col("_text"), F.col("_words")).values())]
    fails = bits[0]
    for b in bits[1:]:
        fails = fails.bitwiseOR(b)
    rows = rows.select("_id", "_part", F.unhex(F.sha2("_text", 256)).alias("_hash"), fails.alias("_fails"))
    return rows.groupBy("_id", "_part", "_hash", "_fails").agg(F.count("*").alias("n"))


def _masks(rows: DataFrame, copies: int, counts: list[str]) -> DataFrame:
    """Counts by ``_part`` and ``mask``, the filters that a document fails, that for copies among them.

    Equal texts fail the same filters on texts, so a text's documents need only be counted, and those of its
    smallest key told apart: no document meets another.
    """
    own = F.struct(F.col("_id").isNull().alias("none"), F.col("_id").alias("id"), *counts)
    texts = rows.groupBy("_hash", "_fails", "_part").agg(*(F.sum(c).alias(c) for c in counts), F.min(own).alias("first"))
    # A row for each part that holds the text.
    head = F.min(F.struct("first.none", "first.id")).over(Window.partitionBy("_hash"))
    texts = texts.withColumn("head", head)
    is_head = F.col("first.none").eqNullSafe(F.col("head.none")) & F.col("first.id").eqNullSafe(F.col("head.id"))
    kept = {c: F.when(is_head, F.col(f"first.{c}")).otherwise(F.lit(0)) for c in counts}
    heads = F.struct(F.col("_fails").alias("mask"), *(kept[c].alias(c) for c in counts))
    rest = F.struct(F.col("_fails").bitwiseOR(F.lit(copies)).alias("mask"), *((F.col(c) - kept[c]).alias(c) for c in counts))
    each = texts.select("_part", F.explode(F.array(heads, rest)).alias("x")).select("_part", "x.*")
    return each.groupBy("_part", "mask").agg(*(F.sum(c).alias(c) for c in counts))


def _games(masks: DataFrame, players: int, counts: list[str]) -> DataFrame:
    """One row for each part: its rows in ``total``, and for each count the worth of all coalitions in their order."""
    coalitions = masks.select("*", F.explode(F.sequence(F.lit(0), F.lit((1 << players) - 1))).alias("coalition"))
    meets = F.col("mask").bitwiseAND(F.col("coalition")) != 0
    worth = [F.sum(F.when(meets, F.col(c)).otherwise(F.lit(0))).alias(c) for c in counts]
    worth = coalitions.groupBy("_part", "coalition").agg(F.sum("n").alias("total"), *worth)
    ordered = worth.groupBy("_part").agg(F.max("total").alias("total"), F.sort_array(F.collect_list(F.struct("coalition", *counts))).alias("games"))
    return ordered.select("_part", "total", *(F.col(f"games.{c}").alias(c) for c in counts))


def _potential(worth: Column, players: int) -> Column:
    """Potentials of all coalitions, times the number of orders, which makes them whole numbers."""
    orders = math.factorial(players)

    def extend(known, coalition):
        total = F.get(worth, coalition) * orders
        for i in range(players):
            has = coalition.bitwiseAND(F.lit(1 << i)) != 0
            total = total + F.when(has, F.get(known, coalition - F.lit(1 << i))).otherwise(F.lit(0))
        return F.concat(known, F.array(F.call_function("div", total, F.bit_count(coalition).cast("long"))))

    return F.aggregate(F.sequence(F.lit(1), F.lit((1 << players) - 1)), F.array(F.lit(0).cast("long")), extend)


def audit_filters(
    df: DataFrame,
    labels: DataFrame,
    flags: dict[str, str],
    filters=text_filters,
    copies: str = "E",
    key: str = "doc_id",
    text: str = "text",
    part: str = "lang",
    label_key: str = "doc_id",
) -> DataFrame:
    """What each filter removes at each step of each order in which they can be applied, in each part of the documents.

    ``filters`` makes of a text and its words named conditions under which a document fails; the filter ``copies``
    besides fails a document whose text a smaller key has, in any part. Names are single letters. One row for each
    ``part``, ``filter_order`` and ``step`` (from 1): ``kept``, ``removed``, ``redundant`` (fails this filter, removed
    earlier), ``unique_fails`` (fails no other), a column for each of ``flags`` (removed here, with that condition
    true in ``labels``), and ``shapley`` (the filter's removals, summed over all orders).

    A null text is empty, a null part the empty string. A null key counts as larger than all others and has no labels.
    Repeated rows are documents each; rows of one key and text do not make copies of one another. Of several label rows
    of a key, one that is true is enough. An empty table gives no rows; labels may be empty. Other columns play no part.
    """
    names = "".join([*filters(F.lit(""), F.array(F.lit(""))), copies])
    players, counts = len(names), ["n", *flags]
    rows = _failures(df, filters, key, text, part)
    known = labels.select(F.col(f"`{label_key}`").alias("_id"), *(F.expr(f"CAST(coalesce({x}, false) AS int)").alias(c) for c, x in flags.items()))
    known = known.filter(F.col("_id").isNotNull()).groupBy("_id").agg(F.count("*").alias("_rows"), *(F.max(c).alias(c) for c in flags))
    rows = rows.join(known, "_id", "left").select(
        "_id", "_part", "_hash", "_fails", "n", *((F.coalesce(F.col(c), F.lit(0)) * F.col("n")).alias(c) for c in flags)
    )
    games = _games(_masks(rows, 1 << (players - 1), counts), players, counts)
    games = games.withColumn("potential", _potential(F.col("n"), players))
    orders = F.explode(F.array(*(F.lit("".join(p)) for p in permutations(names)))).alias("filter_order")
    bit = lambda i: F.call_function("shiftleft", F.lit(1), F.instr(F.lit(names), F.col("filter_order").substr(i + 1, F.lit(1))) - 1)
    steps = games.select("*", orders).withColumn("bits", F.transform(F.sequence(F.lit(0), F.lit(players - 1)), bit))
    steps = steps.select("*", F.explode(F.sequence(F.lit(1), F.lit(players))).alias("step"))
    steps = steps.withColumn("own", F.get("bits", F.col("step") - 1))
    steps = steps.withColumn("after", F.aggregate(F.slice("bits", F.lit(1), F.col("step")), F.lit(0), lambda a, b: a + b))
    everyone = F.lit((1 << players) - 1)
    gained = lambda c: F.get(c, F.col("after")) - F.get(c, F.col("after") - F.col("own"))
    without = lambda c: F.get(c, everyone) - F.get(c, everyone - F.col("own"))
    return steps.select(
        F.col("_part").alias("part"),
        "filter_order",
        "step",
        (F.col("total") - F.get("n", F.col("after"))).alias("kept"),
        gained("n").alias("removed"),
        (F.get("n", F.col("own")) - gained("n")).alias("redundant"),
        without("n").alias("unique_fails"),
        *(gained(c).alias(c) for c in flags),
        without("potential").alias("shapley"),
    )
