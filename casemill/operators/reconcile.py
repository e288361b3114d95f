"""Agreement of two extractions of the same field, held as two arrays of a row."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from casemill.functions.arrays import sorted_distinct
from casemill.functions.dates import parse_date, without_day_comma
from casemill.functions.similarity import EXACT_BELOW, same_words, token_set_similarity
from casemill.rules.defaults import DATE_SIMILARITY


def reconcile_names(df: DataFrame, first: str, second: str, name: str = "judge_name") -> DataFrame:
    """Names found by both; else the last of ``second`` when both lists hold the same words.

    The lists hold the same words when their token-set similarity is 100. That is a native test for
    short lists; only long lists without a common name go through the batch function.
    """
    b = F.col(second)
    joined = df.withColumns(
        {
            "_common": F.array_intersect(first, second),
            "_a": F.array_join(first, " "),
            "_b": F.array_join(second, " "),
        }
    )
    open_row = F.size("_common") == 0
    long = open_row & (F.length("_a") + F.length("_b") >= EXACT_BELOW)
    scored = joined.withColumn(
        "_score", token_set_similarity(F.when(long, F.col("_a")), F.when(long, F.col("_b")))
    )
    agree = F.when(long, F.col("_score") == 100).otherwise(same_words(F.col("_a"), F.col("_b")))
    return scored.withColumn(
        name,
        F.when(~open_row, F.array_join(sorted_distinct(F.col("_common")), " "))
        .when(agree, F.try_element_at(b, F.lit(-1)))
        .otherwise(""),
    ).drop("_common", "_a", "_b", "_score")


def reconcile_dates(
    df: DataFrame,
    first: str,
    second: str,
    name: str = "date_decision",
    threshold: int = DATE_SIMILARITY,
    short: bool = False,
) -> DataFrame:
    """Dates found by both, written without the comma after the day.

    Without a common date, the items that are no valid dates are compared as lists, and the last
    one of ``second`` is taken when their similarity is above ``threshold``: two valid dates that
    differ in one digit are similar texts but not the same date. With ``short``, the caller states that
    these items never have more than ``similarity.BITS`` characters on both sides; no row goes through Python then.
    """
    a = F.transform(F.col(first), lambda x: without_day_comma(x))
    b = F.transform(F.col(second), lambda x: without_day_comma(x))

    def no_dates(items):
        return F.filter(items, lambda x: parse_date(x, "MMMM d yyyy").isNull() & (x != ""))

    sided = df.withColumns({"_common": F.array_intersect(a, b), "_a": no_dates(a), "_b": no_dates(b)})
    open_row = F.size("_common") == 0
    score = token_set_similarity(
        F.when(open_row, F.array_join("_a", " ")), F.when(open_row, F.array_join("_b", " ")), short=short
    )
    scored = sided.withColumn("_score", score)
    return scored.withColumn(
        name,
        F.when(~open_row, F.array_join(sorted_distinct(F.col("_common")), " "))
        .when(F.col("_score") > threshold, F.try_element_at("_b", F.lit(-1)))
        .otherwise(""),
    ).drop("_common", "_a", "_b", "_score")
