"""From sentence scores to one outcome per case."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from casemill.operators.joins import HOT_ROWS, hot_keys
from casemill.rules.defaults import (
    ACCEPTED,
    DENSITY_BANDWIDTH,
    DENSITY_CUT,
    DENSITY_GRID,
    HIGH_SCORE,
    LOW_SCORE,
    REJECTED,
    UNCERTAIN,
)


# exp(-0.5 * z * z) is 0.0 as a double for any larger z.
_REACH = 39.0


def bin_score(score: Column, low: float = LOW_SCORE, high: float = HIGH_SCORE) -> Column:
    """Class of a score. The limits themselves, NaN and NULL are uncertain."""
    number = F.nanvl(score, F.lit(None).cast("double"))
    return F.when(number < low, REJECTED).when(number > high, ACCEPTED).otherwise(UNCERTAIN)


def case_votes(sentences: DataFrame, case: str, vote: str, outcome: str = "decision_outcome") -> DataFrame:
    """Most frequent class per case; a tie of the top two is uncertain. Rows without a case drop.

    Three counts per case are combined before the shuffle, so a case of any size is one small row
    per task.
    """
    counted = (
        sentences.filter(F.col(case).isNotNull())
        .groupBy(case)
        .agg(*[F.count_if(F.col(vote) == k).alias(f"_n{k}") for k in (REJECTED, ACCEPTED, UNCERTAIN)])
    )
    rejected, accepted, uncertain = F.col("_n0"), F.col("_n1"), F.col("_n2")
    return counted.select(
        case,
        F.when((rejected > accepted) & (rejected > uncertain), REJECTED)
        .when((accepted > rejected) & (accepted > uncertain), ACCEPTED)
        .otherwise(UNCERTAIN)
        .alias(outcome),
    )


def unanimous(df: DataFrame, case: str, value: str) -> DataFrame:
    """Whether all rows of a case agree."""
    return df.groupBy(case).agg((F.min(value) == F.max(value)).alias("all_equal"))


def duplicate_rows(
    df: DataFrame, key: str, keep: str = "duplicated", rows: int = HOT_ROWS
) -> DataFrame:
    """Rows whose key occurs more than once, or (``keep='unique'``) exactly once.

    Keys are counted before the shuffle, and only rows whose key is not hot meet the counts: a hot
    key occurs more than once in any case. Rows without a key are one group.
    """
    counts = df.groupBy(F.col(key).alias("_key")).agg(F.count(F.lit(1)).alias("_n"))
    hot = F.broadcast(hot_keys(df, [key], rows).select(F.col(key).alias("_key")))
    same = F.col(key).eqNullSafe(F.col("_key"))
    cold_rows = df.join(hot, same, "left_anti")
    if keep == "unique":
        return cold_rows.join(counts.filter("_n = 1"), same, "left_semi")
    repeated = counts.filter((F.col("_n") > 1))
    return df.join(hot, same, "left_semi").union(cold_rows.join(repeated, same, "left_semi"))


def duplicate_totals(df: DataFrame, key: str) -> DataFrame:
    """Rows that share their key with another row, and rows that do not."""
    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    return counts.agg(
        F.coalesce(F.sum(F.when(F.col("_n") > 1, F.col("_n"))), F.lit(0)).alias("duplicate_rows"),
        F.count_if(F.col("_n") == 1).alias("single_rows"),
    )


def score_range(df: DataFrame, score: str) -> DataFrame:
    return df.agg(F.min(score).alias("min_score"), F.max(score).alias("max_score"))


def class_distribution(df: DataFrame, column: str) -> DataFrame:
    """Rows and percent of all rows (two decimals) per class; rows without a class only count in the total."""
    counts = df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    # A row for each class: the total is summed over them, not over the rows again.
    total = counts.withColumn("_total", F.sum("n").over(Window.partitionBy()))
    return total.filter(F.col(column).isNotNull()).select(
        column, "n", F.round(F.col("n") * 100 / F.col("_total"), 2).alias("percent")
    )


def class_balance(df: DataFrame, column: str) -> DataFrame:
    """Negative, positive and all examples, and the share of positive ones in percent."""
    negative, positive = F.count_if(F.col(column) == 0), F.count_if(F.col(column) == 1)
    return df.agg(
        negative.alias("negative"),
        positive.alias("positive"),
        (negative + positive).alias("total"),
        F.round(F.try_divide(positive * 100, negative + positive), 2).alias("positive_percent"),
    )


def score_density(
    df: DataFrame,
    score: str,
    bandwidth: float = DENSITY_BANDWIDTH,
    grid: int = DENSITY_GRID,
    cut: float = DENSITY_CUT,
) -> DataFrame:
    """Gaussian kernel density of a score on an even grid that extends ``cut`` bandwidths.

    Equal scores are merged first. A score then adds to the grid points around it: beyond ``_REACH``
    bandwidths its kernel is 0.0 as a double, so leaving those out changes no value. What is summed are
    ``grid`` groups in every task. With fewer than two different scores there is no bandwidth: the points
    come with NULL.
    """
    scores = df.select(F.col(score).cast("double").alias("x")).filter(
        F.col("x").isNotNull() & ~F.isnan("x")
    )
    width = bandwidth * F.pow(F.count("x"), F.lit(-0.2)) * F.stddev_samp("x")
    stats = scores.agg(
        F.struct(
            F.count("x").alias("n"),
            width.alias("h"),
            (F.min("x") - cut * width).alias("low"),
            (F.max("x") + cut * width).alias("high"),
        )
    ).scalar()
    merged = scores.groupBy("x").agg(F.count(F.lit(1)).alias("weight"))
    step = (F.col("s.high") - F.col("s.low")) / (grid - 1)
    at = F.col("s.low") + F.col("point") * step
    near = [
        F.try_divide(F.col("x") + side * _REACH * F.col("s.h") - F.col("s.low"), step) for side in (-1, 1)
    ]
    first = F.coalesce(F.greatest(F.floor(near[0]), F.lit(0)), F.lit(0)).cast("int")
    last = F.coalesce(F.least(F.ceil(near[1]), F.lit(grid - 1)), F.lit(grid - 1)).cast("int")
    points = merged.select("x", "weight", stats.alias("s")).select(
        "x", "weight", "s", F.explode(F.sequence(first, last)).alias("point")
    )
    kernel = F.exp(-0.5 * F.pow(F.try_divide(at - F.col("x"), F.col("s.h")), 2))
    sums = points.groupBy("point").agg(F.sum(F.col("weight") * kernel).alias("_sum"))
    # Every point has a row, also one that no score reaches; without a score there is none.
    every = df.sparkSession.range(grid).select(F.col("id").cast("int").alias("point"), stats.alias("s"))
    norm = F.col("s.n") * F.col("s.h") * F.sqrt(F.lit(2.0) * F.pi())
    total = F.when(F.col("s.h").isNotNull(), F.coalesce("_sum", F.lit(0.0)))
    return (
        every.filter(F.col("s.n") > 0)
        .join(sums, "point", "left")
        .select("point", at.alias("score"), F.try_divide(total, norm).alias("density"))
    )
