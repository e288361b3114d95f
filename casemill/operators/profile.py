"""Counts and profiles that describe a data set or its errors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window, functions as F

from casemill.functions.text import count_occurrences, word_count, words
from casemill.operators.joins import present
from casemill.rules.defaults import EXCLUDED_MENTIONS, SEP, TOP_WORDS


def null_profile(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Missing values per column, all columns in one pass."""
    columns = columns or df.columns
    counts = df.agg(*[F.count_if(~present(df, [c])).alias(c) for c in columns])
    cells = [
        F.struct(F.lit(c).alias("column_name"), F.col(c).alias("n_missing")) for c in columns
    ]
    return counts.select(F.inline(F.array(*cells)))


def distinct_cases(df: DataFrame, case: str) -> DataFrame:
    """Number of different keys; missing keys count as one more."""
    missing = F.max(F.when(F.col(case).isNull(), 1).otherwise(0))
    keys = df.select(F.col(case)).distinct()
    return keys.agg((F.count(case) + F.coalesce(missing, F.lit(0))).alias("n_cases"))


def cleaning_report(df: DataFrame, case: str, subset: list[str] | None = None) -> DataFrame:
    """Rows before, after and removed by dropping incomplete rows, and the cases left, in one plan.

    Rows are first merged per case, so the distinct count needs no second pass.
    """
    complete = present(df, subset or df.columns)
    per_case = df.groupBy(case).agg(
        F.count(F.lit(1)).alias("_n"), F.count_if(complete).alias("_kept")
    )
    return per_case.agg(
        F.sum("_n").alias("rows_before"),
        F.sum("_kept").alias("rows_after"),
        (F.sum("_n") - F.sum("_kept")).alias("rows_removed"),
        F.count_if((F.col("_kept") > 0)).alias("cases_after"),
    )


class RowCounts:
    """Rows at some steps of a job, counted by the job itself: no second scan, no second job.

    ``at`` marks a step in a plan; once the job has run, ``report`` has the rows of each step and how many were removed since
    the step before. A stage that runs again after a loss may be counted again, so a count is exact unless executors were lost.
    The plan must be of ``session``: a session that has observed rows can fit no Spark ML model any more, as models hold on
    to their session and it can then not be sent to tasks, so counting has a session of its own.
    """

    def __init__(self, spark: SparkSession):
        self.session = spark.newSession()
        for name, value in spark.conf.getAll.items():
            if spark.conf.isModifiable(name):
                self.session.conf.set(name, value)
        self._steps: list[tuple[str, Observation]] = []

    def at(self, step: str, df: DataFrame) -> DataFrame:
        seen = Observation()
        self._steps.append((step, seen))
        return df.observe(seen, F.count(F.lit(1)).alias("rows"))

    def report(self) -> list[dict]:
        out, before = [], None
        for step, seen in self._steps:
            n = seen.get["rows"]
            out.append({"step": step, "rows": n, "removed": 0 if before is None else before - n})
            before = n
        return out


def word_stats(df: DataFrame, text: str) -> DataFrame:
    """Median and mean number of words. Texts of equal length are merged before the median."""
    lengths = df.groupBy(word_count(F.col(text)).alias("_words")).agg(F.count(F.lit(1)).alias("_n"))
    return lengths.agg(
        F.percentile("_words", 0.5, F.col("_n")).alias("median_words"),
        (F.sum(F.col("_words") * F.col("_n")) / F.sum("_n")).alias("mean_words"),
    )


def error_profile(df: DataFrame, text: str, wrong: Column, sep: str = SEP) -> DataFrame:
    """Mean words and mean separators per text: misclassified rows against all rows, in one pass."""
    measured = df.select(
        F.coalesce(wrong, F.lit(False)).alias("_wrong"),
        word_count(F.col(text)).alias("_words"),
        count_occurrences(F.col(text), sep).alias("_seps"),
    )
    sums = measured.agg(
        F.count_if("_wrong").alias("n_wrong"),
        F.avg(F.when(F.col("_wrong"), F.col("_words"))).alias("words_wrong"),
        F.avg(F.when(F.col("_wrong"), F.col("_seps"))).alias("seps_wrong"),
        F.count(F.lit(1)).alias("n_all"),
        F.avg("_words").alias("words_all"),
        F.avg("_seps").alias("seps_all"),
    )
    rows = [
        F.struct(
            F.lit(group).alias("sample"),
            F.col(f"n_{key}").alias("n"),
            F.col(f"words_{key}").alias("mean_words"),
            F.col(f"seps_{key}").alias("mean_separators"),
        )
        for group, key in (("misclassified", "wrong"), ("all", "all"))
    ]
    return sums.select(F.inline(F.array(*rows)))


def word_counts(df: DataFrame, text: str) -> DataFrame:
    """Occurrences of every word. Words are counted per task before the shuffle."""
    return (
        df.select(F.explode(words(F.col(text))).alias("word"))
        .groupBy("word")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def top_words(df: DataFrame, text: str, wrong: Column, k: int = TOP_WORDS) -> DataFrame:
    """The ``k`` most frequent words of the misclassified rows and of all rows, from one scan.

    Both counts are kept per word; ties go to the smaller word. Each task keeps its own ``k`` best
    before the last step.
    """
    found = df.select(
        F.coalesce(wrong, F.lit(False)).alias("_wrong"), F.explode(words(F.col(text))).alias("word")
    )
    counts = found.groupBy("word").agg(
        F.count(F.lit(1)).alias("_all"), F.count_if("_wrong").alias("_bad")
    )
    both = F.array(
        F.struct(F.lit("all").alias("sample"), F.col("_all").alias("n")),
        F.struct(F.lit("misclassified").alias("sample"), F.col("_bad").alias("n")),
    )
    rows = counts.select("word", F.inline(both)).filter(F.col("n") > 0)
    best = Window.partitionBy("sample").orderBy(F.col("n").desc(), "word")
    return rows.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)


def mention_counts(df: DataFrame, places: str, excluded: list[str] = EXCLUDED_MENTIONS) -> DataFrame:
    """Occurrences of every place in an array column, without the excluded ones in any case."""
    return (
        df.select(F.explode(places).alias("place"))
        .filter(~F.lower("place").isin([x.lower() for x in excluded]))
        .groupBy("place")
        .agg(F.count(F.lit(1)).alias("n"))
    )
