"""Sentence scores, votes and distributions, on the event table."""

from __future__ import annotations

from pyspark.sql import functions as F

from casemill.bindings.registry import query, table
from casemill.operators.outcomes import (
    bin_score,
    case_votes,
    class_balance,
    class_distribution,
    score_density,
    score_range,
    unanimous,
)
from casemill.plans.outcomes import case_outcomes


def scored(spark, sf):
    """Events as scored sentences: the case is a user's day, the score the last digit of the value."""
    day = F.month("ts") * 100 + F.dayofmonth("ts")
    return table(spark, sf, "events").select(
        "event_id",
        "user_id",
        (F.col("user_id") * 10000 + day).alias("decision_id"),
        ((F.col("value") % 10) / 10).alias("score"),
    )


def binned(spark, sf):
    return scored(spark, sf).select("event_id", "decision_id", bin_score(F.col("score")).cast("bigint").alias("class"))


SCORED = """(SELECT event_id, user_id, user_id * 10000 + month(ts) * 100 + day(ts) AS decision_id,
    (value % 10) / 10 AS score FROM events)"""
BINNED = f"""(SELECT event_id, decision_id, CAST(CASE WHEN score < 0.4 THEN 0 WHEN score > 0.6 THEN 1 ELSE 2 END AS BIGINT) AS class
    FROM {SCORED})"""
VOTED = f"""(SELECT decision_id, CAST(CASE WHEN a > b AND a > c THEN 0 WHEN b > a AND b > c THEN 1 ELSE 2 END AS BIGINT) AS decision_outcome
    FROM (SELECT decision_id, count(CASE WHEN class = 0 THEN 1 END) AS a, count(CASE WHEN class = 1 THEN 1 END) AS b,
          count(CASE WHEN class = 2 THEN 1 END) AS c FROM {BINNED} GROUP BY decision_id))"""


@query("bin_scores", f"SELECT event_id, class FROM {BINNED}")
def _(spark, sf):
    return binned(spark, sf).select("event_id", "class")


@query("case_outcome_vote", f"SELECT decision_id, decision_outcome FROM {VOTED}")
def case_outcome_vote(spark, sf):
    outcomes = case_outcomes(scored(spark, sf), score="score")
    return outcomes.select("decision_id", F.col("decision_outcome").cast("bigint"))


@query(
    "group_unanimous",
    f"SELECT decision_id, min(class) = max(class) AS all_equal FROM {BINNED} GROUP BY decision_id",
)
def _(spark, sf):
    return unanimous(binned(spark, sf), "decision_id", "class")


@query(
    "class_distribution",
    f"""SELECT decision_outcome, count(*) AS n, round(count(*) * 100 / CAST(sum(count(*)) OVER () AS DOUBLE), 2) AS percent
        FROM {VOTED} GROUP BY decision_outcome""",
)
def _(spark, sf):
    votes = case_votes(binned(spark, sf), "decision_id", "class")
    return class_distribution(votes.withColumn("decision_outcome", F.col("decision_outcome").cast("bigint")), "decision_outcome")


@query(
    "class_balance",
    """SELECT count(CASE WHEN quality = 0 THEN 1 END) AS negative, count(CASE WHEN quality = 1 THEN 1 END) AS positive,
       count(*) AS total, round(count(CASE WHEN quality = 1 THEN 1 END) * 100 / CAST(count(*) AS DOUBLE), 2) AS positive_percent
       FROM labels""",
)
def _(spark, sf):
    return class_balance(table(spark, sf, "labels"), "quality")


@query("score_range", f"SELECT min(score) AS min_score, max(score) AS max_score FROM {SCORED}")
def _(spark, sf):
    return score_range(scored(spark, sf), "score")


@query(
    "score_density",
    f"""WITH stats AS (SELECT n, h, low - 3 * h AS low, high + 3 * h AS high FROM (SELECT count(*) AS n,
          0.25 * pow(count(*), -0.2) * stddev_samp(score) AS h, min(score) AS low, max(score) AS high FROM {SCORED})),
        grid AS (SELECT i AS point, low + i * ((high - low) / 199) AS g, n, h FROM stats, range(200) AS r(i)),
        merged AS (SELECT score, count(*) AS w FROM {SCORED} GROUP BY score)
        SELECT point, round(any_value(g), 6) AS score, round(sum(w * exp(-0.5 * pow((g - score) / h, 2))) / any_value(n * h * sqrt(2 * pi())), 6) AS density
        FROM grid, merged GROUP BY point""",
)
def _(spark, sf):
    density = score_density(scored(spark, sf), "score")
    return density.select(
        F.col("point").cast("bigint"), F.round("score", 6).alias("score"), F.round("density", 6).alias("density")
    )
