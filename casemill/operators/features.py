"""Training sets: labelled features as one text per example."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from casemill.functions.text import (
    array_to_text,
    collapse_separators,
    join_features,
    parse_list_repr,
    strip_punctuation,
)
from casemill.operators.cleaning import as_text_columns, decided_only, drop_incomplete
from casemill.rules.defaults import ALL_FEATURES, COVER_FEATURES, SEP


def _train_set(df, case, outcome, features, array_sep, sep):
    typed = as_text_columns(decided_only(df, outcome), features, array_sep)
    text = strip_punctuation(join_features([F.col(c) for c in features], sep))
    return typed.select(case, F.col(outcome).cast("int").alias("labels"), text.alias("text"))


def train_set_cover(
    df: DataFrame,
    case: str = "decision_id",
    outcome: str = "decision_outcome",
    features: list[str] = COVER_FEATURES,
    sep: str = SEP,
) -> DataFrame:
    """Decided cases with their cover features as one text."""
    return _train_set(df, case, outcome, features, ", ", sep)


def train_set_all(
    df: DataFrame,
    case: str = "decision_id",
    outcome: str = "decision_outcome",
    features: list[str] = ALL_FEATURES,
    sep: str = SEP,
) -> DataFrame:
    """Decided rows with all entity and cover features as one text, empty features squeezed out."""
    built = _train_set(df, case, outcome, features, " ", sep)
    return built.withColumn("text", collapse_separators(F.col("text"), sep))


def train_set_sentences(df: DataFrame, sentences: str, label: str) -> DataFrame:
    """Labelled sentences; the sentence column is an array or a written-out list."""
    complete = drop_incomplete(df)
    return complete.select(
        _sentence_text(df, sentences).alias("text"), F.col(label).cast("int").alias("labels")
    )


def inference_set_sentences(df: DataFrame, sentences: str, label: str) -> DataFrame:
    """All sentences for scoring, without the label."""
    return df.withColumn(sentences, _sentence_text(df, sentences)).drop(label)


def _sentence_text(df, sentences):
    items = F.col(sentences)
    if not dict(df.dtypes)[sentences].startswith("array"):
        items = parse_list_repr(items)
    return array_to_text(items, ", ")
