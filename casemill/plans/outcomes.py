"""Sentences: from case texts to one outcome per case."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from casemill.functions.text import tail_paragraphs
from casemill.operators.outcomes import bin_score, case_votes
from casemill.operators.tagging import flagged_sentences
from casemill.rules.defaults import ENTITY_RULES, HIGH_SCORE, LOW_SCORE, TAIL_PARAGRAPHS


def tail_sentences(
    texts: DataFrame, case: str = "decision_id", text: str = "text", n: int = TAIL_PARAGRAPHS
) -> DataFrame:
    """Last paragraphs of every case, one row each with its position, without a shuffle."""
    return texts.select(case, F.posexplode(tail_paragraphs(F.col(text), n)).alias("position", text))


def determination_sentences(
    texts: DataFrame,
    case: str = "decision_id",
    text: str = "text",
    pattern: str = ENTITY_RULES["DETERMINATION"],
    n: int = TAIL_PARAGRAPHS,
) -> DataFrame:
    """Tail paragraphs with a determination span, the spans instead of the text."""
    tail = tail_sentences(texts, case, text, n)
    return flagged_sentences(tail, text, pattern, "extracted_sentences_determination")


def case_outcomes(
    scores: DataFrame,
    case: str = "decision_id",
    score: str = "predicted_class",
    low: float = LOW_SCORE,
    high: float = HIGH_SCORE,
) -> DataFrame:
    """Bin every sentence score and let the sentences of a case vote."""
    binned = scores.select(case, bin_score(F.col(score), low, high).alias("_class"))
    return case_votes(binned, case, "_class")
