"""Main text and cover features of a corpus as classifier examples."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from casemill.functions.keys import nullable_key
from casemill.operators.features import train_set_all
from casemill.operators.joins import label_join, natural_outer_join
from casemill.operators.masking import mask_column
from casemill.operators.tagging import tag_entities
from casemill.rules.defaults import ALL_FEATURES, ENTITY_RULES, PERSON_RULE, SEP


def labelled_sentences(
    sentences: DataFrame,
    outcomes: DataFrame,
    rules: dict[str, str] = ENTITY_RULES,
    mask: str | None = PERSON_RULE,
    text: str = "text",
    **salting,
) -> DataFrame:
    """Masked and tagged sentences with the outcome of their case.

    A key that is no number is NULL and drops out, so bad keys never meet in one group.
    """
    known = sentences.filter(F.col(text).isNotNull())
    masked = mask_column(known, text, mask) if mask else known
    keyed = tag_entities(masked, text, rules).withColumn(
        "decision_id", nullable_key(F.col("decision_id"))
    )
    return label_join(keyed, outcomes, "decision_id", "decision_outcome", **salting)


def sentence_keys(sentences: DataFrame, outcomes: DataFrame, text: str = "text") -> DataFrame:
    """The keys of ``labelled_sentences``, without masking or tagging a sentence."""
    known = sentences.filter(F.col(text).isNotNull()).select(nullable_key(F.col("decision_id")).alias("decision_id"))
    return label_join(known.distinct(), outcomes.select("decision_id", "decision_outcome"), "decision_id", "decision_outcome", unique=True)


def all_labelled(main: DataFrame, covers: DataFrame, **salting) -> DataFrame:
    """Sentences and covers on all shared columns; what only one side has is kept."""
    return natural_outer_join(main, covers, **salting)


def all_entities_examples(
    main: DataFrame,
    covers: DataFrame,
    features: list[str] = ALL_FEATURES,
    sep: str = SEP,
    **salting,
) -> DataFrame:
    """One text per labelled row from all entity and cover features."""
    return train_set_all(all_labelled(main, covers, **salting), features=features, sep=sep)
