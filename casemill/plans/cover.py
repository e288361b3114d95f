"""Case covers: from raw cover texts to labelled cover features, as one plan."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from casemill.functions.arrays import empty_texts
from casemill.functions.dates import (
    clean_date_items,
    date_span,
    latest_date,
    parsed_dates,
    print_date,
)
from casemill.functions.html import signature_items
from casemill.functions.keys import key_from_path, nullable_key
from casemill.functions.text import apply_fixups, array_to_text, normalize_text
from casemill.operators.cleaning import drop_values, rename_features
from casemill.operators.joins import label_join
from casemill.operators.reconcile import reconcile_dates, reconcile_names
from casemill.operators.sampling import last_write_wins
from casemill.operators.tagging import tag_cover
from casemill.rules.defaults import (
    COVER_KEY_PATTERN,
    COVER_RULES,
    DEFAULT_HEARING_MODE,
    FILE_KEY_PATTERN,
    HEARING_MODE_PATTERN,
    HEARING_TYPE_PATTERN,
    NO_KEY,
    UNREADABLE,
)


def covers_from_files(files: DataFrame, key_pattern: str = COVER_KEY_PATTERN) -> DataFrame:
    """Clean cover text per decision from ``(path, text)`` rows.

    Files without a key and unreadable covers are left out; of two files with one key the one with
    the greater path stays.
    """
    keyed = files.select(
        key_from_path(F.col("path"), key_pattern).alias("decision_id"), "path", "text"
    )
    readable = drop_values(drop_values(keyed, "decision_id", [NO_KEY]), "text", [UNREADABLE])
    newest = last_write_wins(readable, "decision_id", "path")
    return newest.select("decision_id", normalize_text(F.col("text")).alias("text_case_cover"))


def judges_from_html(
    files: DataFrame, key_pattern: str = FILE_KEY_PATTERN, tag: str = "table", **options
) -> DataFrame:
    """Items of the signature block per decision from ``(path, html)`` rows."""
    keyed = files.select(
        key_from_path(F.col("path"), key_pattern).alias("decision_id"),
        "path",
        signature_items(F.col("html"), tag, **options).alias("ner_output"),
    )
    return last_write_wins(
        drop_values(keyed, "decision_id", [NO_KEY]), "decision_id", "path"
    ).drop("path")


def cover_features(
    covers: DataFrame,
    judges: DataFrame,
    rules: dict[str, str] = COVER_RULES,
    hearing_type: str = HEARING_TYPE_PATTERN,
    hearing_mode: str = HEARING_MODE_PATTERN,
) -> DataFrame:
    """Tag the covers, add the signature items, and reconcile judge and decision date."""
    tagged = tag_cover(covers, "text_case_cover", rules, hearing_type, hearing_mode)
    joined = tagged.join(judges, "decision_id", "left").withColumn(
        "ner_output", F.coalesce("ner_output", empty_texts())
    )
    named = reconcile_names(joined, "extracted_persons", "ner_output")
    deduped = named.withColumn("extracted_dates", F.array_sort(F.array_distinct("extracted_dates")))
    return reconcile_dates(deduped, "extracted_dates", "ner_output")


def labelled_covers(features: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Cleaned cover features with the outcome of the case, under their feature names."""
    dated = features.withColumn("_days", parsed_dates(clean_date_items(F.col("extracted_dates"))))
    cleaned = dated.select(
        nullable_key(F.col("decision_id")).alias("decision_id"),
        array_to_text(F.col("extracted_dates")).alias("extracted_dates"),
        apply_fixups(array_to_text(F.col("extracted_gpe"))).alias("extracted_gpe"),
        array_to_text(F.col("extracted_org")).alias("extracted_org"),
        "public_private_hearing",
        F.coalesce("in_chamber_virtual", F.lit(DEFAULT_HEARING_MODE)).alias("in_chamber_virtual"),
        F.nullif(F.col("judge_name"), F.lit("")).alias("judge_name"),
        print_date(latest_date(F.col("_days"))).alias("decision_date"),
        date_span(F.col("_days")).alias("span_time_decision"),
    )
    labelled = label_join(cleaned, outcomes, "decision_id", "decision_outcome", unique=True)
    return rename_features(labelled).drop("span_time_decision")
