"""The chain from file to file: each job reads what another one wrote and can be run on its own.

Options of the delimited reader (``multi_line``, ``sep``, ``encoding``) go through every job that reads such files.
"""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import SparkSession, functions as F

from casemill.functions.keys import nullable_key
from casemill.functions.text import array_to_text, parse_list_repr
from casemill.operators.classify import sample_settings, score_text_clf, train_text_clf, tune_text_clf
from casemill.operators.cleaning import drop_incomplete, drop_values, map_values
from casemill.operators.features import train_set_cover
from casemill.operators.joins import gold_join, hot_keys
from casemill.operators.masking import mask_column
from casemill.operators.metrics import confusion_matrix, misclassified
from casemill.operators.profile import RowCounts, error_profile, top_words
from casemill.operators.sampling import oversample, split_by_hash
from casemill.operators.tagging import flagged_sentences, tag_entities
from casemill.plans.cover import cover_features, covers_from_files, judges_from_html, labelled_covers
from casemill.plans.outcomes import case_outcomes
from casemill.plans.training import all_entities_examples, labelled_sentences, sentence_keys
from casemill.rules.defaults import (
    COVER_KEY_PATTERN,
    ENTITY_RULES,
    FILE_KEY_PATTERN,
    MINORITY_COPIES,
    NO_KEY,
    PERSON_RULE,
    TEST_SHARE,
)
from casemill.schemas import (
    CASE_OUTCOMES,
    GOLD_OUTCOMES,
    PREDICTIONS,
    SENTENCE_SCORES,
    SENTENCES,
    TAIL_SENTENCES,
)
from casemill.sources.files import (
    read_checked,
    read_delimited,
    read_documents,
    write_delimited,
    write_shards,
)


def _rows(spark: SparkSession, path, schema, rejected: str | None, job: str, **reading):
    """Rows of delimited files. A row that does not fit the schema is an error, or, with ``rejected``, is stored there
    with its file, under the name of the job; a job that runs again replaces what it has rejected before."""
    if rejected is None:
        return read_delimited(spark, path, schema, **reading)
    good, bad = read_checked(spark, path, schema, **reading)
    bad.write.mode("overwrite").json(f"{rejected}/job={job}")
    return good


def mask_sentences(
    spark: SparkSession,
    sentences: str,
    target: str,
    shards: int | None = None,
    pattern: str = PERSON_RULE,
    rejected: str | None = None,
    **reading,
) -> list[dict]:
    """Delimited sentences -> shards of masked sentences. Returns the rows read and kept (``RowCounts``)."""
    counts = RowCounts(spark)
    read = counts.at("read", _rows(counts.session, sentences, SENTENCES, rejected, "mask_sentences", **reading))
    complete = counts.at("complete", drop_incomplete(read))
    write_shards(mask_column(complete, "text", pattern), target, shards)
    return counts.report()


def tag_sentences(
    spark: SparkSession,
    shards: str | list[str],
    target: str,
    rules: dict[str, str] = ENTITY_RULES,
    rejected: str | None = None,
    **reading,
) -> list[dict]:
    """Shards of sentences -> Parquet table with one array column per label. Returns the rows read and tagged."""
    counts = RowCounts(spark)
    read = counts.at("read", _rows(counts.session, shards, SENTENCES, rejected, "tag_sentences", **{"sep": ",", **reading}))
    known = counts.at("tagged", drop_incomplete(read, ["text"]))
    tag_entities(known, "text", rules).write.parquet(target)
    return counts.report()


def flag_determinations(
    spark: SparkSession,
    tail: str,
    target: str,
    pattern: str = ENTITY_RULES["DETERMINATION"],
    rejected: str | None = None,
    **reading,
) -> list[dict]:
    """Delimited tail sentences -> Parquet table of those with a determination. Returns the rows read, complete and flagged."""
    counts = RowCounts(spark)
    read = counts.at("read", _rows(counts.session, tail, TAIL_SENTENCES, rejected, "flag_determinations", **reading))
    complete = counts.at("complete", drop_incomplete(read))
    flagged = flagged_sentences(complete, "text", pattern, "extracted_sentences_determination")
    counts.at("flagged", flagged).write.parquet(target)
    return counts.report()


def label_determinations(
    spark: SparkSession, determinations: str, gold: str, target: str, rejected: str | None = None, **reading
) -> None:
    """Determination sentences of the annotated cases with their annotation."""
    flagged = drop_values(spark.read.parquet(determinations), "decision_id", [NO_KEY])
    keyed = flagged.withColumn("decision_id", nullable_key(F.col("decision_id")))
    annotations = _rows(spark, gold, GOLD_OUTCOMES, rejected, "label_determinations", **reading)
    gold_join(keyed, annotations, "decision_id").write.parquet(target)


def _sentence_rows(table):
    """Flagged sentences as one text per row."""
    items = array_to_text(F.col("extracted_sentences_determination"))
    return table.withColumn("text", items).filter(F.col("text").isNotNull())


def train_sentence_model(
    spark: SparkSession,
    labelled: str,
    model: str,
    test_share: float = TEST_SHARE,
    copies: int = MINORITY_COPIES,
    **settings,
) -> list[dict]:
    """Labelled determination sentences -> stored model; returns what each setting scored.

    A case is in the training or in the test part, and accepted sentences are repeated in training.
    """
    rows = _sentence_rows(spark.read.parquet(labelled)).select(
        "decision_id", "text", F.col("decision").alias("labels")
    )
    parts = split_by_hash(rows, ["decision_id"], test_share)
    train = oversample(parts.filter("split = 'train'"), "labels", copies=copies)
    test = parts.filter("split = 'test'")
    trained = train_text_clf(train, test, **settings)
    trained.model.write().overwrite().save(model)
    return trained.history


def score_sentences(spark: SparkSession, model: str, determinations: str, target: str) -> None:
    """Stored model and determination sentences -> delimited sentence scores."""
    keyed = drop_values(spark.read.parquet(determinations), "decision_id", [NO_KEY])
    rows = _sentence_rows(keyed).select(
        nullable_key(F.col("decision_id")).alias("decision_id"), "text"
    )
    scored = score_text_clf(PipelineModel.load(model), rows)
    write_delimited(
        scored.select(
            "decision_id",
            F.col("text").alias("extracted_sentences_determination"),
            "predicted_class",
        ),
        target,
    )


def aggregate_outcomes(
    spark: SparkSession, scores: str, target: str, rejected: str | None = None, **reading
) -> None:
    """Delimited sentence scores -> delimited outcome per case."""
    write_delimited(case_outcomes(_rows(spark, scores, SENTENCE_SCORES, rejected, "aggregate_outcomes", **reading)), target)


def extract_covers(
    spark: SparkSession,
    covers: str,
    pages: str,
    target: str,
    cover_glob: str = "*.txt",
    key_pattern: str = FILE_KEY_PATTERN,
    cover_key_pattern: str = COVER_KEY_PATTERN,
    unmatched: str | None = None,
    **rules,
) -> None:
    """Directories of cover texts and of HTML decisions -> Parquet table of cover features.

    Files whose names hold no key are left out; ``unmatched`` is where their paths are stored.
    """
    texts = read_documents(spark, covers, cover_glob, cover_key_pattern)
    html = read_documents(spark, pages, "*.html", key_pattern, text="html")
    features = cover_features(
        covers_from_files(texts, cover_key_pattern), judges_from_html(html, key_pattern), **rules
    )
    features.write.parquet(target)
    if unmatched is not None:
        files = texts.select("decision_id", "path").unionByName(html.select("decision_id", "path"))
        files.filter(F.col("decision_id") == NO_KEY).select("path").write.json(unmatched)


def build_cover_examples(
    spark: SparkSession, features: str, outcomes: str, target: str, test_share: float = TEST_SHARE, rejected: str | None = None, **reading
) -> None:
    """Cover features and outcomes -> training set, written by split."""
    labelled = labelled_covers(
        spark.read.parquet(features), _rows(spark, outcomes, CASE_OUTCOMES, rejected, "build_cover_examples", **reading)
    )
    examples = split_by_hash(train_set_cover(labelled), ["decision_id"], test_share)
    examples.write.partitionBy("split").parquet(target)


def build_all_examples(
    spark: SparkSession,
    tagged: str,
    features: str,
    outcomes: str,
    target: str,
    test_share: float = TEST_SHARE,
    minority: int | None = None,
    rejected: str | None = None,
    **reading,
) -> None:
    """Tagged sentences, cover features and outcomes -> training set, written by split.

    With ``minority`` the training part repeats the examples of that class.
    """
    known = _rows(spark, outcomes, CASE_OUTCOMES, rejected, "build_all_examples", **reading)
    covers = labelled_covers(spark.read.parquet(features), known)
    sentences = spark.read.parquet(tagged)
    hot = hot_keys(sentences.select(nullable_key(F.col("decision_id")).alias("decision_id")), ["decision_id"])
    main = labelled_sentences(sentences, known, rules={}, mask=None, hot=hot).drop("text")
    joined = all_entities_examples(main, covers, hot=hot, keys=sentence_keys(sentences, known))
    examples = split_by_hash(joined, ["decision_id"], test_share)
    if minority is not None:
        repeated = (F.col("split") == "train") & (F.col("labels") == minority)
        examples = oversample(examples.withColumn("_minor", repeated), "_minor", minority=True)
        examples = examples.drop("_minor", "copy")
    examples.write.partitionBy("split").parquet(target)


def train_case_model(
    spark: SparkSession, examples: str, model: str, copies: int | None = None, **settings
) -> list[dict]:
    """Training set of cases, written by split -> stored model; returns what each number of epochs scored.

    With ``copies`` the accepted cases are repeated in training.
    """
    parts = spark.read.parquet(examples)
    train, test = parts.filter("split = 'train'"), parts.filter("split = 'test'")
    if copies is not None:
        train = oversample(train, "labels", copies=copies).drop("copy")
    trained = train_text_clf(train, test, **settings)
    trained.model.write().overwrite().save(model)
    return trained.history


def tune_case_model(
    spark: SparkSession, examples: str, model: str, trials: int = 10, seed: int = 0, **settings
) -> list[dict]:
    """Training set of cases -> stored model of the best of some random settings; returns what each scored."""
    train = spark.read.parquet(examples).filter("split = 'train'")
    found = tune_text_clf(train, "decision_id", sample_settings(trials, seed), **settings)
    found.model.write().overwrite().save(model)
    return found.history


def predict_cases(
    spark: SparkSession, model: str, examples: str, target: str, split: str | None = "test"
) -> None:
    """Stored model and cases -> delimited predictions, as ``report_errors`` reads them; of one split, or of all."""
    rows = spark.read.parquet(examples)
    if split is not None:
        rows = rows.filter(F.col("split") == split)
    scored = score_text_clf(PipelineModel.load(model), rows.select("text", "labels"))
    write_delimited(scored.select("text", "labels", "prediction"), target, sep=",")


def report_errors(
    spark: SparkSession, predictions: str, target: str, rejected: str | None = None, **reading
) -> None:
    """Delimited predictions -> confusion table, wrong rows, their profile and their top words."""
    read = _rows(spark, predictions, PREDICTIONS, rejected, "report_errors", **{"sep": ",", **reading})
    rows = read.select(
        "text",
        map_values(F.col("labels"), {0: "REJECTED", 1: "GRANTED"}).alias("label"),
        map_values(
            F.col("prediction"), {"NEGATIVE": "REJECTED", "POSITIVE": "GRANTED"}
        ).alias("prediction"),
    )
    wrong = ~F.col("label").eqNullSafe(F.col("prediction"))
    reports = {
        "confusion_matrix": confusion_matrix(rows, "label", "prediction", ["REJECTED", "GRANTED"]),
        "misclassified": misclassified(rows, "label", "prediction"),
        "error_profile": error_profile(rows, "text", wrong),
        "top_words": top_words(rows, "text", wrong),
    }
    for name, report in reports.items():
        write_delimited(report, f"{target}/{name}", sep=",")


def import_legacy_lists(
    spark: SparkSession, source: str, target: str, schema: str, lists: list[str], sep: str = ";",
    rejected: str | None = None, **reading
) -> None:
    """Delimited table whose list columns were written out as text -> Parquet with real arrays."""
    table = _rows(spark, source, schema, rejected, "import_legacy_lists", sep=sep, **reading)
    table.withColumns({c: parse_list_repr(F.col(c)) for c in lists}).write.parquet(target)
