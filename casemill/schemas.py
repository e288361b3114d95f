"""Schemas of the logical tables, declared once instead of inferred from file headers."""

from __future__ import annotations

from pyspark.sql import types as T

from casemill.rules.defaults import ENTITY_LABELS


def _schema(*fields):
    return T.StructType([T.StructField(name, dtype, True) for name, dtype in fields])


_TEXTS = T.ArrayType(T.StringType())

CASE_COVER_RAW = _schema(("decision_id", T.StringType()), ("text_case_cover", T.StringType()))

JUDGES = _schema(("decision_id", T.StringType()), ("ner_output", _TEXTS))

CASE_COVER_FEATURES = _schema(
    ("decision_id", T.StringType()),
    ("text_case_cover", T.StringType()),
    ("extracted_dates", _TEXTS),
    ("extracted_gpe", _TEXTS),
    ("extracted_org", _TEXTS),
    ("extracted_persons", _TEXTS),
    ("public_private_hearing", T.StringType()),
    ("in_chamber_virtual", T.StringType()),
    ("ner_output", _TEXTS),
    ("judge_name", T.StringType()),
    ("date_decision", T.StringType()),
)

SENTENCES = _schema(("decision_id", T.StringType()), ("text", T.StringType()))

TAIL_SENTENCES = SENTENCES

SENTENCE_ENTITIES = _schema(
    ("decision_id", T.StringType()),
    ("text", T.StringType()),
    *[(label, _TEXTS) for label in ENTITY_LABELS],
)

DETERMINATION_SENTENCES = _schema(
    ("decision_id", T.StringType()), ("extracted_sentences_determination", _TEXTS)
)

GOLD_OUTCOMES = _schema(("decision_id", T.LongType()), ("decision", T.IntegerType()))

SENTENCE_SCORES = _schema(
    ("decision_id", T.LongType()),
    ("extracted_sentences_determination", T.StringType()),
    ("predicted_class", T.DoubleType()),
)

CASE_OUTCOMES = _schema(("decision_id", T.LongType()), ("decision_outcome", T.IntegerType()))

TRAIN_EXAMPLES = _schema(("text", T.StringType()), ("labels", T.IntegerType()))

PREDICTIONS = _schema(
    ("text", T.StringType()), ("labels", T.IntegerType()), ("prediction", T.StringType())
)
