"""Training sets, text classification and the pipelines from raw text to result."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from casemill.bindings.registry import pages, query, table, texts
from casemill.functions.text import paragraphs, word_count
from casemill.operators.classify import sample_settings, score_text_clf, train_text_clf, train_text_epochs, tune_text_clf
from casemill.operators.features import train_set_all, train_set_cover, train_set_sentences
from casemill.operators.joins import gold_join, hot_keys
from casemill.operators.cleaning import map_values
from casemill.operators.metrics import f1_score
from casemill.operators.sampling import oversample, split_by_hash
from casemill.operators.tagging import tag_entities
from casemill.plans.cover import cover_features, covers_from_files, judges_from_html, labelled_covers
from casemill.plans.outcomes import case_outcomes, tail_sentences
from casemill.plans.training import all_entities_examples, labelled_sentences, sentence_keys
from casemill.rules.defaults import ALL_FEATURES, CLASS_NAMES, COVER_FEATURES, COVER_RULES, ENTITY_LABELS

_CLEAN = r"regexp_replace(regexp_replace({0}, '[^\p{{L}}\p{{N}}_\s\[\]]', ' ', 'g'), ' +', ' ', 'g')"
# Patterns of the entity features, which occur in the test documents.
_STEMS = {x: f"[a-z]+{stem}" for x, stem in zip(ENTITY_LABELS, ("tion", "ing", "er", "ment", "lich") * 3, strict=True)}


def wide_features(spark, sf):
    """All feature columns of the labelled documents: found words as arrays, cover fields as text."""
    docs = texts(spark, sf, "doc_id", "text", "lang", "source", "n_chars")
    tagged = tag_entities(docs.join(table(spark, sf, "labels"), "doc_id", "left"), "text", _STEMS)
    n = F.col("n_chars")
    return tagged.select(
        F.col("doc_id").alias("decision_id"),
        F.coalesce("quality", F.lit(2)).alias("decision_outcome"),
        *ENTITY_LABELS,
        F.regexp_extract_all("text", F.lit("[a-z]+ting"), F.lit(0)).alias("extracted_dates"),
        F.col("lang").alias("LOC_HEARING"),
        F.concat(F.lit("division "), "source").alias("TRIBUNAL"),
        F.when(n > 400, "public hearing").alias("PUBLIC_PRIVATE_HEARING"),
        F.when(F.col("lang") == "en", "in chambers").alias("INCHAMBER_VIRTUAL_HEARING"),
        F.when(n > 900, F.concat(F.lit("doe, "), "lang")).alias("JUDGE"),
        n.alias("DATE_DECISION"),
    )


def _feature_sql(sep):
    cells = {x: f"coalesce(array_to_string(regexp_extract_all(text, '{p}'), '{sep}'), '')" for x, p in _STEMS.items()}
    cells |= {
        "extracted_dates": f"array_to_string(regexp_extract_all(text, '[a-z]+ting'), '{sep}')",
        "LOC_HEARING": "lang",
        "TRIBUNAL": "'division ' || source",
        "PUBLIC_PRIVATE_HEARING": "CASE WHEN n_chars > 400 THEN 'public hearing' ELSE '' END",
        "INCHAMBER_VIRTUAL_HEARING": "CASE WHEN lang = 'en' THEN 'in chambers' ELSE '' END",
        "JUDGE": "CASE WHEN n_chars > 900 THEN 'doe, ' || lang ELSE '' END",
        "DATE_DECISION": "CAST(n_chars AS VARCHAR)",
    }
    return cells


def _wide_text(names, sep):
    cells = " || '[SEP]' || ".join(_feature_sql(sep)[n] for n in names)
    return f"(SELECT doc_id, quality, {cells} AS text FROM documents JOIN labels USING (doc_id))"


def _long(df):
    return df.withColumn("labels", F.col("labels").cast("bigint"))


@query(
    "train_set_cover",
    f"SELECT doc_id AS decision_id, CAST(quality AS BIGINT) AS labels, {_CLEAN.format('text')} AS text FROM {_wide_text(COVER_FEATURES, ', ')}",
)
def _(spark, sf):
    return _long(train_set_cover(wide_features(spark, sf)))


@query(
    "train_set_all",
    rf"""SELECT doc_id AS decision_id, CAST(quality AS BIGINT) AS labels,
        regexp_replace({_CLEAN.format('text')}, '(\[SEP\]){{2,}}', '[SEP]', 'g') AS text FROM {_wide_text(ALL_FEATURES, ' ')}""",
)
def _(spark, sf):
    return _long(train_set_all(wide_features(spark, sf)))


@query(
    "train_set_sentences",
    """SELECT CAST(quality AS BIGINT) AS labels, nullif(array_to_string(regexp_extract_all(text, '[a-z]+tion'), ', '), '') AS text
       FROM documents JOIN labels USING (doc_id)""",
)
def _(spark, sf):
    docs = texts(spark, sf, "doc_id", "text").join(table(spark, sf, "labels"), "doc_id", "left")
    spans = F.regexp_extract_all("text", F.lit("[a-z]+tion"), F.lit(0)).alias("spans")
    return _long(train_set_sentences(docs.select(spans, "quality"), "spans", "quality"))


def examples(spark, sf):
    docs = texts(spark, sf, "doc_id", "text")
    labelled = gold_join(docs, table(spark, sf, "labels").select("doc_id", F.col("quality").alias("labels")), "doc_id")
    return split_by_hash(labelled, ["doc_id"])


def _halves(rows):
    return rows.filter("split = 'train'"), rows.filter("split = 'test'")


def _trained(spark, sf):
    train, test = _halves(examples(spark, sf))
    balanced = oversample(train, "labels", minority=0).drop("copy")
    return train_text_clf(balanced, test, epochs=(5, 15), n_features=1 << 12, reg=0.1, pieces=4)


# The rows of each part. What a model learns is not for SQL to say, but that it is better than always saying the larger class.
_PARTS = """SELECT CAST(quality AS BIGINT) AS labels, CASE WHEN CAST('0x' || substr(md5('0|' || doc_id), 1, 8) AS BIGINT) % 10000 < 2000
    THEN 'test' ELSE 'train' END AS split FROM documents JOIN labels USING (doc_id)"""
_PART_ROWS = f"SELECT count(CASE WHEN split = 'train' THEN 1 END) AS train_rows, count(CASE WHEN split = 'test' THEN 1 END) AS test_rows FROM ({_PARTS})"


def _larger_class(test) -> float:
    """Macro F1 of always saying the more frequent class, of the classes that occur."""
    counts = [r["count"] for r in test.groupBy("labels").count().collect()]
    return 2 * max(counts) / (sum(counts) + max(counts)) / len(counts)


@query(
    "train_text_clf",
    f"SELECT epochs, train_rows, test_rows, true AS beats_larger_class FROM ({_PART_ROWS}), (VALUES (5::BIGINT), (15::BIGINT)) AS e(epochs)",
)
def _(spark, sf):
    rows = examples(spark, sf)
    train, test = _halves(rows)
    least = _larger_class(test)
    history = _trained(spark, sf).history
    sizes = train.count(), test.count()
    return spark.createDataFrame(
        [(h["epochs"], *sizes, h["macro_f1"] > least) for h in history],
        "epochs bigint, train_rows bigint, test_rows bigint, beats_larger_class boolean",
    )


@query("text_clf_metrics")
def _(spark, sf):
    """What each number of epochs scores on the test part."""
    rows = [(h["epochs"], h["accuracy"], h["macro_f1"], h["weighted_f1"]) for h in _trained(spark, sf).history]
    return spark.createDataFrame(rows, "epochs bigint, accuracy double, macro_f1 double, weighted_f1 double")


@query(
    "text_clf_epochs",
    f"SELECT epochs, test_rows, true AS loss_falls, true AS shares_of_rows FROM ({_PART_ROWS}), (SELECT unnest(range(1, 11)) AS epochs)",
)
def _(spark, sf):
    """Every epoch of one training: its loss is below that of the epoch before, and accuracy is a share of the test rows."""
    train, test = _halves(examples(spark, sf))
    history = train_text_epochs(train, test, epochs=10, n_features=1 << 12, reg=0.1, pieces=4).history
    n, before = test.count(), [math.inf, *(h["loss"] for h in history)]
    rows = [(h["epochs"], n, h["loss"] < last, abs(h["accuracy"] * n - round(h["accuracy"] * n)) < 1e-6) for h, last in zip(history, before)]
    return spark.createDataFrame(rows, "epochs bigint, test_rows bigint, loss_falls boolean, shares_of_rows boolean")


@query("text_clf_predictions")
def _(spark, sf):
    """Class and score of every document, and its label if it has one."""
    scored = score_text_clf(_trained(spark, sf).model, texts(spark, sf, "doc_id", "text"))
    known = table(spark, sf, "labels").select("doc_id", F.col("quality").cast("bigint").alias("label"))
    return scored.join(known, "doc_id", "left").select("doc_id", "label", "prediction", F.col("predicted_class").alias("score"))


@query(
    "score_text_clf",
    "SELECT doc_id, true AS class_is_of_score, true AS score_is_a_share FROM documents",
)
def _(spark, sf):
    model = _trained(spark, sf).model
    scored = score_text_clf(model, texts(spark, sf, "doc_id", "text"))
    share = F.col("predicted_class")
    named = F.when(share > 0.5, CLASS_NAMES[1]).otherwise(CLASS_NAMES[0])
    return scored.select(
        "doc_id",
        (F.col("prediction") == named).alias("class_is_of_score"),
        share.between(0, 1).alias("score_is_a_share"),
    )


_SETTINGS = sample_settings(2, n_features=(1 << 12,), epochs=(5, 10))
_TRIED = ", ".join(f"({s['epochs']}::BIGINT, {s['n_features']}::BIGINT, {round(s['reg'], 9)!r}::DOUBLE)" for s in _SETTINGS)


@query(
    "tune_text_clf",
    f"SELECT epochs, n_features, reg, test_rows, true AS beats_larger_class FROM ({_PART_ROWS}), (VALUES {_TRIED}) AS s(epochs, n_features, reg)",
)
def _(spark, sf):
    train, test = _halves(examples(spark, sf))
    found = tune_text_clf(oversample(train, "labels", minority=0).drop("copy"), "doc_id", _SETTINGS, pieces=4)
    # The best setting's model, on the half that the search has not seen.
    scored = score_text_clf(found.model, test).withColumn("_true", map_values(F.col("labels"), CLASS_NAMES))
    held_out = f1_score(scored, "_true", "prediction", "macro").first()["f1"]
    better = held_out > _larger_class(test)
    return spark.createDataFrame(
        [(h["epochs"], h["n_features"], round(h["reg"], 9), test.count(), better) for h in found.history],
        "epochs bigint, n_features bigint, reg double, test_rows bigint, beats_larger_class boolean",
    )


# From raw text to result -----------------------------------------------------------------------


@query(
    "outcomes_from_sentences",
    r"""WITH tail AS (SELECT doc_id, unnest(list_filter(string_split(text, chr(10)), lambda p: trim(p) <> '')[-10:]) AS text FROM documents),
       s AS (SELECT doc_id, (len(list_filter(string_split_regex(text, '\s+'), lambda x: x <> '')) % 10) / 10.0::DOUBLE AS score FROM tail),
       v AS (SELECT doc_id, count(CASE WHEN score < 0.4 THEN 1 END) AS a, count(CASE WHEN score > 0.6 THEN 1 END) AS b, count(*) AS n FROM s GROUP BY doc_id)
       SELECT doc_id AS decision_id, CAST(CASE WHEN a > b AND a > n - a - b THEN 0 WHEN b > a AND b > n - a - b THEN 1 ELSE 2 END AS BIGINT) AS decision_outcome
       FROM v""",
)
def _(spark, sf):
    tail = tail_sentences(texts(spark, sf, "doc_id", "text"), "doc_id", "text")
    scores = tail.select(
        F.col("doc_id").alias("decision_id"), ((word_count(F.col("text")) % 10) / 10.0).alias("predicted_class")
    )
    outcomes = case_outcomes(scores)
    return outcomes.select("decision_id", F.col("decision_outcome").cast("bigint"))


def _name(number):
    """A two-word name spelled from a number."""
    spelled = F.translate((number % 1000).cast("string"), "0123456789", "abcdefghij")
    return spelled, F.concat(spelled, F.lit(" roe"))


def _day(number):
    return F.date_add(F.lit("2010-01-01").cast("date"), (number % 3000).cast("int"))


def cover_files(spark, sf):
    """Documents as cover files: two dates and a member's name above the text."""
    n = F.col("doc_id")
    heard = F.date_sub(_day(n), (n % 50).cast("int"))
    return texts(spark, sf, "doc_id", "text").select(
        F.concat(F.lit("x/2015canlii"), n, F.lit(".pdf")).alias("path"),
        F.concat(
            F.lit("Decision of "),
            F.date_format(_day(n), "MMMM d, yyyy"),
            F.lit("  heard "),
            F.date_format(heard, "MMMM d, yyyy"),
            F.lit("\nbefore member "),
            _name(n)[1],
            F.lit("\n"),
            "text",
        ).alias("text"),
    )


def signature_files(spark, sf):
    """Pages as decision files that end with a signature table: the date, and the name or its reverse."""
    n = F.col("page_id")
    spelled, name = _name(n)
    signed = F.when(n % 2 == 0, name).otherwise(F.concat(F.lit("Roe, "), spelled))
    rows = F.concat(F.date_format(_day(n), "MMMM d, yyyy"), F.lit("\n&nbsp;\n  "), signed)
    return pages(spark, sf, "page_id", "html").select(
        F.concat(F.lit("y/2015canlii"), n, F.lit(".html")).alias("path"),
        F.concat("html", F.lit("<table><tr><td>"), rows, F.lit("</td></tr></table>")).alias("html"),
    )


# Rules of the cover plan, some of them for words of the test documents.
_COVER_RULES = {**COVER_RULES, "GPE": "[a-z]+tion", "ORG": "[a-z]+ment"}

_COVERS = r"""covers AS (SELECT *, strftime(day, '%B %-d, %Y') AS d1, strftime(day - CAST(doc_id % 50 AS INTEGER), '%B %-d, %Y') AS d2,
      spelled || ' roe' AS name FROM (
      SELECT doc_id, DATE '2010-01-01' + CAST(doc_id % 3000 AS INTEGER) AS day, text AS body,
        translate(CAST(doc_id % 1000 AS VARCHAR), '0123456789', 'abcdefghij') AS spelled FROM documents)),
    texts AS (SELECT *, regexp_replace(lower('Decision of ' || d1 || '  heard ' || d2 || chr(10) || 'before member ' || name
      || chr(10) || body), '\s+', ' ', 'g') AS cover FROM covers),
    features AS (SELECT doc_id, page_id, day, name, spelled, list_sort(list_distinct([lower(d1), lower(d2)])) AS dates, d1,
      regexp_extract_all(cover, '[a-z]+tion') AS gpe, regexp_extract_all(cover, '[a-z]+ment') AS org,
      nullif(regexp_extract(cover, 'the|le|der'), '') AS hearing, nullif(regexp_extract(cover, 'ing|ent|ung'), '') AS mode,
      CASE WHEN page_id IS NULL THEN '' WHEN doc_id % 2 = 0 THEN name ELSE 'roe, ' || spelled END AS judge
      FROM texts LEFT JOIN (SELECT page_id FROM pages) ON page_id = doc_id)"""


def cover_feature_rows(spark, sf):
    covers = covers_from_files(cover_files(spark, sf))
    judges = judges_from_html(signature_files(spark, sf))
    return cover_features(covers, judges, _COVER_RULES, "the|le|der", "ing|ent|ung")


@query(
    "cover_features_from_files",
    f"""WITH {_COVERS} SELECT CAST(doc_id AS VARCHAR) AS decision_id, array_to_string(dates, '|') AS extracted_dates,
        array_to_string(gpe, '|') AS extracted_gpe, name AS extracted_persons, hearing AS public_private_hearing,
        mode AS in_chamber_virtual, judge AS judge_name,
        CASE WHEN page_id IS NULL THEN '' ELSE replace(lower(d1), ',', '') END AS date_decision FROM features""",
)
def _(spark, sf):
    return cover_feature_rows(spark, sf).select(
        "decision_id",
        *[F.array_join(c, "|").alias(c) for c in ("extracted_dates", "extracted_gpe", "extracted_persons")],
        "public_private_hearing",
        "in_chamber_virtual",
        "judge_name",
        "date_decision",
    )


def case_labels(spark, sf):
    return table(spark, sf, "labels").select(
        F.col("doc_id").alias("decision_id"), F.col("quality").cast("bigint").alias("decision_outcome")
    )


_LABELLED = f"""{_COVERS}, labelled AS (SELECT doc_id AS decision_id, CAST(quality AS BIGINT) AS decision_outcome,
      array_to_string(dates, ', ') AS extracted_dates, replace(nullif(array_to_string(gpe, ', '), ''), 'que bec', 'quebec') AS "LOC_HEARING",
      nullif(array_to_string(org, ', '), '') AS "TRIBUNAL", hearing AS "PUBLIC_PRIVATE_HEARING",
      coalesce(mode, 'in chambers') AS "INCHAMBER_VIRTUAL_HEARING", nullif(judge, '') AS "JUDGE",
      strftime(day, '%B %d, %Y') AS "DATE_DECISION" FROM features JOIN labels USING (doc_id))"""


@query("labelled_covers", f"WITH {_LABELLED} SELECT * FROM labelled")
def _(spark, sf):
    return labelled_covers(cover_feature_rows(spark, sf), case_labels(spark, sf))


_SENTENCE_RULES = {x: "[a-z]+tion" if i % 2 else "[a-z]+ing" for i, x in enumerate(ENTITY_LABELS)}
_MASK = "[a-z]+@[a-z.]+"


@query(
    "examples_from_corpus",
    f"""WITH {_LABELLED}, sentences AS (SELECT doc_id AS decision_id, unnest(list_filter(string_split(text, chr(10)), lambda p: trim(p) <> '')) AS s
          FROM documents),
        masked AS (SELECT decision_id, array_to_string(list_transform(range(1, len(rest) + 1), lambda i: rest[i] || coalesce(
            substr(m[i], 1, greatest(length(m[i]) - 20, 0)) || repeat('X', least(length(m[i]), 20)), '')), '') AS t
          FROM (SELECT decision_id, regexp_extract_all(s, '{_MASK}') AS m, string_split_regex(s, '{_MASK}') AS rest FROM sentences)),
        joined AS (SELECT decision_id, decision_outcome, """
    + " || '[SEP]' || ".join(
        f"coalesce(array_to_string(regexp_extract_all(t, '{_SENTENCE_RULES[x]}'), ' '), '')"
        if x in ENTITY_LABELS
        else f"coalesce(\"{x}\", '')"
        for x in ALL_FEATURES
    )
    + rf""" AS text FROM labelled LEFT JOIN masked USING (decision_id))
        SELECT decision_id, decision_outcome AS labels, regexp_replace({_CLEAN.format('text')}, '(\[SEP\]){{2,}}', '[SEP]', 'g') AS text FROM joined""",
)
def _(spark, sf):
    stored = texts(spark, sf, "doc_id", "text", "n_chars").withColumnRenamed("doc_id", "decision_id")
    docs = stored.select("decision_id", paragraphs(F.col("text")).alias("_all"))
    sentences = docs.select(F.col("decision_id").cast("string").alias("decision_id"), F.explode("_all").alias("text"))
    outcomes = case_labels(spark, sf)
    # About as many rows as the length of a case suggests are joined: no text is read to count them.
    per_case = hot_keys(stored.select("decision_id", "n_chars"), ["decision_id"], weight=F.coalesce(F.col("n_chars") / 100, F.lit(0)) + 1)
    main = labelled_sentences(sentences, outcomes, _SENTENCE_RULES, mask=_MASK, hot=per_case).drop("text")
    covers = labelled_covers(cover_feature_rows(spark, sf), outcomes)
    keys = sentence_keys(docs.filter(F.size("_all") > 0).withColumn("text", F.lit("")), outcomes)
    return _long(all_entities_examples(main, covers, hot=per_case, keys=keys))
