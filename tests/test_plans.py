"""The pipelines from raw text to result."""

import datetime

from casemill.plans import cover, outcomes, training
from casemill.rules.defaults import ALL_FEATURES


def test_covers_keep_the_last_file_of_a_key(spark):
    files = spark.createDataFrame(
        [("a/canlii1.pdf", "Old"), ("b/canlii1.pdf", "New  text"), ("c/other.pdf", "x"), ("d/canlii2.pdf", "False")],
        "path string, text string",
    )
    assert [tuple(r) for r in cover.covers_from_files(files).collect()] == [("1", "new text")]


def test_cover_plan(spark):
    files = spark.createDataFrame(
        [
            (
                "canlii1.pdf",
                "Private  hearing\nin Toronto before the Refugee Protection Division\nMember John Doe\n"
                "May 23, 2017 and september 1, 2015, see october 2007",
            ),
            ("canlii2.pdf", "nothing here"),
        ],
        "path string, text string",
    )
    pages = spark.createDataFrame(
        [("canlii1.html", "<table>John Doe\nMay 23, 2017</table>")], "path string, html string"
    )
    features = cover.cover_features(cover.covers_from_files(files), cover.judges_from_html(pages))
    found = {r["decision_id"]: r for r in features.collect()}
    assert found["1"]["judge_name"] == "john doe"
    assert found["1"]["date_decision"] == "may 23 2017"
    assert found["1"]["public_private_hearing"] == "private hearing"
    assert found["2"]["ner_output"] == [] and found["2"]["judge_name"] == ""
    labels = spark.createDataFrame([(1, 1), (2, None)], "decision_id bigint, decision_outcome int")
    rows = cover.labelled_covers(features, labels).collect()
    assert len(rows) == 1
    row = rows[0]
    assert row["LOC_HEARING"] == "toronto" and row["TRIBUNAL"] == "refugee protection division"
    assert row["INCHAMBER_VIRTUAL_HEARING"] == "in chambers" and row["JUDGE"] == "john doe"
    assert row["DATE_DECISION"] == "May 23, 2017"
    assert "span_time_decision" not in rows[0].asDict()


def test_spans_are_days(spark):
    features = spark.createDataFrame(
        [("1", ["may 23, 2017", "september 1, 2015"])], "decision_id string, extracted_dates array<string>"
    ).selectExpr(
        "*",
        *[f"array('x') AS {c}" for c in ("extracted_gpe", "extracted_org")],
        *[f"'' AS {c}" for c in ("public_private_hearing", "in_chamber_virtual", "judge_name")],
    )
    labels = spark.createDataFrame([(1, 1)], "decision_id bigint, decision_outcome int")
    assert cover.labelled_covers(features, labels).first()["DATE_DECISION"] == "May 23, 2017"
    assert (datetime.date(2017, 5, 23) - datetime.date(2015, 9, 1)).days == 630


def test_sentences_to_outcomes(spark):
    texts = spark.createDataFrame(
        [(1, "\n".join(f"p{i}" for i in range(12)) + "\nthe claim is rejected")], "decision_id int, text string"
    )
    tail = outcomes.tail_sentences(texts)
    assert [r["text"] for r in tail.orderBy("position").collect()][0] == "p3"
    assert tail.count() == 10
    found = outcomes.determination_sentences(texts).collect()
    assert [r["extracted_sentences_determination"] for r in found] == [["the claim is rejected"]]
    scores = spark.createDataFrame(
        [(1, 0.1), (1, 0.2), (1, 0.9), (2, 0.5)], "decision_id int, predicted_class double"
    )
    assert sorted(tuple(r) for r in outcomes.case_outcomes(scores).collect()) == [(1, 0), (2, 2)]


def test_corpus_to_examples(spark):
    sentences = spark.createDataFrame(
        [("1", "near Toronto, John Smith fled"), ("1.0", "section 96 applies"), ("bad", "x"), ("2", None)],
        "decision_id string, text string",
    )
    labels = spark.createDataFrame([(1, 1), (3, 0)], "decision_id bigint, decision_outcome int")
    main = training.labelled_sentences(sentences, labels).drop("text")
    assert main.count() == 2
    covers = spark.createDataFrame(
        [(1, 1, "judge a"), (3, 0, "judge b")], "decision_id bigint, decision_outcome int, JUDGE string"
    ).selectExpr("*", *[f"CAST(NULL AS string) AS {c}" for c in ALL_FEATURES if c not in main.columns + ["JUDGE"]])
    got = sorted(tuple(r) for r in training.all_entities_examples(main, covers).collect())
    assert got == [
        (1, 1, "Toronto[SEP]judge a[SEP]"),
        (1, 1, "[SEP]section 96[SEP]judge a[SEP]"),
        (3, 0, "[SEP]judge b[SEP]"),
    ]


def test_masking_comes_before_tagging(spark):
    sentences = spark.createDataFrame([("1", "John Smith left")], "decision_id string, text string")
    labels = spark.createDataFrame([(1, 1)], "decision_id bigint, decision_outcome int")
    assert training.labelled_sentences(sentences, labels).first()["text"] == "XXXXXXXXXX left"
