"""The file-to-file chain on a handful of files."""

from pyspark.sql import functions as F

from casemill.plans import jobs
from casemill.sources.files import read_delimited


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_sentence_chain(spark, tmp_path):
    p = {n: str(tmp_path / n) for n in ("in.csv", "shards", "tagged", "tail", "gold.csv", "labelled", "flags")}
    (tmp_path / "in.csv").write_text(
        "decision_id;text\n1;near Toronto, John Smith said the claim is rejected\n2;nothing\n3;\n"
        "no_match_filename;the claim is accepted\n"
    )
    step = lambda name, n, removed=0: {"step": name, "rows": n, "removed": removed}
    assert jobs.mask_sentences(spark, p["in.csv"], p["shards"], shards=2) == [step("read", 4), step("complete", 3, 1)]
    assert jobs.tag_sentences(spark, p["shards"], p["tagged"]) == [step("read", 3), step("tagged", 3)]
    tagged = spark.read.parquet(p["tagged"])
    assert tagged.count() == 3
    row = tagged.filter("decision_id = '1'").first()
    assert "John" not in row["text"] and row["GPE"] == ["Toronto"] and len(row["DETERMINATION"]) == 1
    assert jobs.flag_determinations(spark, p["in.csv"], p["flags"]) == [step("read", 4), step("complete", 3, 1), step("flagged", 2, 1)]
    assert spark.read.parquet(p["flags"]).count() == 2
    (tmp_path / "gold.csv").write_text("decision_id;decision\n1;0\n7;1\n")
    jobs.label_determinations(spark, p["flags"], p["gold.csv"], p["labelled"])
    assert [(r["decision_id"], r["decision"]) for r in spark.read.parquet(p["labelled"]).collect()] == [(1, 0)]


def test_from_sentences_to_outcomes_with_a_model(spark, tmp_path):
    p = {n: str(tmp_path / n) for n in ("tail.csv", "flags", "gold.csv", "labelled", "model", "scores", "outcomes")}
    verdict = ["the claim is rejected for want of proof", "the claim is accepted with thanks"]
    (tmp_path / "tail.csv").write_text(
        "decision_id;text\n" + "".join(f"{i};{verdict[i % 3 == 0]}\n{i};other\n" for i in range(90))
    )
    (tmp_path / "gold.csv").write_text("decision_id;decision\n" + "".join(f"{i};{int(i % 3 == 0)}\n" for i in range(60)))
    jobs.flag_determinations(spark, p["tail.csv"], p["flags"])
    jobs.label_determinations(spark, p["flags"], p["gold.csv"], p["labelled"])
    history = jobs.train_sentence_model(spark, p["labelled"], p["model"], epochs=(10,), n_features=256)
    assert history[0]["accuracy"] == 1.0
    jobs.score_sentences(spark, p["model"], p["flags"], p["scores"])
    jobs.aggregate_outcomes(spark, p["scores"], p["outcomes"])
    got = read_delimited(spark, p["outcomes"], "decision_id bigint, decision_outcome int")
    assert rows(got) == sorted(((i, int(i % 3 == 0)) for i in range(90)), key=repr)


def test_outcomes(spark, tmp_path):
    (tmp_path / "scores.csv").write_text(
        "decision_id;extracted_sentences_determination;predicted_class\n1;a;0.1\n1;b;0.2\n2;c;0.9\n3;d;0.5\n"
    )
    jobs.aggregate_outcomes(spark, str(tmp_path / "scores.csv"), str(tmp_path / "out"))
    got = read_delimited(spark, str(tmp_path / "out"), "decision_id bigint, decision_outcome int")
    assert rows(got) == [(1, 0), (2, 1), (3, 2)]


def test_cover_and_example_chain(spark, tmp_path):
    covers, pages = tmp_path / "covers", tmp_path / "pages"
    covers.mkdir(), pages.mkdir()
    for i, mode in ((1, "videoconference"), (2, "huis clos"), (3, "x")):
        (covers / f"2015canlii{i}.txt").write_text(f"Member John Doe\nMay {i}, 2017 {mode} in Toronto")
        (pages / f"2015canlii{i}.html").write_text(f"<table>John Doe\nMay {i}, 2017</table>")
    (covers / "other.txt").write_text("no key")
    (tmp_path / "outcomes.csv").write_text("decision_id;decision_outcome\n1;1\n2;0\n3;2\n")
    features, outcomes = str(tmp_path / "features"), str(tmp_path / "outcomes.csv")
    jobs.extract_covers(spark, str(covers), str(pages), features, unmatched=str(tmp_path / "unmatched"))
    assert spark.read.json(str(tmp_path / "unmatched")).filter("path LIKE '%other.txt'").count() == 1
    table = spark.read.parquet(features)
    assert rows(table.select("decision_id", "judge_name", "date_decision")) == [
        (str(i), "john doe", f"may {i} 2017") for i in (1, 2, 3)
    ]
    jobs.build_cover_examples(spark, features, outcomes, str(tmp_path / "examples"))
    examples = spark.read.parquet(str(tmp_path / "examples"))
    assert rows(examples.select("decision_id", "labels")) == [(1, 1), (2, 0)]
    assert examples.filter("text LIKE '%[SEP]john doe[SEP]May 01 2017'").count() == 1

    (tmp_path / "s.csv").write_text("decision_id,text\n1,section 96 applies\n1,more\n2,section 97\n")
    jobs.tag_sentences(spark, str(tmp_path / "s.csv"), str(tmp_path / "tagged"))
    jobs.build_all_examples(
        spark, str(tmp_path / "tagged"), features, outcomes, str(tmp_path / "all"), test_share=0.0, minority=1
    )
    everything = spark.read.parquet(str(tmp_path / "all"))
    assert rows(everything.groupBy("decision_id", "labels").count()) == [(1, 1, 10), (2, 0, 1)]
    assert everything.filter("text LIKE '%section 96%'").count() == 5


def test_error_reports(spark, tmp_path):
    (tmp_path / "p.csv").write_text(
        "text,labels,prediction\na[SEP]b,0,NEGATIVE\nb c,1,NEGATIVE\nc,1,POSITIVE\nd e,1,\n"
    )
    out = str(tmp_path / "out")
    jobs.report_errors(spark, str(tmp_path / "p.csv"), out)
    confusion = read_delimited(spark, f"{out}/confusion_matrix", "label string, predicted_REJECTED bigint, predicted_GRANTED bigint, predicted_other bigint", sep=",")
    assert rows(confusion) == [("GRANTED", 1, 1, 1), ("REJECTED", 1, 0, 0), ("other", 0, 0, 0)]
    wrong = read_delimited(spark, f"{out}/misclassified", "text string, label string, prediction string", sep=",")
    assert rows(wrong) == [("b c", "GRANTED", "REJECTED"), ("d e", "GRANTED", None)]
    words = spark.read.csv(f"{out}/top_words", header=True)
    assert words.filter(F.col("sample") == "misclassified").count() == 4


def test_legacy_lists(spark, tmp_path):
    (tmp_path / "l.csv").write_text("id;names\n1;\"['a', 'b']\"\n2;[]\n")
    jobs.import_legacy_lists(spark, str(tmp_path / "l.csv"), str(tmp_path / "o"), "id int, names string", ["names"])
    assert rows(spark.read.parquet(str(tmp_path / "o"))) == [(1, ["a", "b"]), (2, [])]


def test_from_covers_to_error_report(spark, tmp_path):
    covers, pages = tmp_path / "covers", tmp_path / "pages"
    covers.mkdir(), pages.mkdir()
    for i in range(1, 81):
        place = "Toronto" if i % 2 else "Montreal"
        (covers / f"2015canlii{i}.txt").write_text(f"Member John Doe\nMay {i % 28 + 1}, 2017 in {place}")
        (pages / f"2015canlii{i}.html").write_text(f"<table>G&eacute;rard Roe\nMay {i % 28 + 1}, 2017</table>")
    lines = "".join(f"{i};{i % 2}\n" for i in range(1, 81))
    (tmp_path / "outcomes.csv").write_text(f"decision_id;decision_outcome\n{lines}x1;1\n7;0;9\n")
    p = {n: str(tmp_path / n) for n in ("features", "examples", "model", "tuned", "predictions", "report", "rejected")}
    jobs.extract_covers(spark, str(covers), str(pages), p["features"])
    jobs.build_cover_examples(spark, p["features"], str(tmp_path / "outcomes.csv"), p["examples"], rejected=p["rejected"])
    assert sorted(r.record for r in spark.read.json(p["rejected"]).collect()) == ["7;0;9", "x1;1"]
    history = jobs.train_case_model(spark, p["examples"], p["model"], copies=2, epochs=(10,), n_features=256)
    assert history[0]["accuracy"] == 1.0
    assert len(jobs.tune_case_model(spark, p["examples"], p["tuned"], trials=1, folds=2)) == 1
    jobs.predict_cases(spark, p["model"], p["examples"], p["predictions"])
    jobs.report_errors(spark, p["predictions"], p["report"])
    matrix = spark.read.csv(p["report"] + "/confusion_matrix", header=True, inferSchema=True).collect()
    tested = spark.read.parquet(p["examples"]).filter("split = 'test'").count()
    assert sum(r[1] + r[2] + r[3] for r in matrix) == tested > 0
