"""Files in, files out."""

import pytest
from pyspark.sql import functions as F

from casemill.bindings import QUERIES
from casemill.operators.masking import mask_column
from casemill.schemas import SENTENCES
from casemill.sources import files
from casemill.sources.documents import TextDocuments
from casemill.streaming.tagging import clean_stream, read_rejects, read_sentence_stream, tag_stream, write_checked, write_tagged
from casemill.workdir import fresh_path, materialize, shared_root

HARD = [
    ("1", 'quote " and ; and, comma'),
    ("2", "line\nbreak"),
    ("3", ""),
    ("4", None),
    ("5", "  spaces  "),
    ("6", "é\r\nà"),
    ("7", "back\\slash \\\" x"),
    ("8", "last\n"),
]

# An empty field is a missing value.
READ = sorted([(k, t or None) for k, t in HARD], key=repr)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.fixture
def sentences(spark):
    return spark.createDataFrame(HARD, SENTENCES)


def test_delimited_round_trip(spark, sentences, tmp_path):
    path = str(tmp_path / "csv")
    files.write_delimited(sentences, path)
    assert rows(files.read_delimited(spark, path, SENTENCES)) == READ


def test_latin1(spark, tmp_path):
    (tmp_path / "in.csv").write_bytes("decision_id;text\n1;procédure\n".encode("latin-1"))
    got = files.read_delimited(spark, str(tmp_path / "in.csv"), SENTENCES, encoding="latin-1")
    assert rows(got) == [("1", "procédure")]


def test_arrays_are_written_as_text(spark, tmp_path):
    path = str(tmp_path / "csv")
    df = spark.createDataFrame([(1, ["a", "b"]), (2, [])], "id int, x array<string>")
    files.write_delimited(df, path)
    assert rows(files.read_delimited(spark, path, "id int, x string")) == [(1, "a, b"), (2, None)]


def test_shards_and_merge(spark, sentences, tmp_path):
    path = str(tmp_path / "shards")
    files.write_shards(sentences, path, 3)
    merged = files.merge_shards(spark, f"{path}/*.csv", SENTENCES)
    assert rows(merged) == READ


def test_caller_names_and_stray_headers(spark, tmp_path):
    for i in range(2):
        (tmp_path / f"s{i}.csv").write_text(f"decisionID,Text\n{i},x\n")
    got = files.read_named(spark, str(tmp_path), ["decision_id", "text"], "decision_id", "decisionID")
    assert rows(got) == [("0", "x"), ("1", "x")]


def test_documents(spark, tmp_path):
    (tmp_path / "2002canlii52643.txt").write_text("Line one\nline two\n")
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "other.txt").write_text("x")
    (tmp_path / "2002canlii1.pdf").write_text("not text")
    got = files.read_documents(spark, str(tmp_path), key_pattern=r"canlii(\d{1,6})\.txt")
    assert rows(got.drop("path")) == [("52643", "Line one\nline two"), ("no_match_filename", "x")]


def test_mask_directory(spark, tmp_path):
    (tmp_path / "canlii7.txt").write_text("from aa@bb.com\nto you")
    docs = files.read_documents(spark, str(tmp_path), key_pattern=r"canlii(\d+)\.txt").drop("path")
    out = str(tmp_path / "out")
    files.write_documents(mask_column(docs, "text", "[a-z]+@[a-z.]+"), out, "decision_id", F.col("text"))
    back = files.read_documents(spark, out, key_pattern=r"/(\d+)\.txt")
    assert rows(back.drop("path")) == [("7", "from XXXXXXXXX\nto you")]


def test_keys_of_files_without_arguments(spark, tmp_path):
    for name in ("2015canlii12.txt", "2016canlii13.txt"):
        (tmp_path / name).write_text("x\n")
    assert rows(files.read_documents(spark, str(tmp_path)).drop("path")) == [("12", "x"), ("13", "x")]


ODD = [("a/b", "x"), ("_hidden", "y\n\nz"), (".dot", ""), ("é ü", "ä"), ("100%", "p"), ("same", "1"), ("same", "2"), (None, None)]


def test_one_file_for_each_document(spark, tmp_path):
    df = spark.createDataFrame(ODD + [(f"k{i}", f"text {i}") for i in range(40)], "name string, body string").repartition(5)
    out = tmp_path / "out"
    files.write_documents(df, str(out), "name", F.col("body"))
    found = [p for p in out.rglob("*.txt")]
    assert len(found) == 48 and {p.parent.name.split("-")[0] for p in found} <= {"part", "again"}
    assert sorted(p.name for p in out.iterdir() if not p.name.startswith("part-")) == ["_SUCCESS"]
    back = files.read_documents(spark, str(out), key_pattern=r"/([^/]+)\.txt$")
    assert back.count() == 48 and rows(back.filter("decision_id like 'k1'").select("text")) == [("text 1",)]
    assert sorted(r.text for r in back.collect()) == sorted([(t or "") for _, t in ODD] + [f"text {i}" for i in range(40)])
    with pytest.raises(Exception, match="already holds"):
        files.write_documents(df, str(out), "name", F.col("body"))
    files.write_documents(df.limit(1), str(out), "name", F.col("body"), suffix=".md", overwrite=True)
    assert [p.suffix for p in out.rglob("part-*/*")] == [".md"]


def test_repeated_and_failed_tasks_leave_no_files(spark, tmp_path):
    """Tasks that run twice, as after a lost executor, and a job that fails for good."""
    df = spark.createDataFrame([(f"k{i}", f"text {i}") for i in range(30)], "key string, text string").repartition(3)
    writer = TextDocuments({"path": str(tmp_path / "out")}).writer(None, False)
    batches = df.toArrow().to_batches()
    out = tmp_path / "out"
    attempt = lambda: spark.sparkContext.parallelize([0], 1).map(lambda _: writer.write(iter(batches))).collect()
    lost, counted = attempt(), attempt()
    assert lost[0].folder != counted[0].folder and len(list(out.rglob("*.txt"))) == 60 and not list(out.glob("part-*"))
    writer.commit(counted)
    assert sorted(p.name for p in out.iterdir()) == ["_SUCCESS", "part-00000"] and len(list(out.rglob("*.txt"))) == 30

    bad = df.withColumn("text", F.when(F.col("key") == "k7", F.raise_error("bad")).otherwise(F.col("text")))
    with pytest.raises(Exception, match="bad"):
        files.write_documents(bad, str(tmp_path / "failed"), "key", F.col("text"))
    failed = tmp_path / "failed"  # tasks that were still writing may have left attempts, which readers skip
    assert not list(failed.glob("part-*")) and not (failed / "_SUCCESS").exists()
    failed.mkdir(exist_ok=True)
    assert files.read_documents(spark, str(failed)).count() == 0
    files.write_documents(df, str(failed), "key", F.col("text"))
    assert files.read_documents(spark, str(failed), key_pattern=r"/(k\d+)\.txt").count() == 30


def test_pruned_read(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(5).selectExpr("id", "id * 2 AS twice", "'x' AS wide").write.parquet(path)
    df = files.read_columns(spark, path, ["twice"])
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<twice:bigint>" in plan


def test_spread_only_what_is_in_few_pieces(spark):
    assert files.spread(spark.range(10).coalesce(1)).rdd.getNumPartitions() == 4
    many = spark.range(10).repartition(9)
    assert files.spread(many) is many


def test_spread_does_not_count_on_splits_of_a_row_group(spark, tmp_path):
    spark.range(200_000).coalesce(1).write.parquet(str(tmp_path / "one"))
    before = {c: spark.conf.get(c) for c in ("spark.sql.files.openCostInBytes", "spark.sql.files.maxPartitionBytes")}
    try:
        spark.conf.set("spark.sql.files.openCostInBytes", "1k")
        one = spark.read.parquet(str(tmp_path / "one"))
        sizes = [n for n in files.spread(one).rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect() if n]
        assert one.rdd.getNumPartitions() >= 4 and len(sizes) >= 4 and max(sizes) < 100_000
        assert sum(sizes) == 200_000
        spark.range(0).write.parquet(str(tmp_path / "none"))
        assert files.spread(spark.read.parquet(str(tmp_path / "none"))).count() == 0
    finally:
        for c, value in before.items():
            spark.conf.set(c, value)


def test_shared_folder(spark):
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        assert shared_root(spark) == named.rstrip("/")
    assert fresh_path(spark, "x") != fresh_path(spark, "x")


def test_materialize(spark):
    df = spark.range(3)
    assert rows(materialize(df, "test")) == rows(df)


def test_stream_goes_on_where_it_ended(spark, tmp_path):
    landing, sink, marks = (tmp_path / n for n in ("in", "out", "marks"))
    landing.mkdir()

    def run():
        stream = read_sentence_stream(spark, str(landing))
        query = write_tagged(tag_stream(stream, rules={"UP": "[A-Z]+"}), str(sink), str(marks))
        query.awaitTermination()
        return rows(spark.read.parquet(str(sink)))

    (landing / "a.csv").write_text('decision_id;text\n1;"AB ; c"\n2;\n')
    assert run() == [("1", "AB ; c", ["AB"])]
    (landing / "b.csv").write_text("decision_id;text\n3;D e F\n")
    assert run() == [("1", "AB ; c", ["AB"]), ("3", "D e F", ["D", "F"])]


def test_stream_keeps_to_the_batch_rules(spark, tmp_path):
    schema = "k bigint, text string"
    landing, sink, bad, marks = (tmp_path / n for n in ("in", "good", "bad", "marks"))
    landing.mkdir()

    def run():
        stream = read_sentence_stream(spark, str(landing), schema, checked=True)
        work = lambda rows: tag_stream(clean_stream(rows, mask="[a-z]+@[a-z]+", normalize=True), rules={"X": "x+"})
        write_checked(stream, str(sink), str(bad), str(marks), work).awaitTermination()
        good = spark.read.parquet(str(sink)).select("k", "text", "X")
        return rows(good), rows(read_rejects(spark, str(bad)).select("record"))

    (landing / "a.csv").write_text('k;text\n1;"Ab@c  me@home\nB"\nx2;bye;extra\n3\n4;\n')
    want = [(1, "axxx xxxxxxx b", ["xxx", "xxxxxxx"])], [("3",), ("x2;bye;extra",)]
    assert run() == want
    (landing / "b.csv").write_text("k;text\ny;z\n5;five\n")
    want = [*want[0], (5, "five", [])], sorted([*want[1], ("y;z",)])
    assert run() == want
    # The last batch was written, but its commit was lost: it runs again.
    commits = sorted((marks / "commits").glob("[0-9]*"), key=lambda p: int(p.name))
    commits[-1].unlink()
    for crc in (marks / "commits").glob(f".{commits[-1].name}.crc"):
        crc.unlink()
    assert run() == want
    assert {r.file.rsplit("/", 1)[1] for r in read_rejects(spark, str(bad)).collect()} == {"a.csv", "b.csv"}


@pytest.mark.parametrize("content", ["text;k\na;1\n", "k;text\nx2;bye;extra\n"])
def test_stream_stops_at_bad_files(spark, tmp_path, content):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.csv").write_text(content)
    stream = read_sentence_stream(spark, str(tmp_path / "in"), "k bigint, text string")
    with pytest.raises(Exception, match="FAILED_READ_FILE|header|MALFORMED"):
        write_tagged(tag_stream(stream, rules={"X": "x"}), str(tmp_path / "out"), str(tmp_path / "marks")).awaitTermination()


@pytest.mark.parametrize("name", ["stream_tagging", "stream_rejects"])
def test_larger_tables_land_as_more_files(spark, tmp_path, monkeypatch, name):
    """Before: four files of any size, each read by one task."""
    docs = spark.range(12_000).select(F.col("id").alias("doc_id"), F.concat(F.lit('a "station"\n'), "id").alias("text"))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    monkeypatch.setattr("casemill.bindings.files.fresh_path", lambda spark, folder: f"{tmp_path}/{folder}")
    got = {int(r[0]): r.nouns for r in QUERIES[name](spark, str(tmp_path)).collect()}
    bad = name == "stream_rejects"
    assert got == {n: None if bad and n % 5 == 0 else "station" for n in range(12_000)}
    sizes = [sum(line.endswith('station""') for line in f.read_text().splitlines()) for f in (tmp_path / "landing").glob("*.csv")]
    assert sum(sizes) == 12_000 and max(sizes) <= 2_500


def test_bad_rows_are_errors_or_rejects(spark, tmp_path):
    (tmp_path / "a.csv").write_text("k;v\n1;0.5\nx;0.7\n2\n3;0.1;9\n;0.2\n")
    schema = "k bigint, v double"
    with pytest.raises(Exception, match="FAILFAST|MALFORMED"):
        files.read_delimited(spark, str(tmp_path / "a.csv"), schema).collect()
    good, bad = files.read_checked(spark, str(tmp_path / "a.csv"), schema)
    assert sorted(good.collect(), key=str) == [(1, 0.5), (None, 0.2)]
    assert sorted(r.record for r in bad.collect()) == ["2", "3;0.1;9", "x;0.7"]
    assert good.count() == 2 and bad.count() == 3


def test_headers_are_checked(spark, tmp_path):
    (tmp_path / "a.csv").write_text("v;k\n0.5;1\n")
    with pytest.raises(Exception, match="header"):
        files.read_delimited(spark, str(tmp_path / "a.csv"), "k bigint, v double").collect()


def test_named_keeps_missing_keys(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,x\n1,a\n,b\nid,x\n")
    got = files.read_named(spark, str(tmp_path / "a.csv"), ["k", "v"], "k", "id")
    assert sorted(map(tuple, got.collect()), key=str) == [("1", "a"), (None, "b")]
