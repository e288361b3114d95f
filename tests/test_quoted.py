"""Records across byte ranges: the same rows as a reader that takes each file whole."""

import csv
import io
import random

import pytest
from pyspark.sql import functions as F

from casemill.sources import files, quoted

BITS = ["a", "bc", " ", "\n", "\n\n", '"', '""', ";", ",", "é", "中🙂", "\\", "x" * 30, '"\n"', "\r\n", "end of a line\n"]


def table(seed, n):
    rng = random.Random(seed)
    say = lambda: "".join(rng.choice(BITS) for _ in range(rng.choice([0, 1, 2, 5, 40])))
    return [(i, say() or None, say() or None) for i in range(n)]


def store(path, rows, header=True, encoding="utf-8"):
    out = io.StringIO()
    write = csv.writer(out, delimiter=";", lineterminator="\n", quoting=csv.QUOTE_MINIMAL)
    if header:
        write.writerow(["id", "a", "b"])
    write.writerows([["" if v is None else v for v in r] for r in rows])
    path.write_bytes(out.getvalue().encode(encoding))


@pytest.fixture
def narrow(spark):
    """Ranges of 50 bytes."""
    names = {"spark.sql.files.maxPartitionBytes": "50", "spark.sql.files.openCostInBytes": "10", "spark.sql.files.minPartitionNum": "1"}
    for k, v in names.items():
        spark.conf.set(k, v)
    yield spark
    for k in names:
        spark.conf.unset(k)


SCHEMA = "id long, a string, b string"


def test_records_across_ranges(narrow, tmp_path):
    want = []
    for i in range(3):
        part = [(1000 * i + k, a, b) for k, a, b in table(i, 25)]
        store(tmp_path / f"p{i}.csv", part)
        want += part
    counts = quoted.count_quotes(narrow, str(tmp_path))
    states = quoted.open_ranges(counts).collect()
    assert counts.count() > 60 and sum(r.begins for r in states) > 20  # many ranges begin within quotes
    got = files.read_delimited(narrow, str(tmp_path), SCHEMA, file="file")
    assert sorted(map(tuple, got.drop("file").collect())) == sorted(want)
    assert {(r.id // 1000, r.file.rsplit("/", 1)[1]) for r in got.collect()} == {(i, f"p{i}.csv") for i in range(3)}
    assert got.rdd.getNumPartitions() > 20


def test_one_field_over_many_ranges(narrow, tmp_path):
    rows = [(1, "x\n" * 400, None), (2, "y", '"' * 7 + "\n"), (3, None, "z")]
    store(tmp_path / "a.csv", rows, header=False)
    assert sorted(map(tuple, files.read_delimited(narrow, str(tmp_path), SCHEMA, header=False).collect())) == rows


def test_same_as_whole_files(narrow, tmp_path):
    """Bad rows, Latin-1, a header over several ranges, and a quote that is never closed."""
    long = "n" * 70
    (tmp_path / "a.csv").write_bytes(f'{long};"b\nb"\n1;"é\n\n2"\nx;y\n3\n\n4;"u";v\n5;ok\n6;"open\nend'.encode("latin-1"))
    declared = f"`{long}` long, `b\nb` string"
    good, bad = files.read_checked(narrow, str(tmp_path), declared, encoding="latin-1")
    whole = narrow.read.schema(f"{declared}, _bad string").csv(
        str(tmp_path), sep=";", header=True, multiLine=True, encoding="ISO-8859-1", escape='"', columnNameOfCorruptRecord="_bad", lineSep="\n", nullValue="", emptyValue=""
    ).collect()
    assert sorted(map(tuple, good.collect())) == sorted((r[0], r[1]) for r in whole if r[2] is None)
    assert sorted(r.record for r in bad.collect()) == sorted(r[2] for r in whole if r[2] is not None)


def test_header_and_errors(narrow, tmp_path):
    (tmp_path / "a.csv").write_text('v;k\n0.5;"1\n2"\n')
    with pytest.raises(Exception, match="header"):
        files.read_delimited(narrow, str(tmp_path), "k string, v double").collect()
    (tmp_path / "a.csv").write_text('k;v\n"1\n2";x\n')
    with pytest.raises(Exception, match="FAILFAST|MALFORMED"):
        files.read_delimited(narrow, str(tmp_path), "k string, v double").collect()


def test_plain_files_stay_with_sparks_reader(narrow, tmp_path):
    store(tmp_path / "a.csv", [(i, "plain", 'quo"ted; text') for i in range(20)])
    got = files.read_delimited(narrow, str(tmp_path), SCHEMA)
    assert "MapInArrow" not in got._jdf.queryExecution().executedPlan().toString() and got.count() == 20
    assert got.rdd.getNumPartitions() > 5
    (tmp_path / "none.csv").write_text("")
    assert files.read_delimited(narrow, str(tmp_path / "none.csv"), SCHEMA).collect() == []


def test_utf16_is_read_whole(spark, tmp_path):
    store(tmp_path / "a.csv", [(1, "a\nb", "ü")], encoding="utf-16")
    assert [tuple(r) for r in files.read_delimited(spark, str(tmp_path), SCHEMA, encoding="UTF-16").collect()] == [(1, "a\nb", "ü")]
