"""Golden rows of the text, key, date and block expressions."""

import datetime

import pytest
from pyspark.sql import functions as F

from casemill.functions import arrays, dates, html, keys, text
from casemill.rules import defaults


def one(spark, value, expression, dtype="string"):
    return spark.createDataFrame([(value,)], f"x {dtype}").select(expression(F.col("x")).alias("y")).first()["y"]


CASES = [
    (text.normalize_text, "A  B\r\n\tC", "a b c"),
    (text.normalize_text, "É  à", "é à"),
    (text.strip_punctuation, "é!a", "é a"),
    (text.strip_punctuation, "a,[SEP] b_c", "a [SEP] b_c"),
    (text.collapse_separators, "a[SEP][SEP][SEP]b", "a[SEP]b"),
    (text.collapse_separators, "a[SEP]b", "a[SEP]b"),
    (text.word_count, "", 0),
    (text.word_count, "a", 1),
    (text.word_count, " a  b ", 2),
    (text.count_occurrences, "[SEP]a[SEP]", 2),
    (text.count_occurrences, "", 0),
    (text.count_occurrences, "a[SEP][SEP]b", 2),
    (text.apply_fixups, "que bec city", "quebec city"),
    (text.null_if_marker, "[]", None),
    (text.null_if_marker, "[None]", None),
    (text.null_if_marker, "''", None),
    (text.null_if_marker, "", None),
    (text.null_if_marker, "x", "x"),
    (text.parse_list_repr, "['a', 'b']", ["a", "b"]),
    (text.parse_list_repr, "{'may 23, 2017', 'x'}", ["may 23, 2017", "x"]),
    (text.parse_list_repr, "['a' 'b']", ["a", "b"]),
    (text.parse_list_repr, "[\"o'brien\", 'b']", ["o'brien", "b"]),
    (text.parse_list_repr, "['']", [""]),
    (text.parse_list_repr, "[]", []),
    (text.parse_list_repr, "set()", []),
    (text.parse_list_repr, "[None]", []),
    (text.clean_lines, "  A b\n\n \n c", ["a b", "c"]),
    (text.paragraphs, "a\n \n\nb", ["a", "b"]),
    (lambda c: text.tail_paragraphs(c, 2), "a\nb\n\nc", ["b", "c"]),
    (lambda c: text.tail_paragraphs(c, 5), "a\nb", ["a", "b"]),
    (lambda c: text.tail_paragraphs(c, 5), "", []),
    (keys.key_from_path, "x/2002canlii52643.pdf", "52643"),
    (keys.key_from_path, "x/2002canlii52643.html", "52643"),
    (keys.key_from_path, "x/2002canlii1234567.pdf", "no_match_filename"),
    (keys.key_from_path, "x/other.pdf", "no_match_filename"),
    (keys.lenient_key, "12", 12),
    (keys.lenient_key, "12.0", 12),
    (keys.lenient_key, "abc", 0),
    (keys.lenient_key, None, 0),
    (keys.nullable_key, "12.0", 12),
    (keys.nullable_key, "abc", None),
    (keys.nullable_key, None, None),
    (dates.parse_date, "May 3, 2017", datetime.date(2017, 5, 3)),
    (dates.parse_date, "june 05, 2011", datetime.date(2011, 6, 5)),
    (dates.parse_date, "february 30, 2017", None),
    (dates.parse_date, "2016", None),
    (dates.parse_date, "soon", None),
    (dates.without_day_comma, "may 23, 2017", "may 23 2017"),
]


@pytest.mark.parametrize("expression,value,expected", CASES)
def test_expression(spark, expression, value, expected):
    assert one(spark, value, expression) == expected


HEARING = [
    ("private hearing", "private hearing"),
    ("a public proceeding", "public proceeding"),
    ("huis clos", "huis clos"),
    ("none", None),
]
MODE = [
    ("virtual", "virtual"),
    ("by video-conference", "video-conference"),
    ("in chambers", "in chambers"),
    ("within personal", None),
    ("telephone", "telephone"),
]


@pytest.mark.parametrize("value,expected", HEARING)
def test_hearing_type(spark, value, expected):
    assert one(spark, value, lambda c: text.first_match(c, defaults.HEARING_TYPE_PATTERN)) == expected


@pytest.mark.parametrize("value,expected", MODE)
def test_hearing_mode(spark, value, expected):
    assert one(spark, value, lambda c: text.first_match(c, defaults.HEARING_MODE_PATTERN)) == expected


def test_strict_key_refuses_text(spark):
    assert one(spark, "12", keys.strict_key) == 12
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        one(spark, "abc", keys.strict_key)


def test_join_features_keeps_positions(spark):
    row = spark.createDataFrame([("a", None, "b")], "x string, y string, z string")
    joined = row.select(text.join_features([F.col(c) for c in "xyz"]).alias("t")).first()["t"]
    assert joined == "a[SEP][SEP]b"


DATES = [
    (["may 23, 2017", "september 1, 2015", "october 2007", "2016"], datetime.date(2017, 5, 23), 630),
    (["2016"], None, None),
    (["soon", "june 05, 2011"], datetime.date(2011, 6, 5), 0),
    (["february 30, 2017"], None, None),
    ([], None, None),
]


@pytest.mark.parametrize("items,day,span", DATES)
def test_decision_date_and_span(spark, items, day, span):
    df = spark.createDataFrame([(items,)], "x array<string>")
    df = df.select(dates.parsed_dates(dates.clean_date_items(F.col("x"))).alias("d"))
    row = df.select(dates.latest_date(F.col("d")).alias("day"), dates.date_span(F.col("d")).alias("span")).first()
    assert (row["day"], row["span"]) == (day, span)


def test_date_cleaning_steps_are_independent(spark):
    cleaned = one(spark, ["2017 x", "may 1, 2017", "may 1, 2017"], dates.clean_date_items, "array<string>")
    assert cleaned == ["may 1, 2017"]


@pytest.mark.parametrize("scores,best", [([0.1, 0.9], 1), ([0.5, 0.5], 0), ([0.1, 0.2, 0.7], 2)])
def test_argmax(spark, scores, best):
    assert one(spark, scores, arrays.argmax, "array<double>") == best


def test_sorted_distinct(spark):
    assert one(spark, ["b", "a", "b"], arrays.sorted_distinct, "array<string>") == ["a", "b"]


BLOCKS = [
    ("<table>x</table><table><tr><td>May 3, 2017\n\nJ. Doe</td></tr></table>", ["may 3, 2017", "j. doe"]),
    ("<table>first</table><p>no</p>", ["first"]),
    ("<TABLE class='a'>A &amp; B\n&nbsp;\n  c</TABLE>", ["a & b", "c"]),
    ("<table>outer<table>inner</table></table>", ["inner"]),
    ("<table>kept</table><script>var t='<table>no</table>'</script><!-- <table>no</table> -->", ["kept"]),
    ("<table>open end", ["open end"]),
    ("<table>x\nappelant y</table>", ["no table found"]),
    ("<table>born 1985</table>", ["no table found"]),
    ("<table>born 1995</table>", ["born 1995"]),
    ("<p>none</p>", []),
    (None, []),
]


@pytest.mark.parametrize("page,items", BLOCKS)
def test_signature_items(spark, page, items):
    assert one(spark, page, html.signature_items) == items


def test_signature_items_by_pattern(spark):
    page = "<table>signed may 3, 2017 by x</table>"
    assert one(spark, page, lambda c: html.signature_items(c, item_pattern=r"[a-z]+ \d+, \d{4}")) == ["may 3, 2017"]


def test_long_inputs(spark):
    page = "<script>" + "x" * 500_000 + "</script><table>" + "a < b " * 200_000 + "</table><table>last\n" + "y" * 500_000
    assert len(one(spark, page, html.signature_items)) == 2
    assert one(spark, "a" + "[SEP]" * 100_000 + "b", text.collapse_separators) == "a[SEP]b"
    assert one(spark, "w " * 300_000, text.word_count) == 300_000
    assert len(one(spark, "a  b!" * 300_000, text.strip_punctuation)) == 4 * 300_000
    assert len(one(spark, "['x']" * 100_000, text.parse_list_repr)) == 100_000
