"""Golden rows and invariants of the table operators."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from casemill.functions import html
from casemill.functions.similarity import token_set_score
from casemill.operators import cleaning, features, joins, masking, metrics, outcomes, profile
from casemill.operators import reconcile, sampling, tagging
from casemill.workdir import fresh_path


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


# Scores and votes ------------------------------------------------------------------------------


@pytest.mark.parametrize(
    "score,expected", [(0.39, 0), (0.4, 2), (0.6, 2), (0.61, 1), (float("nan"), 2), (None, 2)]
)
def test_bin_score(spark, score, expected):
    df = spark.createDataFrame([(score,)], "x double")
    assert df.select(outcomes.bin_score(F.col("x"))).first()[0] == expected


def test_votes(spark):
    votes = {1: [1], 2: [0, 0], 3: [0, 1], 4: [0, 0, 1], 5: [0, 1, 2], 6: [0, 0, 1, 1], 7: [2, 2, 1]}
    data = [(k, v) for k, vs in votes.items() for v in vs] + [(None, 1)]
    got = outcomes.case_votes(spark.createDataFrame(data, "case int, vote int"), "case", "vote")
    assert rows(got) == [(1, 1), (2, 0), (3, 2), (4, 0), (5, 2), (6, 2), (7, 2)]


def test_votes_follow_the_mode_rule(spark):
    rng = random.Random(3)
    votes = {k: [rng.randint(0, 2) for _ in range(rng.randint(1, 7))] for k in range(200)}
    expected = {}
    for k, vs in votes.items():
        top = Counter(vs).most_common(2)
        expected[k] = 2 if len(top) > 1 and top[0][1] == top[1][1] else top[0][0]
    data = [(k, v) for k, vs in votes.items() for v in vs]
    got = outcomes.case_votes(spark.createDataFrame(data, "case int, vote int"), "case", "vote")
    assert dict(rows(got)) == expected


def test_unanimous(spark):
    df = spark.createDataFrame([(1, 0), (1, 0), (2, 0), (2, 1)], "case int, vote int")
    assert rows(outcomes.unanimous(df, "case", "vote")) == [(1, True), (2, False)]


@pytest.mark.parametrize("hot_rows", [1, 3, 1000])
def test_duplicate_rows(spark, hot_rows):
    data = [("a", i) for i in range(9)] + [("b", 1), ("b", 1), ("c", 5), (None, 6), (None, 7)]
    df = spark.createDataFrame(data, "k string, v int").repartition(3)
    twice = outcomes.duplicate_rows(df, "k", rows=hot_rows)
    once = outcomes.duplicate_rows(df, "k", keep="unique", rows=hot_rows)
    assert rows(twice) == sorted([d for d in data if d[0] != "c"], key=repr)
    assert rows(once) == [("c", 5)]
    assert rows(outcomes.duplicate_totals(df, "k")) == [(13, 1)]


def test_class_distribution_and_balance(spark):
    df = spark.createDataFrame([(0,), (0,), (1,)], "y int")
    assert rows(outcomes.class_distribution(df, "y")) == [(0, 2, 66.67), (1, 1, 33.33)]
    assert rows(outcomes.class_balance(df, "y")) == [(2, 1, 3, 33.33)]
    assert rows(outcomes.class_balance(df.filter("y > 1"), "y")) == [(0, 0, 0, None)]


def test_density_is_a_density(spark):
    rng = random.Random(1)
    scores = [round(rng.betavariate(0.5, 0.5), 3) for _ in range(500)] + [float("nan"), None]
    got = outcomes.score_density(spark.createDataFrame([(s,) for s in scores], "s double"), "s")
    points = sorted((r["score"], r["density"]) for r in got.collect())
    assert len(points) == 200
    step = points[1][0] - points[0][0]
    assert abs(sum(d for _, d in points) * step - 1) < 0.01


# Joins -----------------------------------------------------------------------------------------


@pytest.fixture(params=[2, 1_000_000], ids=["salted", "plain"])
def hot_rows(request):
    return request.param


def _skewed(spark):
    many = [("hot", i) for i in range(300)] + [(k, 1) for k in "abcd"] + [(None, 9)] * 3
    one = [("hot", "H"), ("a", "A"), ("z", "Z"), (None, "N")]
    left = spark.createDataFrame(many, "k string, v int").repartition(5)
    return many, one, left, spark.createDataFrame(one, "k string, w string")


def _expected(many, one, how):
    lookup = {k: w for k, w in one if k is not None}
    out = [(k, v, lookup[k]) for k, v in many if k in lookup]
    if how != "inner":
        out += [(k, v, None) for k, v in many if k not in lookup]
    if how == "full":
        seen = {k for k, _ in many if k is not None}
        out += [(k, None, w) for k, w in one if k not in seen]
    return sorted(out, key=repr)


@pytest.mark.parametrize("how", ["inner", "left", "full"])
@pytest.mark.parametrize("threshold", ["-1", "10MB"], ids=["shuffled", "broadcast"])
def test_salted_join(spark, how, threshold, hot_rows):
    many, one, left, right = _skewed(spark)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    try:
        got = joins.salted_join(left, right, ["k"], how, rows=hot_rows)
        assert rows(got) == _expected(many, one, how)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10MB")


@pytest.mark.parametrize("how", ["inner", "left", "full"])
def test_any_keys_may_be_split(spark, how):
    """Keys that are not hot, that one side or both lack, and keys of fewer columns."""
    many, one, left, right = _skewed(spark)
    hot = spark.createDataFrame([("hot", 7), ("a", 3), ("z", 4), ("nowhere", 2), (None, 5)], "k string, _salts int")
    keys = left.select("k")
    assert rows(joins.salted_join(left, right, ["k"], how, hot=hot, keys=keys)) == _expected(many, one, how)
    left, right = (df.withColumn("year", F.lit(1)) for df in (left, right))
    got = joins.salted_join(left, right, ["k", "year"], how, hot=hot, keys=left.select("k", "year"))
    assert rows(got.drop("year")) == _expected(many, one, how)


def test_full_join_with_keys_derives_rows_once(spark):
    many, _, left, right = _skewed(spark)
    left.write.mode("overwrite").parquet(path := fresh_path(spark, "left"))
    stored = spark.read.parquet(path)
    derived = stored.withColumn("w2", F.regexp_replace(F.col("k"), "h", "x"))
    plan = joins.salted_join(derived, right, ["k"], "full", hot=joins.hot_keys(stored, ["k"]), keys=stored.select("k"))
    assert plan._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace(k") == 1


def test_hot_keys_are_split(spark):
    _, _, left, right = _skewed(spark)
    hot = joins.hot_keys(left, ["k"], rows=50)
    assert rows(hot) == [("hot", 6)]
    assert rows(joins.salted_join(left, right, ["k"], hot=hot)) == _expected(*_skewed(spark)[:2], "inner")


def test_copies_of_one_row_are_split(spark):
    copies = spark.range(1000).selectExpr("'k' AS k", "1 AS v").repartition(8)
    hot = joins.hot_keys(copies, ["k"], rows=100)
    salts = F.coalesce("_salts", F.lit(1))
    salted = copies.join(hot, "k", "left").withColumn("s", F.pmod(F.spark_partition_id(), salts))
    assert salted.select("s").distinct().count() == 8


def test_natural_outer_join(spark, hot_rows):
    main = spark.createDataFrame([(1, 0, "m"), (2, 1, "m")], "id int, y int, main string")
    cover = spark.createDataFrame([(1, 0, "c"), (3, 0, "c")], "id int, y int, cover string")
    got = joins.natural_outer_join(main, cover, rows=hot_rows)
    assert got.columns == ["id", "y", "main", "cover"]
    assert rows(got) == [(1, 0, "m", "c"), (2, 1, "m", None), (3, 0, None, "c")]


def test_label_join_drops_what_has_no_label(spark, hot_rows):
    left = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (None, "d")], "id int, t string")
    right = spark.createDataFrame([(1, 0), (2, None), (3, 1)], "id int, y int")
    assert rows(joins.label_join(left, right, "id", "y", rows=hot_rows)) == [(1, "a", 0), (1, "b", 0)]


def test_left_join_fill(spark):
    left = spark.createDataFrame([(1,), (2,)], "id int")
    right = spark.createDataFrame([(1, 5)], "id int, n int")
    assert rows(joins.left_join_fill(left, right, "id", {"n": 0})) == [(1, 5), (2, 0)]


def test_dimension_counts(spark):
    members = spark.createDataFrame(
        [("China", "CN"), ("Antarctica", "AQ"), ("Nowhere", None), ("India", "IN")], "c string, code string"
    )
    counts = spark.createDataFrame([("China", 3), ("Atlantis", 1)], "c string, n bigint")
    got = joins.dimension_counts(members, counts, "c", "n", "code", ["Antarctica"])
    assert rows(got) == [("China", "CN", 3), ("India", "IN", 0)]


def test_lookup_join_beyond_the_broadcast_limit(spark, monkeypatch):
    df = spark.createDataFrame([("a",), ("b",)], "k string")
    columns, types = {"k": ["a", "c"], "n": [1, 2]}, {"k": "string", "n": "int"}
    small = rows(joins.lookup_join(df, columns, types, "k", "left"))
    monkeypatch.setattr(joins, "BROADCAST_ROWS", 1)
    assert rows(joins.lookup_join(df, columns, types, "k", "left")) == small == [("a", 1), ("b", None)]


def test_literal_table_refuses_unequal_lists(spark):
    with pytest.raises(Exception):
        joins.literal_table(spark, {"a": [1, 2], "b": [1]}, {"a": "int", "b": "int"})


# Rows ------------------------------------------------------------------------------------------


def test_null_handling(spark):
    df = spark.createDataFrame([("a", 1.0), (None, 2.0), ("b", None), ("c", float("nan"))], "s string, x double")
    assert rows(cleaning.drop_incomplete(df)) == [("a", 1.0)]
    assert cleaning.drop_incomplete(df, ["s"]).count() == 3
    assert rows(cleaning.drop_values(df.select("s"), "s", ["a"])) == [("b",), ("c",), (None,)]


def test_map_values(spark):
    df = spark.createDataFrame([(0,), (1,), (7,)], "x int")
    got = df.select(cleaning.map_values(F.col("x"), {0: "REJECTED", 1: "GRANTED"}))
    assert rows(got) == [("7",), ("GRANTED",), ("REJECTED",)]
    assert rows(df.select(cleaning.map_values(F.col("x"), {0: 5}))) == [(1,), (5,), (7,)]


def test_split_exact(spark):
    for n in (0, 1, 4, 11, 1000):
        got = sampling.split_exact(spark.range(n).repartition(3), ["id"]).collect()
        assert len({r["id"] for r in got}) == n
        assert sum(r["split"] == "test" for r in got) == int(0.2 * n)


def test_split_exact_takes_the_first_of_the_hash_order(spark):
    df = spark.range(500)
    shuffled = [r["id"] for r in sampling.shuffle_rows(df, ["id"], "7").collect()]
    test = {r["id"] for r in sampling.split_exact(df, ["id"], 0.3, "7").filter("split = 'test'").collect()}
    assert test == set(shuffled[:150])


def test_split_by_hash_keeps_cases_together(spark):
    df = spark.range(2000).select((F.col("id") % 400).alias("case"), "id")
    got = sampling.split_by_hash(df, ["case"])
    assert got.groupBy("case").agg(F.count_distinct("split").alias("n")).filter("n > 1").count() == 0
    assert 0.1 < got.filter("split = 'test'").count() / 2000 < 0.3


def test_oversample(spark):
    df = spark.createDataFrame([(0,), (1,)], "y int")
    assert rows(sampling.oversample(df, "y").groupBy("y").count()) == [(0, 1), (1, 5)]


def test_last_write_wins_and_last_rows(spark):
    df = spark.createDataFrame([("a", "p1", 1), ("a", "p2", 2), ("b", "p0", 3)], "k string, path string, v int")
    assert rows(sampling.last_write_wins(df, "k", "path")) == [("a", "p2", 2), ("b", "p0", 3)]
    assert rows(sampling.last_rows(df, "k", "path", 1)) == [("a", "p2", 2), ("b", "p0", 3)]


def test_last_rows_limits_each_case_before_the_shuffle(spark):
    df = spark.range(100).select((F.col("id") % 3).alias("k"), "id")
    plan = sampling.last_rows(df, "k", "id", 2)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


# Tagging and masking ---------------------------------------------------------------------------

MASKS = [
    ("aa@bb.com says", "XXXXXXXXX says"),
    ("x abcdefghijklmnopqrstuvwxyz@q.com", "x abcdefghijkl" + "X" * 20),
    ("a@b.c a@b.d", "XXXXX XXXXX"),
    ("none", "none"),
    ("", ""),
    (None, None),
]


@pytest.mark.parametrize("value,expected", MASKS)
def test_mask(spark, value, expected):
    df = spark.createDataFrame([(1, value)], "id int, t string")
    assert masking.mask_column(df, "t", "[a-z]+@[a-z.]+").first()["t"] == expected


def test_tag_entities(spark):
    df = spark.createDataFrame([("ab cd",), (None,)], "t string")
    got = tagging.tag_entities(df, "t", {"A": "a.", "D": ".d"})
    assert rows(got) == sorted([("ab cd", ["ab"], ["cd"]), (None, [], [])], key=repr)


def test_stem_rules_share_the_runs_of_their_class(spark):
    shapes = ["[a-c]*{}[a-c]*", "[a-c]+{}[a-c]*", "[a-c]*{}[a-c]+", "[a-c]+{}[a-c]+", "[a-c]*{}", "[a-c]+{}"]
    patterns = [shape.format(stem) for shape in shapes for stem in ("a", "ab", "aa", "cab")]
    patterns += ["[a-c]+d", "b+", "[a-c][a-c]*", "[a-c]*ab?", "[A-C]+AB", "[A-C]*B[A-C]*", "[A-C_]+_B"]
    rules = {f"R{i}": p for i, p in enumerate([*patterns, patterns[0]])}
    rng = random.Random(5)
    texts = ["".join(rng.choices("aaabbccAB_d \n\u00fc\U0001f600", k=rng.randrange(60))) for _ in range(300)] + ["", "ab" * 3000, None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "_runs0 int, t string")
    got = tagging.tag_entities(df, "t", rules)
    assert got.columns == ["_runs0", "t", *rules]
    for row in got.collect():
        assert [row[x] for x in rules] == [re.findall(p, row["t"] or "") for p in rules.values()]


def test_rules_are_not_searched_for_one_by_one(spark):
    """Of one text per search, before: fifteen. A pattern of several labels is searched for once."""
    df = spark.range(3).select(F.col("id").cast("string").alias("t"))

    def searches(rules):
        tagged = tagging.tag_entities(df, "t", rules).select(*rules)
        return tagged._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all(")

    assert searches({f"R{i}": f"[a-z]*{stem}[a-z]*" for i, stem in enumerate("abcdefghijklmno")}) == 1
    assert searches({f"R{i}": ("[a-z]+ab", "[a-z]+c")[i % 2] for i in range(15)}) == 1
    assert searches({f"R{i}": ("[a-z]+ab", "[0-9]+c")[i % 2] for i in range(15)}) == 2
    assert searches({"A": r"\d+", "B": "x.", "C": "[a-z]+ab"}) == 3


def test_masking_looks_for_a_character_of_every_match(spark):
    """Before: each text was searched from each of its characters."""
    df = spark.createDataFrame([("ab@c d",), ("abc",), ("@c",), (None,)], "t string")
    for pattern, held in (("[a-z]+@[a-z.]+", "@"), ("[a-z]*b[a-z]*", "b"), ("[a-z]+[0-9]", None), ("a*b+", None), ("a|b", None), (".@", None)):
        masked = masking.mask_column(df, "t", pattern)
        want = [None if t is None else re.sub(pattern, lambda m: "X" * len(m[0]), t) for t in ("ab@c d", "abc", "@c", None)]
        assert [r.t for r in masked.collect()] == want
        plan = masked._jdf.queryExecution().optimizedPlan().toString()
        assert ("Contains" in plan or "contains(" in plan.lower()) == (held is not None), pattern


def test_default_rules(spark):
    sentence = (
        "On May 23, 2017 the Refugee Protection Division in Toronto found, under section 96, that the "
        "claim is rejected because Smith v. Jones applies"
    )
    row = tagging.tag_entities(spark.createDataFrame([(sentence,)], "t string"), "t").first()
    assert row["DATE"] == ["May 23, 2017"] and row["GPE"] == ["Toronto"] and row["LAW"] == ["section 96"]
    assert row["LAW_CASE"] == ["Smith v. Jones"] and len(row["DETERMINATION"]) == 1
    assert row["NORP"] == [] and row["LAW_REPORT"] == []


def test_default_rules_on_a_long_text(spark):
    long = "word " * 40_000 + "the claim is rejected"
    row = tagging.tag_entities(spark.createDataFrame([("One. " + long + ". Two",)], "t string"), "t").first()
    assert row["DETERMINATION"] == [" " + long]
    assert row["CREDIBILITY"] == []


@pytest.mark.parametrize("inline", [2000, 0], ids=["inline", "joined"])
def test_gazetteer(spark, inline):
    terms = {"sri lanka": "GPE", "lanka": "GPE", "court": "ORG"}
    df = spark.createDataFrame(
        [(1, "Court of Sri  Lanka, court"), (2, "nothing"), (3, ""), (4, None)], "id int, t string"
    )
    got = tagging.tag_gazetteer(df, "id", "t", terms, inline_terms=inline)
    assert {r["id"]: (r["GPE"] or [], r["ORG"] or []) for r in got.collect()} == {
        1: (["sri lanka", "lanka"], ["court", "court"]),
        2: ([], []),
        3: ([], []),
        4: ([], []),
    }


def test_flagged_sentences(spark):
    df = spark.createDataFrame([(1, "claim is rejected"), (2, "hello")], "id int, t string")
    assert rows(tagging.flagged_sentences(df, "t", "rejected|accepted", "s")) == [(1, ["rejected"])]


def test_hook(spark):
    def make():
        return lambda texts: [{"UP": [w for w in t.split() if w.isupper()]} for t in texts]

    df = spark.createDataFrame([(1, "A b"), (2, None)], "id int, t string")
    got = tagging.tag_with_hook(df, "t", ["UP"], make)
    assert rows(got) == [(1, "A b", ["A"]), (2, None, [])]


# Reconciliation --------------------------------------------------------------------------------

SCORES = [
    ("john doe", "doe, john q", 100),
    ("may 23 2017", "may 24 2017", 91),
    ("abc", "xyz", 0),
    ("", "x", 0),
    (None, "x", None),
    ("same words", "words same", 100),
]


@pytest.mark.parametrize("left,right,score", SCORES)
def test_token_set_score(left, right, score):
    assert token_set_score(left, right) == score


def _slow_common_subsequence(a, b):
    best = [0] * (len(b) + 1)
    for x in a:
        previous = 0
        for j, y in enumerate(b, 1):
            previous, best[j] = best[j], previous + 1 if x == y else max(best[j], best[j - 1])
    return best[-1]


def test_common_subsequence_by_brute_force():
    from casemill.functions.similarity import _common_subsequence

    rng = random.Random(5)
    for _ in range(300):
        a, b = ("".join(rng.choice("abc ") for _ in range(rng.randint(0, 12))) for _ in "ab")
        assert _common_subsequence(a, b) == _slow_common_subsequence(a, b)


@pytest.mark.parametrize("alphabet", ["ab c-é_9", "xy "])
def test_same_words_means_100(spark, alphabet):
    from casemill.functions.similarity import same_words

    rng = random.Random(11)
    data = [
        tuple("".join(rng.choice(alphabet) for _ in range(rng.randint(0, 9))) for _ in "ab")
        for _ in range(400)
    ]
    df = spark.createDataFrame(data, "a string, b string")
    for r in df.select("*", same_words(F.col("a"), F.col("b")).alias("same")).collect():
        assert r["same"] == (token_set_score(r["a"], r["b"]) == 100), r


def _random_pairs(seed, alphabets, lengths, count):
    rng = random.Random(seed)
    return [
        tuple("".join(rng.choice(letters) for _ in range(rng.randint(0, n))) for _ in "ab")
        for letters in alphabets
        for n in lengths
        for _ in range(count)
    ] + [(None, "x"), ("a", None), (None, None), ("", ""), ("..", "a")]


def test_native_similarity_equals_the_python_form(spark):
    from casemill.functions.similarity import token_set_similarity

    data = _random_pairs(3, ("ab c-é_9", "xy ", "abcdefgh ijk lmn", "aΣİß😀漢 b1²"), (6, 20, 60), 120)
    df = spark.createDataFrame(data, "a string, b string")
    scored = df.withColumn("score", token_set_similarity(F.col("a"), F.col("b"), short=True))
    assert "EvalPython" not in scored._jdf.queryExecution().executedPlan().toString()
    for r in scored.collect():
        assert r["score"] == token_set_score(r["a"], r["b"]), r


def test_similarity_of_long_and_short_texts(spark):
    from casemill.functions.similarity import BITS, token_set_similarity

    data = _random_pairs(4, ("abc defgh", "ab "), (5, 61, 62, 63, 64, 300), 40)
    df = spark.createDataFrame(data, "a string, b string")
    for r in df.withColumn("score", token_set_similarity(F.col("a"), F.col("b"))).collect():
        assert r["score"] == token_set_score(r["a"], r["b"]), r
    edge = spark.createDataFrame([("a" * BITS, "b" * 500 + "a"), ("a" * BITS, "a" * (BITS + 1))], "a string, b string")
    short = edge.select("*", token_set_similarity(F.col("a"), F.col("b"), short=True).alias("score")).collect()
    assert [r["score"] for r in short] == [token_set_score(r["a"], r["b"]) for r in short]
    over = spark.createDataFrame([("a" * (BITS + 1), "b" * (BITS + 1))], "a string, b string")
    with pytest.raises(Exception, match="words of their own"):
        over.select(token_set_similarity(F.col("a"), F.col("b"), short=True)).collect()


def test_long_lists_may_round_up_to_100(spark):
    words = " ".join(f"word{i:03d}" for i in range(40))
    almost = words.replace("word039", "word03")
    assert token_set_score(words, almost) == 100
    other = "completely other content"
    df = spark.createDataFrame([([words], [other, almost])], "a array<string>, b array<string>")
    assert token_set_score(words, f"{other} {almost}") < 100
    assert reconcile.reconcile_names(df, "a", "b").first()["judge_name"] == ""
    df = spark.createDataFrame([([words], [almost])], "a array<string>, b array<string>")
    assert reconcile.reconcile_names(df, "a", "b").first()["judge_name"] == almost


NAMES = [
    (["john doe", "a roe"], ["john doe"], "john doe"),
    (["john doe"], ["member", "doe, john"], "doe, john"),
    (["john doe"], ["no table found"], ""),
    (["b", "a"], ["a", "b"], "a b"),
    ([], [], ""),
]


@pytest.mark.parametrize("first,second,name", NAMES)
def test_reconcile_names(spark, first, second, name):
    df = spark.createDataFrame([(first, second)], "a array<string>, b array<string>")
    assert reconcile.reconcile_names(df, "a", "b").first()["judge_name"] == name


DAYS = [
    (["may 23, 2017"], ["j doe", "may 23, 2017"], "may 23 2017"),
    (["may 23 2017"], ["may 24, 2017"], ""),
    (["in may 2017"], ["x", "may 2017 in"], "may 2017 in"),
    (["in may 2017"], ["may 2017 in"], "may 2017 in"),
    ([], ["may 24, 2017"], ""),
]


@pytest.mark.parametrize("first,second,day", DAYS)
def test_reconcile_dates(spark, first, second, day):
    df = spark.createDataFrame([(first, second)], "a array<string>, b array<string>")
    got = reconcile.reconcile_dates(df, "a", "b").first()["date_decision"]
    assert got == day


# Metrics ---------------------------------------------------------------------------------------


def _pairs(spark, y, p, w=None):
    return spark.createDataFrame(list(zip(y, p, w or [1.0] * len(y))), "y int, p int, w double")


def value(df):
    return df.first()[0]


def test_accuracy(spark):
    df = _pairs(spark, [0, 1, 2, 0, 1, 2], [0, 1, 1, 2, 1, 0], [0.5, 2.0, 0.7, 0.5, 9.0, 0.4])
    assert value(metrics.accuracy(df, "y", "p")) == 0.5
    assert value(metrics.accuracy(df, "y", "p", normalize=False)) == 3.0
    assert value(metrics.accuracy(df, "y", "p", weight="w")) == pytest.approx(0.8778625954198473)


def test_f1_binary(spark):
    df = _pairs(spark, [0, 1, 0, 1, 0], [0, 0, 1, 1, 0], [0.9, 0.5, 3.9, 1.2, 0.3])
    assert value(metrics.f1_score(df, "y", "p")) == 0.5
    assert value(metrics.f1_score(df, "y", "p", pos_label=0)) == pytest.approx(2 / 3)
    assert value(metrics.f1_score(df, "y", "p", weight="w")) == pytest.approx(0.35294117647058826)


def test_f1_averages(spark):
    df = _pairs(spark, [0, 1, 2, 0, 1, 2], [0, 2, 1, 0, 0, 1])
    assert value(metrics.f1_score(df, "y", "p", "macro")) == pytest.approx(0.26666666666666666)
    assert value(metrics.f1_score(df, "y", "p", "micro")) == pytest.approx(1 / 3)
    assert value(metrics.f1_score(df, "y", "p", "weighted")) == pytest.approx(0.26666666666666666)
    assert rows(metrics.f1_score(df, "y", "p", None)) == [(0, 0.8), (1, 0.0), (2, 0.0)]
    assert value(metrics.f1_score(df, "y", "p", "macro", labels=[0, 5])) == pytest.approx(0.4)


def test_f1_edges(spark):
    none = _pairs(spark, [0, 0], [0, 0])
    assert value(metrics.f1_score(none, "y", "p")) == 0.0
    only_predicted = _pairs(spark, [0, 0], [0, 1])
    assert value(metrics.f1_score(only_predicted, "y", "p", "macro")) == pytest.approx(1 / 3)


def test_multilabel(spark):
    df = spark.createDataFrame(
        [([0, 1, 1], [0, 1, 1]), ([0, 1, 0], [1, 1, 0])], "y array<int>, p array<int>"
    )
    assert value(metrics.accuracy(df, "y", "p")) == 0.5
    assert value(metrics.f1_multilabel(df, "y", "p")) == pytest.approx(2 / 3)
    assert value(metrics.f1_samples(df, "y", "p")) == pytest.approx(0.8333333333333333)


def test_eval_bundle(spark):
    df = spark.createDataFrame([(0, [0.9, 0.1]), (1, [0.9, 0.1]), (1, [0.2, 0.8])], "y int, s array<double>")
    row = metrics.eval_bundle(df, "y", "s").first()
    assert tuple(row) == pytest.approx((2 / 3, 2 / 3, 2 / 3))


def test_confusion_matrix_order_and_zeros(spark):
    df = spark.createDataFrame([("R", "R"), ("G", "R"), ("G", "R")], "y string, p string")
    got = metrics.confusion_matrix(df, "y", "p", ["R", "G"])
    assert [tuple(r) for r in got.collect()] == [("R", 1, 0, 0), ("G", 2, 0, 0), ("other", 0, 0, 0)]


# Profiles --------------------------------------------------------------------------------------


def test_profiles(spark):
    df = spark.createDataFrame(
        [(1, "a b[SEP]", True), (1, "b", False), (None, None, False)], "id int, t string, wrong boolean"
    )
    assert rows(profile.null_profile(df)) == [("id", 1), ("t", 1), ("wrong", 0)]
    assert rows(profile.distinct_cases(df, "id")) == [(2,)]
    assert rows(profile.cleaning_report(df, "id")) == [(3, 2, 1, 1)]
    assert rows(profile.word_counts(df, "t")) == [("a", 1), ("b", 1), ("b[SEP]", 1)]
    got = {r["sample"]: (r["n"], r["mean_words"], r["mean_separators"]) for r in profile.error_profile(df, "t", F.col("wrong")).collect()}
    assert got == {"misclassified": (1, 2.0, 1.0), "all": (3, 1.5, 0.5)}


def test_word_stats_and_top_words(spark):
    df = spark.createDataFrame([("a a b", True), ("b c", False), ("c", False)], "t string, w boolean")
    assert rows(profile.word_stats(df, "t")) == [(2.0, 2.0)]
    top = profile.top_words(df, "t", F.col("w"), 2)
    assert sorted((r["sample"], r["rank"], r["word"], r["n"]) for r in top.collect()) == [
        ("all", 1, "a", 2),
        ("all", 2, "b", 2),
        ("misclassified", 1, "a", 2),
        ("misclassified", 2, "b", 1),
    ]


def test_mention_counts(spark):
    df = spark.createDataFrame([(["china", "canada"],), (["china"],), ([],)], "g array<string>")
    assert rows(profile.mention_counts(df, "g")) == [("china", 2)]


# Training sets ---------------------------------------------------------------------------------


def test_train_sets(spark):
    df = spark.createDataFrame(
        [(1, 1, ["a", "b!"], None, "c"), (2, 2, ["x"], "y", "z")],
        "decision_id int, decision_outcome int, p array<string>, q string, r string",
    )
    cover = features.train_set_cover(df, features=["p", "q", "r"])
    assert rows(cover) == [(1, 1, "a b [SEP][SEP]c")]
    everything = features.train_set_all(df, features=["p", "q", "r"])
    assert rows(everything) == [(1, 1, "a b [SEP]c")]


def test_sentence_sets(spark):
    df = spark.createDataFrame([("['a', 'b']", 1.0), ("['c']", None), (None, 1.0)], "s string, y double")
    assert rows(features.train_set_sentences(df, "s", "y")) == [("a, b", 1)]
    assert rows(features.inference_set_sentences(df, "s", "y")) == [("a, b",), ("c",), (None,)]


def test_unknown_and_missing_labels_are_counted(spark):
    df = spark.createDataFrame([("R", "R"), ("G", None), (None, "G"), ("X", "R"), ("R", "Y"), (None, None)], "y string, p string")
    matrix = metrics.confusion_matrix(df, "y", "p", ["R", "G"])
    assert [tuple(r) for r in matrix.collect()] == [("R", 1, 0, 1), ("G", 0, 0, 1), ("other", 1, 1, 1)]
    assert metrics.misclassified(df, "y", "p").count() == 4


def test_gazetteer_looks_up_little(spark):
    """What is joined with the terms is near the hits, and equal rows and rows of one key stay apart."""
    text = "of the people in the city of light, " * 20
    df = spark.createDataFrame([(1, text), (1, text), (None, "nothing"), (2, None), (2, "city of")], "k int, t string").repartition(3)
    terms = spark.createDataFrame([("city of light", "A"), ("people", "B"), ("people of", "B")], "term string, label string")
    grams = tagging._candidates(df, "k", "t", terms, 3).collect()
    assert len(grams) == 2 * (20 + 40 + 1) + 3 and sum(r.term is not None for r in grams) == 2 * (20 + 40)
    got = tagging.tag_gazetteer_table(df, "k", "t", terms, ["A", "B"], 3)
    want = sorted([(1, 20, 20), (1, 20, 20), (None, 0, 0), (2, 0, 0), (2, 0, 0)], key=repr)
    assert rows(got.select("k", F.size("A"), F.size("B"))) == want == rows(got.select("k", F.size("A"), F.size("B")))


def test_gazetteer_paths_agree(spark):
    df = spark.createDataFrame([(1, "New York or york"), (1, "new york"), (2, None), (None, "Quebec"), (3, "")], "k int, t string")
    terms = {"new york": "CITY", "york": "CITY", "quebec": "PLACE"}
    inline = tagging.tag_gazetteer(df, "k", "t", terms)
    joined = tagging.tag_gazetteer(df, "k", "t", terms, inline_terms=0)
    assert sorted(map(str, inline.collect())) == sorted(map(str, joined.collect()))
    assert inline.count() == 5 and inline.filter("CITY IS NULL OR PLACE IS NULL").count() == 0


def test_hot_keys_split_after_a_shuffle(spark):
    many = spark.range(4000).select(F.lit(1.0).alias("k"), "id").repartition(8, "k")
    one = spark.createDataFrame([(1.0, "a")], "k double, v string")
    joined = joins.salted_join(many, one, ["k"], rows=500)
    assert joined.count() == 4000
    hot = joins.hot_keys(many, ["k"], 500)
    assert hot.first()["_salts"] == 8
    spread = many.select(F.pmod(F.xxhash64(F.spark_partition_id(), "id"), F.lit(8))).distinct().count()
    assert spread == 8


@pytest.mark.parametrize("parts", [1, 8])
def test_nan_is_no_key(spark, parts):
    nan = float("nan")
    many = spark.createDataFrame([(nan, 1), (nan, 2), (1.0, 3), (None, 4)], "k double, x int").repartition(parts)
    one = spark.createDataFrame([(nan, "n"), (1.0, "a")], "k double, v string")
    got = joins.salted_join(many, one, ["k"], "left").select("k", "x", "v")
    assert sorted(got.collect(), key=lambda r: r.x) == [(None, 1, None), (None, 2, None), (1.0, 3, "a"), (None, 4, None)]
    assert joins.salted_join(many, one, ["k"], "full").count() == 5


def test_last_write_wins_without_an_order(spark):
    df = spark.createDataFrame([(1, None, "a"), (2, None, "b"), (2, "p", "c"), (3, "x", "d"), (3, "y", None), (None, "z", "e")], "k int, o string, v string")
    kept = sampling.last_write_wins(df, "k", "o")
    assert rows(kept.select("k", "v")) == rows(spark.createDataFrame([(1, "a"), (2, "c"), (3, None), (None, "e")], "k int, v string"))
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan


def test_density_of_equal_scores(spark):
    df = spark.createDataFrame([(0.5,), (0.5,), (None,)], "s double")
    got = outcomes.score_density(df, "s", grid=5)
    assert got.count() == 5 and got.filter("density IS NOT NULL AND density > 0").count() == 0
    assert outcomes.score_density(df.limit(0), "s", grid=5).count() == 0


def test_references_are_decoded(spark):
    df = spark.createDataFrame([("G&eacute;rard <b>Montr&#233;al</b> &amp;lt; &#x1F642; &bogus; &#0; A&B",), (None,)], "t string")
    assert [r[0] for r in df.select(html.block_text(F.col("t"))).collect()] == ["Gérard Montréal &lt; 🙂 &bogus; &#0; A&B", None]


def test_exact_split_finds_its_border_in_steps(spark, monkeypatch):
    monkeypatch.setattr(sampling, "_RANKED", 3)
    df = spark.range(500)
    split = sampling.split_exact(df, ["id"], 0.3)
    assert split.filter("split = 'test'").count() == 150
    assert sampling.split_exact(df.limit(0), ["id"]).count() == 0


def test_accented_names_are_masked(spark):
    df = spark.createDataFrame([("Élise Côté-Roy et JEAN D'Arc, the Board",)], "t string")
    text = df.select(masking.mask_text(F.col("t"))).first()[0]
    assert text == "X" * 14 + " et " + "X" * 10 + ", the Board"
