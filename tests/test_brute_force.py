"""Random inputs against a few lines of plain Python."""

import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from casemill.functions import text
from casemill.operators import masking, metrics, outcomes, profile, sampling, tagging


def some_texts(seed, alphabet, n=300, size=40):
    rng = random.Random(seed)
    return ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, size))) for _ in range(n)]


def per_text(spark, texts, expression):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").repartition(3)
    found = {r["i"]: r["y"] for r in df.select("i", expression(F.col("t")).alias("y")).collect()}
    return [found[i] for i in range(len(texts))]


def squeeze(t):
    return re.sub(r"\s+", " ", t.lower())


def strip(t):
    return re.sub(" +", " ", re.sub(r"[^\w\s\[\]]", " ", t))


PLAIN = [
    ("normalize", "aÉ \t\n\r ß\x1c\x85\u00a0\u2003", text.normalize_text, squeeze),
    ("strip", "aé_1 .!?[]-ç\n\x1d\u00a0²Ⅷ٣\u0301\u200b字", text.strip_punctuation, strip),
    ("words", "ab \t\n \x1e\u00a0\u3000", text.word_count, lambda t: len(t.split())),
    ("separators", ["[SEP]", "a", "["], text.collapse_separators, lambda t: re.sub(r"(\[SEP\]){2,}", "[SEP]", t)),
    ("occurrences", ["[SEP]", "a", "["], text.count_occurrences, lambda t: t.count("[SEP]")),
    (
        "lines",
        "aB \n \t",
        text.clean_lines,
        lambda t: [x for x in (re.sub(r"^\s+", "", y) for y in t.lower().split("\n")) if x],
    ),
    (
        "tail",
        "ab \n",
        lambda c: text.tail_paragraphs(c, 3),
        lambda t: [p for p in t.split("\n") if p.strip(" ")][-3:],
    ),
]


@pytest.mark.parametrize("name,alphabet,expression,plain", PLAIN, ids=[p[0] for p in PLAIN])
def test_text_expression(spark, name, alphabet, expression, plain):
    texts = some_texts(name, alphabet)
    assert per_text(spark, texts, expression) == [plain(t) for t in texts]


def test_written_lists_are_read_back(spark):
    rng = random.Random(2)
    lists = [
        ["".join(rng.choice("ab, é'") for _ in range(rng.randint(0, 6))) for _ in range(rng.randint(0, 4))]
        for _ in range(300)
    ]
    assert per_text(spark, [repr(x) for x in lists], text.parse_list_repr) == lists


@pytest.mark.parametrize("pattern", ["a+b", "[ab]{3,}", "x"])
def test_mask(spark, pattern):
    def plain(t):
        return re.sub(pattern, lambda m: m[0][:-20] + "X" * min(20, len(m[0])), t)

    texts = some_texts(pattern, "aabb c", size=80)
    got = per_text(spark, texts, lambda c: masking.mask_text(c, pattern))
    assert got == [plain(t) for t in texts]
    assert [len(t) for t in got] == [len(t) for t in texts]


@pytest.mark.parametrize("inline", [2000, 0], ids=["inline", "joined"])
def test_gazetteer(spark, inline):
    terms = {"a": "X", "a b": "Y", "b a b": "X", "c": "Y"}
    texts = some_texts(7, "abAc ,", n=200, size=30)
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    found = tagging.tag_gazetteer(df, "i", "t", terms, inline_terms=inline)
    got = {r["i"]: (r["X"] or [], r["Y"] or []) for r in found.collect()}
    for i, t in enumerate(texts):
        tokens = re.sub("[^a-z ]", " ", t.lower()).split()
        hits = defaultdict(list)
        for p in range(len(tokens)):
            for n in (1, 2, 3):
                gram = " ".join(tokens[p : p + n])
                if p + n <= len(tokens) and gram in terms:
                    hits[terms[gram]].append(gram)
        assert got[i] == (hits["X"], hits["Y"]), t


def test_word_and_top_counts(spark):
    texts = some_texts(4, "ab  c", n=100)
    wrong = [i % 3 == 0 for i in range(100)]
    df = spark.createDataFrame(list(zip(texts, wrong)), "t string, w boolean")
    count = Counter(w for t in texts for w in t.split())
    assert {r["word"]: r["n"] for r in profile.word_counts(df, "t").collect()} == count
    bad = Counter(w for t, x in zip(texts, wrong) if x for w in t.split())
    top = profile.top_words(df, "t", F.col("w"), 7).collect()
    for sample, counter in (("all", count), ("misclassified", bad)):
        best = sorted(counter.items(), key=lambda kv: (-kv[1], kv[0]))[:7]
        assert [(r["word"], r["n"]) for r in sorted(top, key=lambda r: r["rank"]) if r["sample"] == sample] == best


def test_duplicates_votes_and_last_rows(spark):
    rng = random.Random(8)
    data = [(rng.choice([0] * 5 + list(range(40))), i, rng.randint(0, 2)) for i in range(400)]
    df = spark.createDataFrame(data, "k int, i int, v int").repartition(4)
    count = Counter(k for k, _, _ in data)
    for rows in (3, 10**6):
        got = {r["i"] for r in outcomes.duplicate_rows(df, "k", rows=rows).collect()}
        assert got == {i for k, i, _ in data if count[k] > 1}
        got = {r["i"] for r in outcomes.duplicate_rows(df, "k", keep="unique", rows=rows).collect()}
        assert got == {i for k, i, _ in data if count[k] == 1}
    groups = defaultdict(list)
    for k, i, _ in data:
        groups[k].append(i)
    got = {r["i"] for r in sampling.last_rows(df, "k", "i", 4).collect()}
    assert got == {i for g in groups.values() for i in sorted(g)[-4:]}
    newest = {r["k"]: r["i"] for r in sampling.last_write_wins(df, "k", "i").collect()}
    assert newest == {k: max(g) for k, g in groups.items()}


@pytest.mark.parametrize("average", ["macro", "micro", "weighted", None])
@pytest.mark.parametrize("labels", [None, [0, 2], [1, 9]])
@pytest.mark.parametrize("weighted", [False, True])
def test_f1(spark, average, labels, weighted):
    rng = random.Random(9)
    data = [(rng.randint(0, 3), rng.randint(1, 4), rng.choice([0.5, 1.0, 2.0])) for _ in range(80)]
    df = spark.createDataFrame(data, "y int, p int, w double")
    w = (lambda r: r[2]) if weighted else (lambda r: 1.0)
    classes = labels or sorted({r[0] for r in data} | {r[1] for r in data})

    def f1(tp, total):
        return 2 * tp / total if total else 0.0

    tp = {c: sum(w(r) for r in data if r[0] == r[1] == c) for c in classes}
    actual = {c: sum(w(r) for r in data if r[0] == c) for c in classes}
    both = {c: actual[c] + sum(w(r) for r in data if r[1] == c) for c in classes}
    per_class = {c: f1(tp[c], both[c]) for c in classes}
    got = metrics.f1_score(df, "y", "p", average, labels=labels, weight="w" if weighted else None).collect()
    if average is None:
        assert {r["class"]: r["f1"] for r in got} == pytest.approx(per_class)
        return
    total = sum(actual.values())
    expected = {
        "macro": sum(per_class.values()) / len(classes),
        "micro": f1(sum(tp.values()), sum(both.values())),
        "weighted": sum(per_class[c] * actual[c] for c in classes) / total if total else 0.0,
    }[average]
    assert got[0]["f1"] == pytest.approx(expected)


def test_density(spark):
    import math
    import statistics

    rng = random.Random(10)
    scores = [round(rng.random(), 2) for _ in range(120)]
    got = outcomes.score_density(spark.createDataFrame([(s,) for s in scores], "s double"), "s", grid=20)
    h = 0.25 * len(scores) ** -0.2 * statistics.stdev(scores)
    low, high = min(scores) - 3 * h, max(scores) + 3 * h
    for r in got.collect():
        at = low + r["point"] * (high - low) / 19
        plain = sum(math.exp(-0.5 * ((at - s) / h) ** 2) for s in scores) / (len(scores) * h * math.sqrt(2 * math.pi))
        assert (r["score"], r["density"]) == pytest.approx((at, plain))
