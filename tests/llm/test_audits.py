"""The exact search and the filter audit against plain versions, and against their SQL."""

import os
import re
from collections import Counter
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from casemill.llm.filters import audit_filters
from casemill.llm.impact import ImpactShard, search_products
from casemill.llm.queries import ORACLES, QUERIES
from tests.harness import compare, sql_connection
from tests.llm.fixtures import DOCUMENTS, documents

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
FLAGS = {"good_lost": "quality = 1", "toxic_lost": "toxic = 1"}
LABELS = "doc_id long, quality int, toxic int"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows_as_sql(spark, name):
    assert compare(spark, sql_connection(SF), QUERIES[name], ORACLES[name], SF) is None


def audit_of(rows, labels):
    """Every order, applied to every document."""
    good = {k for k, q, _ in labels if q == 1 and k is not None}
    toxic = {k for k, _, t in labels if t == 1 and k is not None}
    order = lambda k: float("inf") if k is None else k
    first = {}
    for key, text, *_ in rows:
        first[text or ""] = min(order(key), first.get(text or "", float("inf")))
    parts = {}
    for key, text, lang, *_ in rows:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = {
            "A": len(words) < 100,
            "B": 100 * len(set(words)) < 80 * len(words),
            "C": 100 * len(re.findall("[A-Z]", text)) > 10 * len(text),
            "D": bool(re.search(r"[#$%&*|]", text)),
            "E": order(key) > first[text],
        }
        parts.setdefault(lang or "", []).append((key, {x for x in fails if fails[x]}))
    out, shapley = [], Counter()
    for part, docs in parts.items():
        for names in permutations("ABCDE"):
            left = docs
            for step, own in enumerate(names, 1):
                gone = [d for d in left if own in d[1]]
                left = [d for d in left if own not in d[1]]
                failing = sum(own in f for _, f in docs)
                shapley[part, own] += len(gone)
                lost = [sum(k in some for k, _ in gone) for some in (good, toxic)]
                out.append((part, "".join(names), step, len(left), len(gone), failing - len(gone), sum(f == {own} for _, f in docs), *lost, own))
    return Counter((*r[:-1], shapley[r[0], r[-1]]) for r in out)


def audited():
    rows = [(k, t, ("en", "de", "", None)[i % 4], s, n) for i, (k, t, _, s, n) in enumerate(documents())]
    long = "Wörter und 日本 " * 40
    rows += [(9000 + i, long, ("en", "fr")[i % 2], None, None) for i in range(30)] + [(9000, long, "fr", None, None), (9000, long, "en", None, None)]
    rows += [(8000, "LOUD " * 150, "en", None, None), (8001, "#" + "w " * 120, "xx", None, None), (8002, "a\x0bb\x0cc " * 60, "xx", None, None)]
    labels = [(k, i % 3 % 2, (i % 5) // 4) for i, (k, *_) in enumerate(rows) if i % 2] + [(9000, 1, 0), (9000, 0, 1), (None, 1, 1), (9001, None, None), (-5, 1, 1)]
    return rows, labels


def test_audit(spark):
    rows, labels = audited()
    df = spark.createDataFrame(rows, DOCUMENTS).repartition(4).withColumns({"n": F.lit(1), "mask": F.lit("x"), "a.b": F.lit(0), "quality": F.lit(1)})
    known = spark.createDataFrame(labels, LABELS)
    out = audit_filters(df, known, FLAGS)
    assert out.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert [t for _, t in out.dtypes] == ["string", "string", "int"] + ["bigint"] * 7
    assert Counter(map(tuple, out.collect())) == audit_of(rows, labels)
    some = rows[:9]
    assert Counter(map(tuple, audit_filters(spark.createDataFrame(some, DOCUMENTS), known.limit(0), FLAGS).collect())) == audit_of(some, [])
    assert audit_filters(df.limit(0), known, FLAGS).collect() == []


def test_audit_of_other_filters(spark):
    """Filters of one's own: two, so two orders."""
    df = spark.createDataFrame([(1, "a", "x"), (2, "a", "x"), (3, "bbbb", "x")], "id long, body string, kind string")
    out = audit_filters(df, df.limit(0), {}, lambda text, words: {"L": F.length(text) > 3}, "C", "id", "body", "kind", "id")
    want = [("x", "CL", 1, 2, 1, 0, 1, 2), ("x", "CL", 2, 1, 1, 0, 1, 2), ("x", "LC", 1, 2, 1, 0, 1, 2), ("x", "LC", 2, 1, 1, 0, 1, 2)]
    assert sorted(map(tuple, out.collect())) == want


def test_shard_keeps_all_of_the_best():
    rng = np.random.default_rng(2)
    for n, dim, spread in ((1, 3, 5), (127, 4, 3), (700, 16, 200), (1500, 8, 2), (900, 12, 2**22)):
        x = rng.integers(-spread, spread + 1, (n, dim))
        x[rng.random((n, dim)) < 0.2] = 0
        shard = ImpactShard(x)
        for i in range(0, n, max(1, n // 25)):
            scores = x @ x[i]
            others = np.sort(np.delete(scores, i))[::-1]
            limit = others[min(10, n - 1) - 1] if n > 1 else None
            for least in (None, limit):
                rows, found = shard.best(x[i], 10, least, np.array([i]))
                assert (scores[rows] == found).all() and i not in rows
                if limit is not None:
                    assert sorted(rows[found >= limit]) == [r for r in np.flatnonzero(scores >= limit) if r != i]


def products(rows, step=10, k=10):
    ints = {}
    for key, v, *_ in rows:
        if key is not None and v and all(c is not None and np.isfinite(c) and abs(c) < 1e5 for c in v):
            ints.setdefault(key, []).append([int(np.floor(1024 * c)) for c in v])
    out = Counter()
    for q, mine in ints.items():
        if q % step == 0:
            for v in {tuple(m) for m in mine}:
                found = [(-sum(a * b for a, b in zip(v, w)), c) for c, ws in ints.items() if c != q for w in ws if len(w) == len(v)]
                out.update((q, n, c, -s) for n, (s, c) in enumerate(sorted(found)[:k], 1))
    return out


def test_products(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(600, 12)).astype(np.float32)
    x[100:140] = x[99]
    x[200:240] = np.round(x[200:240])
    rows = [(i, row.tolist(), "e") for i, row in enumerate(x)]
    rows += [(1000, None, "e"), (1010, [], "e"), (1020, [None] * 12, "e"), (1030, [float("nan")] * 12, "e"), (1040, [float("inf")] * 12, "e")]
    rows += [(1050, [0.0] * 12, "e"), (1060, [1e30] * 12, "e"), (1070, [1.0, 2.0], "e"), (1071, [1.0, -2.0], "e"), (None, x[0].tolist(), "e")]
    rows += [(110, x[5].tolist(), "e"), (120, x[99].tolist(), "e"), (3, x[3].tolist(), "e"), (-20, x[7].tolist(), "e")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, query string").repartition(5).withColumn("pack", F.lit(1)).withColumn("a.b", F.lit(1))
    out = search_products(df, F.col("vec_id") % 10 == 0)
    assert out.columns == ["query_id", "rank", "vec_id", "score"] and [t for _, t in out.dtypes] == ["bigint", "int", "bigint", "bigint"]
    assert Counter(map(tuple, out.collect())) == products(rows)
    assert search_products(df.limit(0), F.lit(True)).collect() == [] == search_products(df, F.lit(False)).collect()
    few = df.filter("vec_id in (10, 20, 31)")
    assert Counter(map(tuple, search_products(few, F.col("vec_id") % 10 == 0).collect())) == products([r for r in rows if r[0] in (10, 20, 31)])
