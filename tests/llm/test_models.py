"""Trained operators: accuracy on rows that were held out, recall against brute force, and edges."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from casemill.llm.descent import link_vectors
from casemill.llm.graphs import components
from casemill.llm.language import fit_language, identify_language
from casemill.llm.partitions import balanced_parts, neighbour_graph, search_vectors
from casemill.llm.quality import document_statistics, fit_quality, isotonic, score_quality, score_statistics
from casemill.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def test_language_on_held_out_rows(spark):
    out = QUERIES["op1_language_svm"](spark, SF)
    truth = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    rows = out.join(truth, "doc_id").filter("held_out AND lang IS NOT NULL").collect()
    assert len(rows) > 20 and np.mean([r.lang == r.lang_pred for r in rows]) > 0.95
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_edges(spark):
    rows = [(1, "hello there", "en", "x"), (2, "bonjour à tous", "fr", None), (3, None, "de", None), (4, "123 !?", None, None), (5, "", "en", None), (None, "la maison", None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    out = {r.doc_id: (r.lang_pred, r.score) for r in identify_language(df, fit_language(df)).collect()}
    assert out[3] == out[4] == out[5] == ("und", 0.0)
    assert out[1][0] == "en" and out[2][0] == "fr"
    assert {r.lang_pred for r in identify_language(df, None).collect()} == {"und"}
    assert fit_language(df.limit(0)) is None and fit_language(df.withColumn("lang", F.lit(None).cast("string"))) is None
    one = fit_language(df.filter("lang = 'en'"))
    assert {r.lang_pred for r in identify_language(df.filter("doc_id < 3"), one).collect()} == {"en"}


def test_every_language_is_learned(spark):
    """205 languages with words of their own, one of them in a table where a third of all rows are one row."""
    rng = np.random.default_rng(12)
    letters = np.array(list("abcdefghijklmnopqrstuvwxyzäöüéñçøå"))
    lexicons = {f"x{i:03d}": ["".join(rng.choice(letters, rng.integers(3, 9))) for _ in range(12)] for i in range(203)} | {"de": ["der", "und"], "en": ["the", "and"]}
    say = lambda lang: " ".join(rng.choice(lexicons[lang], 30))
    rows = [(i, say(lang), lang) for i, lang in enumerate(lang for lang in lexicons for _ in range(8))]
    rows += [(7, rows[7][1], rows[7][2])] * (len(rows) // 2)
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    asked = spark.createDataFrame([(say(lang), lang) for lang in lexicons], "text string, lang string").withColumn("a.b", F.lit(1))
    out = identify_language(asked, fit_language(df)).collect()
    assert {r.lang_pred for r in out} == set(lexicons) and np.mean([r.lang == r.lang_pred for r in out]) > 0.97


def test_quality_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    out = QUERIES["op9_quality_fourier"](spark, sf)
    rows = out.join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").filter("held_out").collect()
    assert len(rows) > 50 and np.mean([r.predicted == r.quality for r in rows]) > 0.9
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)


def test_quality_edges(spark):
    docs = spark.createDataFrame([(1, "Good text."), (1, "again"), (2, None), (3, ""), (None, "x")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, None), (3, 7), (None, 0)], "doc_id long, quality int")
    stats = document_statistics(docs)
    model = fit_quality(stats, labels)
    assert {r.score for r in score_statistics(stats, model).collect()} == {0.5}
    assert score_quality(docs, model).count() == 5 and score_quality(docs.limit(0), model).count() == 0
    both = spark.createDataFrame([(1, 1), (2, 0), (3, 0)], "doc_id long, quality int")
    scores = [r.score for r in score_quality(docs, fit_quality(stats, both)).collect()]
    assert len(scores) == 5 and all(0 <= s <= 1 for s in scores)
    dotted = docs.withColumn("a.b", F.lit(3)).withColumn("score.x", F.lit("y"))
    out = score_quality(dotted, fit_quality(stats, both))
    assert set(out.columns) >= {"a.b", "score.x"} and {r["a.b"] for r in out.collect()} == {3}


def test_isotonic():
    raw, level = isotonic(np.array([0.0, 1, 2, 3]), np.array([1.0, 0, 1, 1]), np.array([1.0, 1, 1, 1]))
    assert raw.tolist() == [0.5, 2.5] and level.tolist() == [0.5, 1.0]


def test_components(spark):
    rng = np.random.default_rng(4)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(400 + i, 401 + i) for i in range(40)] + [(500, 500 + i) for i in range(1, 60)]
    label = {}
    for a, b in edges:
        label.setdefault(a, a), label.setdefault(b, b)
    for _ in range(60):
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    out = {r.node: r.label for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert out == {n: x for n, x in label.items() if n in out} and all(label[n] == n for n in set(label) - set(out))
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def vectors(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(700, 16))
    x[100:130] = x[99] + rng.normal(size=(30, 16)) * 0.03
    x[200:210] = x[150]
    x[300:304] = x[299] + rng.normal(size=(4, 16)) * 0.15
    rows = [(i, [float(v) for v in row], i % 3 if not 90 <= i < 310 else 1, "e") for i, row in enumerate(x.astype(np.float32))]
    rows += [(900, None, 1, "e"), (901, [0.0] * 16, 1, "e"), (902, [float("nan")] * 16, 1, "e"), (903, [None] * 16, 1, "e"), (904, [], 1, "e")]
    rows += [(905, rows[99][1], None, "e"), (906, [1.0, 2.0], 1, "e"), (907, [1.0, 2.0], 1, "e"), (908, [float("inf")] + [1.0] * 15, 1, "e")]
    rows += [(999, rows[150][1], 1, "e"), (5, rows[5][1], 2, "e")]
    return rows, spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, node string").repartition(4)


def usable(v):
    return v and all(c is not None and np.isfinite(c) for c in v) and any(v)


def cosine(a, b):
    a, b = np.array(a), np.array(b)
    return float(a @ b / np.sqrt((a @ a) * (b @ b)))


def test_links(spark):
    rows, df = vectors(spark)
    good = [i for i, r in enumerate(rows) if usable(r[1]) and r[2] is not None]
    near = {i: [j for j in good if i != j and rows[i][2] == rows[j][2] and len(rows[i][1]) == len(rows[j][1]) and cosine(rows[i][1], rows[j][1]) >= 0.98] for i in good}
    least = [r[0] for r in rows]
    for _ in range(40):
        for i, js in near.items():
            least[i] = min([least[i], *(least[j] for j in js)])
    want = sorted((r[0], len(near.get(i, [])), least[i], r[0] == least[i]) for i, r in enumerate(rows))
    assert sorted(map(tuple, link_vectors(df).collect())) == want
    assert link_vectors(df.limit(0)).collect() == []


def _tight(rng, centre, n, spread):
    x = centre + rng.normal(size=(n, len(centre))) * spread / np.sqrt(len(centre))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def test_links_of_tight_groups_across(spark):
    """Groups larger than a list, which link only with members of the other beyond its end."""
    rng = np.random.default_rng(3)
    a, b = np.linalg.qr(rng.normal(size=(32, 2)))[0].T
    x = np.concatenate([_tight(rng, a, 20, 0.02), _tight(rng, a * 0.985 + b * np.sqrt(1 - 0.985**2), 20, 0.02)])
    near = x @ x.T
    assert near[:20, :20].min() > 0.998 and near[20:, 20:].min() > 0.998 and near[:20, 20:].max() < 0.99 and near.min() > 0.9805
    df = spark.createDataFrame([(i, row.tolist(), 1) for i, row in enumerate(x)], "vec_id long, embedding array<double>, label int")
    assert sorted(map(tuple, link_vectors(df).collect())) == [(i, 39, 0, i == 0) for i in range(40)]


def test_rare_links_in_a_cone(spark):
    """Planes do not part these vectors, and an audit of a few of them sees hardly any of the 30 links."""
    rng = np.random.default_rng(6)
    x = np.eye(1, 48)[0] * 2 + rng.normal(size=(1800, 48)) / np.sqrt(48)
    for i in range(30):
        x[1700 + i] = x[i] + rng.normal(size=48) * 0.35 / np.sqrt(48)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    links = unit @ unit.T >= 0.98
    np.fill_diagonal(links, False)
    assert 40 < links.sum() < 200
    df = spark.createDataFrame([(i, row.tolist(), 1) for i, row in enumerate(x)], "vec_id long, embedding array<double>, label int")
    assert [r.n_links for r in sorted(link_vectors(df).collect(), key=lambda r: r.vec_id)] == links.sum(axis=1).tolist()


def test_search(spark):
    rows, df = vectors(spark)
    out = search_vectors(df, F.col("vec_id") % 20 == 0).collect()
    found = {}
    for r in sorted(out, key=lambda r: (r.query_id, r.rank)):
        found.setdefault(r.query_id, []).append((r.vec_id, r.score))
    hits = total = 0
    by_id = {r[0]: r for r in rows}
    for q in {r[0] for r in rows if r[0] % 20 == 0 and usable(r[1])}:
        scores = [(-cosine(by_id[q][1], r[1]), r[0]) for r in rows if usable(r[1]) and r[0] != q and len(r[1]) == len(by_id[q][1])]
        true = sorted(scores)[:5]
        assert len(found[q]) == len(true) and [s for _, s in found[q]] == sorted((s for _, s in found[q]), reverse=True)
        assert all(abs(s - cosine(by_id[q][1], by_id[v][1])) < 1e-12 for v, s in found[q])
        hits += sum(s >= -true[-1][0] - 1e-9 for _, s in found[q])
        total += len(true)
    assert hits / total >= 0.9
    assert search_vectors(df.limit(0), F.lit(True)).collect() == []


@pytest.mark.parametrize("inner", [False, True])
def test_search_in_clusters(spark, monkeypatch, inner):
    """Of vectors in clusters few parts are opened; parts with many rows are cut again; a third of the rows are one vector."""
    from casemill.llm import partitions

    if inner:
        monkeypatch.setattr(partitions, "PARTS", 8)
        monkeypatch.setattr(partitions, "LEAF", 64)
    seen, measured = [], partitions._opened
    monkeypatch.setattr(partitions, "_opened", lambda filed, queries, tree, k: seen.append((len(tree.leaves()), measured(filed, queries, tree, k))) or seen[-1][1])
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(60, 24))
    x = centres[rng.integers(0, 60, 3000)] + rng.normal(size=(3000, 24)) * 0.4
    x[rng.permutation(3000)[:1000]] = x[0]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(4)
    out = search_vectors(df, F.col("vec_id") % 50 == 0).collect()
    near = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = near @ near.T
    np.fill_diagonal(near, -2)
    found = {}
    for r in out:
        found.setdefault(r.query_id, []).append(r.score)
    assert sorted(found) == list(range(0, 3000, 50)) and {len(s) for s in found.values()} == {5}
    hits = [s >= np.sort(near[q])[-5] - 1e-9 for q, scores in found.items() for s in scores]
    (leaves, opened), = seen
    assert np.mean(hits) >= 0.9 and opened <= leaves / 2
    assert leaves > 8 if inner else leaves == 16


def test_balanced_parts():
    x = np.random.default_rng(1).normal(size=(200, 8))
    parts = balanced_parts(neighbour_graph(x / np.linalg.norm(x, axis=1, keepdims=True), 5), 8)
    assert np.bincount(parts).tolist() == [25] * 8


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_queries_have_rows(spark, name):
    assert QUERIES[name](spark, SF).limit(1).count() == 1


def test_pipeline(spark):
    import corpus_pipeline as pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    extra = spark.createDataFrame([(10**6, None, None, None, None), (10**6 + 1, "", "en", "s", 0), (None, "x y z", "en", "s", 5)], docs.schema)
    docs = docs.unionByName(extra).withColumn("_quality", F.lit("clash")).withColumn("kept", F.lit(1))
    for _, stage in pipeline.STAGES[:-1]:
        out = pipeline.store(stage(spark, docs, SF), "stage")
        assert out.columns == docs.columns and 0 < out.count() <= docs.count()
        docs = out
    packed = pipeline.STAGES[-1][1](spark, docs, SF)
    assert packed.filter("start = 0").count() == docs.count()
