"""Training, search and scoring on a separable set."""

import pytest
from pyspark.sql import functions as F

from casemill.operators import classify, epochs
from casemill.operators.sampling import split_by_hash


@pytest.fixture(scope="module")
def examples(spark):
    good = F.col("id") % 3 == 0
    text = F.when(good, F.concat(F.lit("accepted fear "), "id")).otherwise(F.concat(F.lit("rejected claim "), "id"))
    df = spark.range(240).select("id", text.alias("text"), good.cast("int").alias("labels"))
    return split_by_hash(df, ["id"])


def test_tokens_are_cut(spark):
    df = spark.createDataFrame([("A  b C",)], "t string")
    assert df.select(classify.tokens(F.col("t"), 2)).first()[0] == ["a", "b"]


def test_train_and_score(spark, examples):
    train, test = examples.filter("split = 'train'"), examples.filter("split = 'test'")
    trained = classify.train_text_clf(train, test, epochs=(1, 10), n_features=1 << 10)
    assert [h["epochs"] for h in trained.history] == [1, 10]
    assert max(h["accuracy"] for h in trained.history) == 1.0
    scored = classify.score_text_clf(trained.model, test.select("id", "text", "labels"))
    right = (F.col("prediction") == "POSITIVE") == (F.col("labels") == 1)
    assert scored.filter(~right).count() == 0
    assert scored.filter(~F.col("predicted_class").between(0, 1)).count() == 0


def test_max_len_limits_what_the_model_sees(spark, examples):
    pipeline = classify.text_pipeline(max_len=1, n_features=1 << 8).fit(examples)
    tokens = pipeline.transform(examples).select(F.max(F.size("_tokens"))).first()[0]
    assert tokens == 1


def test_search(spark, examples):
    settings = classify.sample_settings(2, seed=1, epochs=(5,), n_features=(1 << 8,))
    assert settings == classify.sample_settings(2, seed=1, epochs=(5,), n_features=(1 << 8,))
    assert all(1e-4 <= s["reg"] <= 1e-1 for s in settings)
    found = classify.tune_text_clf(examples, "id", settings)
    assert len(found.history) == 2
    assert max(h["weighted_f1"] for h in found.history) > 0.9
    scored = classify.score_text_clf(found.model, examples.select("text", "labels"))
    assert scored.filter((F.col("prediction") == "POSITIVE") == (F.col("labels") == 1)).count() > 220


def test_search_gives_up_on_hopeless_settings(spark, examples, monkeypatch):
    """A planted optimum among settings that all but forbid to learn: found, with few full trainings."""
    settings = [{"reg": r, "epochs": 8, "n_features": n} for r, n in ((50.0, 2), (80.0, 256), (0.01, 256), (60.0, 256), (90.0, 2), (70.0, 2))]
    made, fitted = classify._classifier, []
    monkeypatch.setattr(classify, "_classifier", lambda label, epochs=20, reg=0.01: fitted.append((epochs, reg)) or made(label, epochs, reg))
    found = classify.tune_text_clf(examples, "id", settings, folds=2)
    best = max(found.history, key=lambda h: (h["rounds"], h["weighted_f1"]))
    assert best["reg"] == 0.01 and best["weighted_f1"] > 0.95 and [h["rounds"] for h in found.history].count(1) == 3
    # The last training is of the best setting, on all rows.
    assert fitted[-1] == (8, 0.01) and sum(e == 8 for e, _ in fitted[:-1]) <= len(settings) * 2 // 2
    assert len({(h["reg"], h["n_features"]) for h in found.history}) == 6


def _numbers(spark, seed, n, classes):
    """Rows of a few features with a planted rule and noise, as stored sparse rows and as Spark ML vectors."""
    import numpy as np
    from pyspark.ml.linalg import Vectors

    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 4)) * (rng.random((n, 4)) < 0.6) * [1, 5, 0.1, 1]
    rule = rng.normal(size=(4, classes))
    label = (x / [1, 5, 0.1, 1] @ rule + rng.gumbel(size=(n, classes))).argmax(axis=1)
    rows = [(int(y), Vectors.sparse(5, [(j, float(v)) for j, v in enumerate(r) if v])) for y, r in zip(label, x)]
    return spark.createDataFrame(rows, ["_label", "features"]).withColumn("_label", F.col("_label").cast("int"))


@pytest.mark.parametrize("classes", [2, 3])
def test_epochs_reach_the_optimum(spark, classes):
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import vector_to_array

    rows = _numbers(spark, classes, 600, classes).repartition(5).cache()
    run = epochs.train_epochs(rows.select("_label", *epochs.sparse_columns("features")), 25, 5, reg=0.05)
    losses = [e.loss for e in run]
    assert losses == sorted(losses, reverse=True) and losses[0] > losses[-1] and len(run) == 25
    family = "binomial" if classes == 2 else "multinomial"
    other = LogisticRegression(labelCol="_label", regParam=0.05, maxIter=200, tol=1e-10, family=family).fit(rows)
    a = epochs.EpochModel.of(run[-1]).transform(rows).select(vector_to_array("probability")).collect()
    b = other.transform(rows).select(vector_to_array("probability")).collect()
    assert max(abs(p - q) for x, y in zip(a, b) for p, q in zip(x[0], y[0])) < 1e-4


def test_epochs_are_those_of_one_run(spark, examples, monkeypatch):
    train, test = examples.filter("split = 'train'"), examples.filter("split = 'test'")
    made, real = [], classify.train_epochs
    monkeypatch.setattr(classify, "train_epochs", lambda *a: made.append(a[1]) or real(*a))
    every = classify.train_text_epochs(train, test, epochs=6, n_features=1 << 8)
    some = classify.train_text_epochs(train, test, epochs=(2, 6), n_features=1 << 8)
    assert made == [6, 6] and [h["epochs"] for h in every.history] == [1, 2, 3, 4, 5, 6]
    for h, of_all in zip(some.history, (every.history[1], every.history[5])):
        assert h["loss"] == pytest.approx(of_all["loss"]) and h["accuracy"] == pytest.approx(of_all["accuracy"])
    best = max(every.history, key=lambda h: h["macro_f1"])
    scored = classify.score_text_clf(every.model, test)
    right = (F.col("prediction") == "POSITIVE") == (F.col("labels") == 1)
    assert scored.filter(right).count() / test.count() == pytest.approx(best["accuracy"])


def test_sums_of_many_tasks_and_empty_ones(spark, monkeypatch):
    rows = _numbers(spark, 7, 60, 2).select("_label", *epochs.sparse_columns("features"))
    one = epochs.train_epochs(rows.coalesce(1), 5, 5)
    monkeypatch.setattr(epochs, "GROUP", 3)
    many = epochs.train_epochs(rows.repartition(30), 5, 5)
    assert [e.loss for e in one] == pytest.approx([e.loss for e in many])


def test_training_needs_two_classes(spark):
    rows = _numbers(spark, 7, 20, 2).select(F.lit(0).alias("_label"), *epochs.sparse_columns("features"))
    for none in (rows, rows.limit(0)):
        with pytest.raises(ValueError, match="two classes"):
            epochs.train_epochs(none, 2, 5)


def test_epoch_model_is_saved(spark, examples, tmp_path):
    trained = classify.train_text_epochs(examples, examples, epochs=3, n_features=1 << 6)
    trained.model.write().overwrite().save(str(tmp_path / "model"))
    again = classify.PipelineModel.load(str(tmp_path / "model"))
    for a, b in zip(*(m.transform(examples).orderBy("id").select("probability").collect() for m in (trained.model, again))):
        assert a == b


def test_groups_are_evaluated_as_one_by_one(spark):
    from casemill.operators.metrics import eval_bundle, eval_groups

    rows = [(g, y, p) for g, pairs in {"a": [(0, 0), (1, 0), (1, 1)], "b": [(2, 0), (0, 0)], "c": [(1, 1)]}.items() for y, p in pairs]
    df = spark.createDataFrame(rows, "g string, y int, p int")
    found = {r["g"]: r for r in eval_groups(df, "y", "p", "g").collect()}
    for g in "abc":
        own = df.filter(F.col("g") == g).withColumn("s", F.transform(F.sequence(F.lit(0), F.lit(2)), lambda i: F.when(i == F.col("p"), 1.0).otherwise(0.0)))
        for name, value in eval_bundle(own, "y", "s").first().asDict().items():
            assert found[g][name] == pytest.approx(value), (g, name)
