"""Text classification with Spark ML: tokens, training, search and scoring."""

from __future__ import annotations

import math
import random
from dataclasses import dataclass
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import HashingTF, IDF, RegexTokenizer, SQLTransformer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

from casemill.functions.arrays import argmax
from casemill.functions.keys import hash_bucket, key_hash
from casemill.functions.text import words
from casemill.operators.cleaning import map_values
from casemill.operators.epochs import EpochModel, epoch_predictions, sparse_columns, train_epochs
from casemill.operators.metrics import eval_bundle, eval_groups
from casemill.rules.defaults import CASE_TOKENS, CLASS_NAMES
from casemill.workdir import materialize

# Spread of the gradient sums over a tree of tasks, so that the driver adds up few of them.
_TREE_DEPTH = 3


def tokens(text: Column, max_len: int = CASE_TOKENS) -> Column:
    """Lower-case words of a text, at most ``max_len`` of them (the model's input length)."""
    return F.slice(words(F.lower(text)), 1, max_len)


def _token_stages(text, max_len, pieces=None):
    """Words of the whole text, or of its beginning if the caller gives a length; with ``pieces``, the words cut into
    pieces of so many characters, which a few rows teach more about than whole words."""
    kept = "_words" if max_len is None else f"slice(_words, 1, {int(max_len)})"
    pattern = "\\s+" if pieces is None else rf"\S{{1,{int(pieces)}}}"
    return [
        RegexTokenizer(inputCol=text, outputCol="_words", pattern=pattern, gaps=pieces is None),
        SQLTransformer(statement=f"SELECT *, {kept} AS _tokens FROM __THIS__"),
    ]


def _vector_stages(n_features):
    return [
        HashingTF(inputCol="_tokens", outputCol="_tf", numFeatures=n_features),
        IDF(inputCol="_tf", outputCol="features"),
    ]


def _classifier(label, max_iter=20, reg=0.01):
    return LogisticRegression(
        labelCol=label,
        featuresCol="features",
        maxIter=max_iter,
        regParam=reg,
        aggregationDepth=_TREE_DEPTH,
    )


def text_pipeline(
    text: str = "text", label: str = "labels", max_len: int | None = None, n_features: int = 1 << 16, pieces: int | None = None
) -> Pipeline:
    return Pipeline(
        stages=[*_token_stages(text, max_len, pieces), *_vector_stages(n_features), _classifier(label)]
    )


@dataclass
class Trained:
    """The best model and what every setting scored on held-out rows."""

    model: PipelineModel
    history: list[dict]


def train_text_clf(
    train: DataFrame,
    test: DataFrame,
    text: str = "text",
    label: str = "labels",
    epochs: tuple[int, ...] = (5, 10, 20),
    max_len: int | None = None,
    n_features: int = 1 << 16,
    reg: float = 0.01,
    pieces: int | None = None,
) -> Trained:
    """Train for each number of epochs, evaluate on ``test`` and keep the best macro F1.

    The features are computed once and stored in the shared folder; only metrics and model
    weights (bounded by ``n_features``) reach the driver.
    """
    features = Pipeline(stages=[*_token_stages(text, max_len, pieces), *_vector_stages(n_features)]).fit(train)
    train_x = materialize(features.transform(train).select(label, "features"), "train-features")
    test_x = materialize(features.transform(test).select(label, "features"), "test-features")
    history, best, best_score = [], None, -1.0
    for n in epochs:
        fitted = _classifier(label, n, reg).fit(train_x)
        scored = fitted.transform(test_x).withColumn("_scores", vector_to_array("probability"))
        metrics = eval_bundle(scored, label, "_scores").first().asDict()
        history.append({"epochs": n, **metrics})
        if (metrics["macro_f1"] or 0.0) > best_score:
            best, best_score = fitted, metrics["macro_f1"] or 0.0
    return Trained(PipelineModel(stages=[*features.stages, best]), history)


def train_text_epochs(
    train: DataFrame,
    test: DataFrame,
    text: str = "text",
    label: str = "labels",
    epochs: int | tuple[int, ...] = 20,
    max_len: int | None = None,
    n_features: int = 1 << 16,
    reg: float = 0.01,
    pieces: int | None = None,
) -> Trained:
    """Train once, evaluate epochs on ``test`` and keep the one with the best macro F1, the first of equals.

    ``epochs`` is the number of epochs, all of which are evaluated, or those to evaluate, of which the last ends the run.
    The history has for each its loss on ``train`` and its metrics. The features are computed once and stored in the
    shared folder; only sums, metrics and weights (bounded by ``n_features``) reach the driver.
    """
    numbers = list(range(1, epochs + 1)) if isinstance(epochs, int) else sorted(set(epochs))
    features = Pipeline(stages=[*_token_stages(text, max_len, pieces), *_vector_stages(n_features)]).fit(train)
    columns = F.col(label).cast("int").alias("_label"), *sparse_columns("features")
    train_x = materialize(features.transform(train).select(*columns), "train-features")
    test_x = features.transform(test).select(*columns)
    run = [e for e in train_epochs(train_x, numbers[-1], n_features, reg) if e.number in numbers]
    predicted = epoch_predictions(test_x, run)
    found = {r["epoch"]: r for r in eval_groups(predicted, "label", "prediction", "epoch").collect()}
    history = []
    for e in run:
        scored = found[e.number].asDict() if e.number in found else {"accuracy": None, "macro_f1": None, "weighted_f1": None}
        scored.pop("epoch", None)
        history.append({"epochs": e.number, "loss": e.loss, **scored})
    best = max(range(len(run)), key=lambda i: (history[i]["macro_f1"] or 0.0, -i))
    return Trained(PipelineModel(stages=[*features.stages, EpochModel.of(run[best])]), history)


def sample_settings(
    trials: int,
    seed: int = 0,
    reg: tuple[float, float] = (1e-4, 1e-1),
    epochs: tuple[int, ...] = (5, 10, 20),
    n_features: tuple[int, ...] = (1 << 14, 1 << 16),
) -> list[dict]:
    """Random settings for the search: ``reg`` log-uniform, the others from their choices."""
    draw = random.Random(seed)
    low, high = (math.log(x) for x in reg)
    return [
        {
            "reg": math.exp(draw.uniform(low, high)),
            "epochs": draw.choice(epochs),
            "n_features": draw.choice(n_features),
        }
        for _ in range(trials)
    ]


def tune_text_clf(
    train: DataFrame,
    case: str,
    settings: list[dict],
    text: str = "text",
    label: str = "labels",
    folds: int = 2,
    max_len: int | None = None,
    seed: str = "0",
    pieces: int | None = None,
    parallelism: int = 2,
) -> Trained:
    """Search the settings for the best weighted F1; the best one is trained on all rows.

    Successive halving: all settings are tried with a small part of their epochs, the better half goes on with twice as
    many, and so on, until the last ones get all. So at most half of the settings are ever trained in full, and a hopeless
    one costs little. The history has for each setting the rounds it stayed (``rounds``), and its score in the last.

    The fold of a row is a hash of its case, so a case is never in both parts and the folds are the
    same in every run. The tokens are made once, and the term counts once for each number of features; both are stored in
    the shared folder.
    """
    front = Pipeline(stages=_token_stages(text, max_len, pieces)).fit(train)
    fold = hash_bucket(key_hash(seed, [F.col(case)]), folds).cast("int").alias("_fold")
    tokenized = materialize(front.transform(train).select("_tokens", F.col(label), fold), "tokens")
    counters = {n: _vector_stages(n) for n in sorted({s["n_features"] for s in settings})}
    counted = {n: materialize(tf.transform(tokenized).drop("_tokens"), "terms") for n, (tf, _) in counters.items()}
    parts = {}
    for n, (_, idf) in counters.items():
        for f in range(folds):
            known = counted[n].filter(F.col("_fold") != f)
            scale = idf.fit(known)
            parts[n, f] = scale.transform(known), scale.transform(counted[n].filter(F.col("_fold") == f))
    judge = MulticlassClassificationEvaluator(labelCol=label, metricName="f1")

    def score(job):
        s, epochs, f = job
        fit_on, held = parts[s["n_features"], f]
        return judge.evaluate(_classifier(label, epochs, s["reg"]).fit(fit_on).transform(held))

    alive, scores, stayed = list(range(len(settings))), {}, dict.fromkeys(range(len(settings)), 0)
    last = int(math.log2(len(settings)))
    with ThreadPool(parallelism) as pool:
        for turn in range(last + 1):
            jobs = [(settings[i], max(1, settings[i]["epochs"] >> (last - turn)), f) for i in alive for f in range(folds)]
            found = pool.map(inheritable_thread_target(train.sparkSession)(score), jobs)
            for k, i in enumerate(alive):
                scores[i], stayed[i] = sum(found[k * folds : (k + 1) * folds]) / folds, turn + 1
            alive = sorted(alive, key=lambda i: -scores[i])[: max(1, len(alive) // 2)]
    best = settings[alive[0]]
    tf, idf = counters[best["n_features"]]
    scale = idf.fit(counted[best["n_features"]])
    fitted = _classifier(label, best["epochs"], best["reg"]).fit(scale.transform(counted[best["n_features"]]))
    history = [{**s, "rounds": stayed[i], "weighted_f1": float(scores[i])} for i, s in enumerate(settings)]
    return Trained(PipelineModel(stages=[*front.stages, tf, scale, fitted]), history)


def score_text_clf(
    model: PipelineModel, df: DataFrame, names: dict[int, str] = CLASS_NAMES
) -> DataFrame:
    """Class name and score of the positive class for every text."""
    scored = model.transform(df).withColumn("_scores", vector_to_array("probability"))
    return scored.select(
        *df.columns,
        map_values(argmax(F.col("_scores")), names).alias("prediction"),
        F.try_element_at("_scores", F.lit(2)).alias("predicted_class"),
    )
