"""Logistic regression in one run whose every epoch is kept.

An epoch is two passes over the stored features: one sums the gradient, one the loss at several lengths of the step.
Sums are made in each task and then in groups of tasks, so the driver adds up few rows, each as long as the weights. An epoch's weights
are bounded by the number of features, whatever the number of rows; all epochs are scored in one pass.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import keyword_only
from pyspark.ml import Transformer
from pyspark.ml.functions import array_to_vector
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame, functions as F, types as T

#: Step lengths that one pass tries; sums of this many tasks are added up by one task.
STEPS = tuple(2.0**-k for k in range(-2, 9))
GROUP = 32
#: Earlier steps that shape the next one.
MEMORY = 8


def sparse_columns(features: str):
    """Positions and values of a sparse vector column, as ``_at`` and ``_x``."""
    plain = F.unwrap_udt(features)
    return plain["indices"].alias("_at"), plain["values"].alias("_x")


class _Rows:
    """Sparse rows of a batch: row number, position and value of each entry, and the classes."""

    def __init__(self, at: pa.Array, x: pa.Array, label: pa.Array | None = None):
        at, x = (a.combine_chunks() if isinstance(a, pa.ChunkedArray) else a for a in (at, x))
        sizes = np.diff(at.offsets.to_numpy())
        self.n = len(at)
        self.row = np.repeat(np.arange(self.n), sizes)
        self.at, self.x = at.flatten().to_numpy(), x.flatten().to_numpy()
        self.label = None if label is None else label.to_numpy().astype(np.int64)

    def dot(self, w: np.ndarray) -> np.ndarray:
        """Rows times weights (a row for each class, the intercept last)."""
        each = [np.bincount(self.row, self.x * v[self.at], self.n) + v[-1] for v in w]
        return np.stack(each, axis=1) if each else np.zeros((self.n, 0))

    def spread(self, r: np.ndarray, size: int) -> np.ndarray:
        """Sums of the rows, weighted by the columns of ``r``."""
        return np.stack([np.append(np.bincount(self.at, self.x * c[self.row], size - 1), c.sum()) for c in r.T])


def _log_shares(z: np.ndarray) -> np.ndarray:
    """Log of each class's share. A single score is that of the second of two classes; the first has 0."""
    if z.shape[-1] == 1:
        z = np.concatenate([np.zeros_like(z), z], axis=-1)
    z -= z.max(axis=-1, keepdims=True)
    return z - np.log(np.exp(z).sum(axis=-1, keepdims=True))


def _rows_of(classes: int) -> int:
    return 1 if classes == 2 else classes


def _total(rows: DataFrame, of_rows: Callable[[_Rows], np.ndarray], length: int) -> np.ndarray:
    """The sum of ``of_rows`` over all rows: by batch, by task, by group of tasks, then here."""

    def as_batch(total):
        return pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["total"])

    def sums(batches):
        total = np.zeros(length)
        for b in batches:
            if b.num_rows:
                total += of_rows(_Rows(b.column("_at"), b.column("_x"), b.column("_label")))
        yield as_batch(total)

    def added(batches):
        total = np.zeros(length)
        for b in batches:
            for part in b.column("total").to_pylist():
                total += np.frombuffer(part)
        yield as_batch(total)

    parts, tasks = rows.mapInArrow(sums, "total binary"), rows.rdd.getNumPartitions()
    while tasks > GROUP:
        tasks = math.ceil(tasks / GROUP)
        parts = parts.repartition(tasks).mapInArrow(added, "total binary")
    return sum((np.frombuffer(r["total"]) for r in parts.collect()), np.zeros(length))  # of GROUP tasks at most


def _direction(gradient: np.ndarray, past: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The step that the curvature along the ``past`` steps suggests (limited-memory BFGS)."""
    q, used = gradient.copy(), []
    for s, y in reversed(past):
        a = (s @ q) / (s @ y)
        used.append(a)
        q -= a * y
    if past:
        s, y = past[-1]
        q *= (s @ y) / (y @ y)
    for (s, y), a in zip(past, reversed(used)):
        q += (a - (y @ q) / (s @ y)) * s
    return -q


@dataclass
class Epoch:
    """What the run holds after an epoch: mean loss with its penalty, and weights for the features as they are."""

    number: int
    loss: float
    weights: np.ndarray


def train_epochs(rows: DataFrame, epochs: int, size: int, reg: float = 0.01) -> list[Epoch]:
    """Train on ``_label`` (0, 1, …), ``_at`` and ``_x`` (positions and values, below ``size``); all epochs of one run.

    The loss is the mean log loss plus ``reg`` / 2 times the squared weights of features scaled to a spread of 1; an
    epoch never makes it greater. Two classes have one row of weights. ``rows`` should be stored: each epoch reads them twice.
    A run that no step improves goes on with the weights it has. One class alone, or no rows, is an error.
    """
    classes = (rows.agg(F.max("_label")).first()[0] or 0) + 1
    if classes < 2:
        raise ValueError("training needs rows of two classes")
    k, width = _rows_of(classes), size + 1

    def moments(r):
        one = np.ones((r.n, 1))
        squares = np.bincount(r.at, r.x * r.x, size)
        return np.concatenate([r.spread(one, width)[0], squares, np.bincount(r.label, minlength=classes)])

    sums = _total(rows, moments, width + size + classes)
    n, seen = sums[size], sums[width + size :]
    spread = np.sqrt(np.maximum(sums[width : width + size] - sums[:size] ** 2 / n, 0) / max(n - 1, 1))
    scale = np.append(np.divide(1.0, spread, out=np.zeros(size), where=spread > 0), 1.0)
    penalty = np.append(np.full(size, reg), 0.0)

    def gradient(w):
        applied = w * scale

        def of_rows(r):
            share = np.exp(_log_shares(r.dot(applied)))
            share[np.arange(r.n), r.label] -= 1
            return r.spread(share[:, -k:], width).ravel()

        return (_total(rows, of_rows, k * width).reshape(k, width) * scale / n + penalty * w).ravel()

    def losses(w, step, lengths):
        here, there = w * scale, step.reshape(k, width) * scale

        def of_rows(r):
            a, b = r.dot(here), r.dot(there)
            return np.array([-_log_shares(a + t * b)[np.arange(r.n), r.label].sum() for t in lengths])

        sizes = [(penalty * (w + t * step.reshape(k, width)) ** 2).sum() / 2 for t in lengths]
        return _total(rows, of_rows, len(lengths)) / n + sizes

    w = np.zeros((k, width))
    share = np.log(np.maximum(seen, 0.5) / n)
    w[:, -1] = share[1] - share[0] if k == 1 else share
    loss, out, past, last = math.inf, [], [], None
    for number in range(1, epochs + 1):
        if last is None or last[0] is not None:
            slope = gradient(w)
            if last is not None and last[0] @ (slope - last[1]) > 0:
                past = [*past, (last[0], slope - last[1])][-MEMORY:]
            step = _direction(slope, past)
            lengths = (0.0, *STEPS)
            tried = losses(w, step, lengths)
            best = int(np.argmin(np.where(np.isfinite(tried), tried, math.inf)))
            loss = min(loss, float(tried[best]))
            if best:
                last = step * lengths[best], slope
            elif past:  # try the plain slope next
                past, last = [], None
            else:
                last = None, slope
            w = w + lengths[best] * step.reshape(k, width)
        out.append(Epoch(number, loss, w * scale))
    return out


def epoch_predictions(rows: DataFrame, epochs: list[Epoch]) -> DataFrame:
    """``_label`` and the class that each epoch predicts, in one pass over ``_label``, ``_at`` and ``_x``: ``epoch``, ``label``, ``prediction``."""
    weights, numbers = [e.weights for e in epochs], [e.number for e in epochs]

    def predict(batches):
        for b in batches:
            r = _Rows(b.column("_at"), b.column("_x"))
            said = [_log_shares(r.dot(w)).argmax(axis=1) for w in weights]
            columns = np.repeat(numbers, r.n), np.tile(b.column("_label").to_numpy(), len(numbers)), np.concatenate(said)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32()) for c in columns], names=["epoch", "label", "prediction"])

    return rows.mapInArrow(predict, "epoch int, label int, prediction int")


class EpochModel(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """Shares of the classes (``probability``) for a column of sparse vectors, by the weights of one epoch."""

    featuresCol = Param(Params._dummy(), "featuresCol", "sparse vectors", TypeConverters.toString)
    probabilityCol = Param(Params._dummy(), "probabilityCol", "shares of the classes", TypeConverters.toString)
    classes = Param(Params._dummy(), "classes", "number of classes", TypeConverters.toInt)
    weights = Param(Params._dummy(), "weights", "weights of each class (of two, of the second), row by row, the intercept last", TypeConverters.toListFloat)

    @keyword_only
    def __init__(self, *, featuresCol="features", probabilityCol="probability", classes=2, weights=()):
        super().__init__()
        self._set(**{k: list(v) if k == "weights" else v for k, v in self._input_kwargs.items()})
        self._setDefault(featuresCol="features", probabilityCol="probability", classes=2, weights=[])

    @classmethod
    def of(cls, epoch: Epoch) -> EpochModel:
        return cls(classes=max(2, len(epoch.weights)), weights=epoch.weights.ravel().tolist())

    def _transform(self, dataset: DataFrame) -> DataFrame:
        w = np.array(self.getOrDefault("weights")).reshape(_rows_of(self.getOrDefault("classes")), -1)

        @F.pandas_udf(T.ArrayType(T.DoubleType()))
        def shares(rows: pd.DataFrame) -> pd.Series:
            at, x = (pa.array(rows[c], pa.list_(kind)) for c, kind in (("_at", pa.int32()), ("_x", pa.float64())))
            return pd.Series(list(np.exp(_log_shares(_Rows(at, x).dot(w)))))

        entries = F.struct(*sparse_columns(self.getOrDefault("featuresCol")))
        return dataset.withColumn(self.getOrDefault("probabilityCol"), array_to_vector(shares(entries)))
