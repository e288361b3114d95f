"""Text quality: random Fourier features over document statistics, ridge scores, isotonic calibration.

The features stand for a Gaussian kernel. The normal equations of the ridge are sums over rows, so
each task adds up its own and only sums of fixed size are sent on. The calibration needs counts of
score bins alone.
"""

from __future__ import annotations

from collections import Counter
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casemill.llm.common import map_chunks, store

FEATURES, RIDGE, SEED, BINS = 256, 1e-3, 17, 2000
THRESHOLD = 0.3

_GROUPS = {
    "lower": lambda c: "a" <= c <= "z",
    "upper": lambda c: "A" <= c <= "Z",
    "digit": lambda c: "0" <= c <= "9",
    "space": lambda c: c in " \t\r\x0b\x0c",
    "line": lambda c: c == "\n",
    "stop": lambda c: c in ".?!",
    "pause": lambda c: c in ",;:",
    "quote": lambda c: c in "\"'()[]{}<>",
    "symbol": lambda c: c in "#$%&*+-/=@\\^_`|~",
    "control": lambda c: c < " " or c == "\x7f",
    "other": lambda c: c > "\x7f",
}
_MEMBERS = np.array([[g(chr(b)) for g in _GROUPS.values()] for b in range(256)], dtype=np.float64)
STATISTICS = [*_GROUPS, "bytes", "words", "word_size", "word_spread", "long_words", "new_words", "new_pairs", "top_word", "new_lines", "line_size", "entropy"]


def statistics(texts: list[bytes]) -> np.ndarray:
    """A row of ``STATISTICS`` for each text; an empty text gives zeros."""
    out = np.zeros((len(texts), len(STATISTICS)))
    for row, data in zip(out, texts):
        if not data:
            continue
        counts = np.bincount(np.frombuffer(data, dtype=np.uint8), minlength=256)
        share = counts / len(data)
        row[: len(_GROUPS)] = share @ _MEMBERS
        words, lines = data.split(), [x for x in data.split(b"\n") if x.strip()]
        some = share[counts > 0]
        rest = [np.log1p(len(data)), np.log1p(len(words)), 0, 0, 0, 0, 0, 0, 0, 0, -(some * np.log2(some)).sum()]
        if words:
            sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
            tally = Counter(words)
            pairs = max(len(words) - 1, 1)
            rest[2:8] = [
                np.log1p(sizes.mean()),
                np.log1p(sizes.std()),
                (sizes > 15).mean(),
                len(tally) / len(words),
                len(set(zip(words, words[1:]))) / pairs,
                max(tally.values()) / len(words),
            ]
            rest[8:10] = [len(set(lines)) / len(lines), np.log1p(len(data) / len(lines))]
        row[len(_GROUPS) :] = rest
    return out


class QualityModel(NamedTuple):
    """``centre`` and ``scale`` of the statistics, the waves of the features, ridge weights, and the
    calibration as a rising line through (``raw``, ``level``)."""

    centre: np.ndarray
    scale: np.ndarray
    waves: np.ndarray
    phases: np.ndarray
    weights: np.ndarray
    raw: np.ndarray
    level: np.ndarray

    def features(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.centre) / self.scale, -6, 6)
        waves = np.sqrt(2 / len(self.phases)) * np.cos(z @ self.waves + self.phases)
        return np.column_stack([waves, np.ones(len(x))])

    def ridge(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        if not len(self.raw):
            return np.full(len(x), 0.5)
        return np.clip(np.interp(self.ridge(x), self.raw, self.level), 0, 1)


def isotonic(raw: np.ndarray, hits: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool neighbours whose means fall: places and means of the blocks, by rising ``raw``."""
    blocks: list[list[float]] = []
    for r, h, n in zip(raw, hits, counts):
        blocks.append([r * n, h, n])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last)]
    return np.array([b[0] / b[2] for b in blocks]), np.array([b[1] / b[2] for b in blocks])


def document_statistics(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key`` and ``stats``, an array in the order of ``STATISTICS``, for each row; a null text is empty."""
    kind = dict(df.dtypes)[key]

    def make():
        def work(batch):
            texts = pc.fill_null(batch.column("_text").cast(pa.binary()), b"").to_pylist()
            return {"_key": batch.column("_key"), "stats": list(statistics(texts))}

        return work

    rows = df.selectExpr(f"`{key}` AS _key", f"`{text}` AS _text")
    return map_chunks(rows, "_text", make, f"_key {kind}, stats array<double>").withColumnRenamed("_key", key)


def _matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(len(column), -1)


def _summed(df: DataFrame, of_batch, width: int) -> np.ndarray:
    """Sum of fixed-size arrays over all batches: by task, then over few tasks, then here."""

    def total(batches):
        out = np.zeros(width)
        for batch in batches:
            out += of_batch(batch)
        yield pa.RecordBatch.from_arrays([pa.array([out.tobytes()])], names=["sum"])

    def again(batches):
        out = np.zeros(width)
        for batch in batches:
            for data in batch.column(0).to_pylist():
                out += np.frombuffer(data)
        yield pa.RecordBatch.from_arrays([pa.array([out.tobytes()])], names=["sum"])

    sums = df.mapInArrow(total, "sum binary").repartition(32).mapInArrow(again, "sum binary").coalesce(4).mapInArrow(again, "sum binary")
    return sum((np.frombuffer(r[0]) for r in sums.collect()), np.zeros(width))


def fit_quality(stats: DataFrame, labels: DataFrame, key: str = "doc_id", label: str = "quality", features: int = FEATURES) -> QualityModel:
    """Fit on the rows of ``stats`` that ``labels`` marks 0 or 1; other labels and null keys are left out.

    A fifth of these rows, by a hash of the key, is for the calibration. A key that is labelled or
    stored more than once counts as often. Without rows of both labels every score is 0.5.
    """
    marks = labels.filter(F.col(label).isin(0, 1)).select(key, F.col(label).cast("double").alias("_y"))
    rows = stats.join(marks, key).select("stats", "_y", (F.pmod(F.xxhash64(key), F.lit(5)) == 0).alias("_calibrate"))
    rows = store(rows, "quality")
    d = len(STATISTICS)

    def moments(batch):
        x = _matrix(batch.column("stats")) if len(batch) else np.zeros((0, d))
        return np.concatenate([x.sum(axis=0), (x * x).sum(axis=0), [len(x), np.asarray(batch.column("_y")).sum()]])

    sums = _summed(rows.select("stats", "_y"), moments, 2 * d + 2)
    n, ones = sums[-2:]
    centre = sums[:d] / max(n, 1)
    scale = np.sqrt(np.maximum(sums[d : 2 * d] / max(n, 1) - centre**2, 0))
    scale = np.where(scale > 1e-9, scale, 1.0)
    rng = np.random.default_rng(SEED)
    # Rows lie about sqrt(2 d) apart once centred and scaled; the kernel is half as wide.
    waves = rng.normal(size=(d, features)) / (0.5 * np.sqrt(2 * d))
    empty = np.zeros(0)
    model = QualityModel(centre, scale, waves, rng.uniform(0, 2 * np.pi, features), np.zeros(features + 1), empty, empty)
    if not 0 < ones < n:
        return model
    p = features + 1

    def equations(batch):
        if not len(batch):
            return 0.0
        z = model.features(_matrix(batch.column("stats")))
        return np.concatenate([(z.T @ z).ravel(), z.T @ np.asarray(batch.column("_y"))])

    sums = _summed(rows.filter(~F.col("_calibrate")).select("stats", "_y"), equations, p * p + p)
    gram = sums[: p * p].reshape(p, p)
    ridge = RIDGE * max(gram[-1, -1], 1.0) * np.append(np.ones(features), 1e-6) / features
    model = model._replace(weights=np.linalg.solve(gram + np.diag(ridge) + 1e-12 * np.eye(p), sums[p * p :]))

    def binned(batches):
        for batch in batches:
            if len(batch):
                raw = np.clip(model.ridge(_matrix(batch.column("stats"))), -0.5, 1.5)
                yield pa.RecordBatch.from_arrays([pa.array(np.round((raw + 0.5) * (BINS / 2)).astype(np.int64)), batch.column("_y")], names=["bin", "y"])

    bins = rows.filter("_calibrate").select("stats", "_y").mapInArrow(binned, "bin long, y double")
    table = np.array(sorted(map(tuple, bins.groupBy("bin").agg(F.sum("y"), F.count("y")).collect())), dtype=np.float64)
    if not len(table):  # too few rows for a part of their own: the ridge score as it is
        return model._replace(raw=np.array([0.0, 1.0]), level=np.array([0.0, 1.0]))
    raw, level = isotonic(table[:, 0] * (2 / BINS) - 0.5, table[:, 1], table[:, 2])
    return model._replace(raw=raw, level=level)


def score_statistics(stats: DataFrame, model: QualityModel) -> DataFrame:
    """``score`` in place of ``stats``; other columns stay."""
    rest = [(n, t) for n, t in stats.dtypes if n not in ("stats", "score")]

    def work(batches):
        for batch in batches:
            score = model.score(_matrix(batch.column("stats"))) if len(batch) else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n, _ in rest), pa.array(score)], names=[*(n for n, _ in rest), "score"])

    return stats.mapInArrow(work, ", ".join(f"`{n}` {t}" for n, t in [*rest, ("score", "double")]))


def score_quality(df: DataFrame, model: QualityModel, text: str = "text", column: str = "score") -> DataFrame:
    """All columns of ``df`` with ``column``: how likely label 1 is, 0 to 1, from the whole text.

    A null text counts as empty, and an empty text has a score like any other. Rows are scored one by one,
    so repeated rows and nulls elsewhere change nothing; a column of that name is replaced. No shuffle.
    """
    rest = df.drop(column)
    names, fields = rest.columns, ", ".join(f"`{n}` {t}" for n, t in rest.dtypes)

    def make():
        def work(batch):
            texts = pc.fill_null(batch.column(text).cast(pa.binary()), b"").to_pylist()
            return {n: batch.column(n) for n in names} | {column: model.score(statistics(texts))}

        return work

    return map_chunks(rest, text, make, f"{fields}, `{column}` double")
