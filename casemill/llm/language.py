"""Language identification in two steps: the family first, then the languages within it.

Both steps are linear support vector machines, one against one, over hashed byte n-grams. The machines
are fitted on a bounded sample of labelled rows; every text is then scored whole.
"""

from __future__ import annotations

from itertools import combinations
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casemill.llm.common import map_chunks

# Families of languages. A language that is not listed is a family of its own.
FAMILIES = {
    "germanic": ("de", "en", "nl", "sv", "da", "no", "is", "af"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca", "gl"),
    "slavic": ("ru", "uk", "pl", "cs", "sk", "bg", "sr", "hr", "sl"),
    "uralic": ("fi", "et", "hu"),
    "turkic": ("tr", "az", "kk", "uz"),
}
UNKNOWN = "und"
BUCKETS = 4096
#: Labelled rows that are fitted on: for each language at most and, of many languages, at least; and about so many in all.
SAMPLE, FEWEST, ROWS = 500, 20, 12_000
#: Languages of no listed family that are families of their own; more are put together with those most like them.
ALONE = 12
#: Rows of a family that tell it from others.
FAMILY_ROWS = 600

_LETTERS = bytes(b if b > 127 or chr(b).isalpha() else 32 for b in range(256))


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def features(texts: list[str]) -> np.ndarray:
    """Roots of the counts of hashed 1- to 4-grams of lower-case bytes, as unit vectors; only letters and
    the ends of words count."""
    data = [b" ".join(t.lower().encode().translate(_LETTERS).split()) + b" " for t in texts]
    sizes = np.array([len(d) for d in data])
    stream = np.frombuffer(b"".join([*data, b"   "]), dtype=np.uint8).astype(np.uint32)
    n = int(sizes.sum())
    owner = np.repeat(np.arange(len(texts)) * BUCKETS, sizes)
    counts = np.zeros(len(texts) * BUCKETS)
    code = np.zeros(n, dtype=np.uint32)
    with np.errstate(over="ignore"):
        for k in range(4):
            code = code * np.uint32(0x01000193) + stream[k : k + n] + np.uint32(k + 1)
            mixed = (code ^ (code >> np.uint32(15))) * np.uint32(0x85EBCA6B)
            counts += np.bincount(owner + (mixed >> np.uint32(20)), minlength=len(counts))
    roots = np.sqrt(counts).reshape(len(texts), BUCKETS).astype(np.float32)
    return roots / np.maximum(np.linalg.norm(roots, axis=1, keepdims=True), 1e-9)


def svm(x: np.ndarray, y: np.ndarray, c: float = 50.0, rounds: int = 150) -> tuple[np.ndarray, float]:
    """Linear machine with squared hinge loss, both classes weighted alike; accelerated gradient steps.

    The steps are taken on the rows' coefficients, through their products with one another: a machine is a sum of
    its rows, and there are fewer rows than features."""
    side = np.where(y, 1.0, -1.0).astype(np.float32)
    weight = np.where(y, 0.5 / max(y.sum(), 1), 0.5 / max((~y).sum(), 1)).astype(np.float32) * c
    products = x @ x.T
    w = look = np.zeros(len(x), dtype=np.float32)
    b = look_b = 0.0
    rate = 1.0 / (1.0 + 4.0 * c)  # unit vectors and a constant: the curvature is at most 1 + 2 * 2c
    for t in range(1, rounds + 1):
        slack = np.maximum(0, 1 - side * (products @ look + look_b)) * side * weight
        new, new_b = look + rate * (2 * slack - look), look_b + rate * 2 * float(slack.sum())
        push = (t - 1) / (t + 2)
        look, look_b = (new + push * (new - w)).astype(np.float32), new_b + push * (new_b - b)
        w, b = new, new_b
    return (w @ x).astype(np.float32), float(b)


def family_of(x: np.ndarray, labels: np.ndarray, listed: dict) -> dict[str, str]:
    """The family of each language. Those that ``listed`` lacks stand alone, or, if there are many, a language and those
    whose mean vectors are nearest make a family of about the root of their number: so machines stay few."""
    of = {lang: f for f, ls in listed.items() for lang in ls}
    names = sorted(set(labels))
    left = [n for n in names if n not in of]
    if len(left) <= ALONE:
        return {n: of.get(n, n) for n in names}
    size = int(np.ceil(len(left) ** 0.5))
    means = np.array([x[labels == n].mean(axis=0) for n in left])
    means /= np.maximum(np.linalg.norm(means, axis=1, keepdims=True), 1e-9)
    open_, out = np.ones(len(left), dtype=bool), {n: of[n] for n in names if n in of}
    for i, name in enumerate(left):
        if open_[i]:
            near = np.argsort(-np.where(open_, means @ means[i], -2), kind="stable")[: min(size, int(open_.sum()))]
            open_[near] = False
            out.update((left[k], f"like {name}") for k in near)
    return out


class Machines(NamedTuple):
    """One-against-one machines between ``names``; ``pairs[k]`` are the names' places for row ``k``."""

    names: list[str]
    pairs: list[tuple[int, int]]
    weights: np.ndarray
    shifts: np.ndarray

    @classmethod
    def fit(cls, x, labels: np.ndarray, names: list[str]) -> Machines:
        pairs = list(combinations(range(len(names)), 2))
        fitted = []
        for i, j in pairs:
            rows = (labels == names[i]) | (labels == names[j])
            fitted.append(svm(x[rows], labels[rows] == names[i]))
        weights = np.array([w for w, _ in fitted], dtype=np.float32).reshape(len(pairs), x.shape[1])
        return cls(names, pairs, weights, np.array([b for _, b in fitted]))

    def shares(self, x) -> np.ndarray:
        """A share for each name, from the margins against all others; they sum to 1."""
        out = np.ones((len(x), len(self.names)))
        if self.pairs:
            for (i, j), margin in zip(self.pairs, (x @ self.weights.T + self.shifts).T):
                p = 1 / (1 + np.exp(-4 * np.clip(margin, -8, 8)))
                out[:, i] *= p
                out[:, j] *= 1 - p
        return out / out.sum(axis=1, keepdims=True)


def _evenly(rows: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """At most ``FAMILY_ROWS`` rows of a family, as many of each of its languages."""
    names = sorted(set(labels[rows]))
    each = max(1, FAMILY_ROWS // len(names)) if len(rows) > FAMILY_ROWS else len(rows)
    return np.concatenate([rows[labels[rows] == n][:each] for n in names])


class LanguageModel(NamedTuple):
    families: Machines
    languages: dict[str, Machines]

    @classmethod
    def fit(cls, x: np.ndarray, labels: np.ndarray, families=None) -> LanguageModel | None:
        if not len(labels):
            return None
        of = family_of(x, labels, families or FAMILIES)
        own = np.array([of[lang] for lang in labels], dtype=object)
        inside = {f: Machines.fit(x[own == f], labels[own == f], sorted(set(labels[own == f]))) for f in sorted(set(own))}
        some = np.concatenate([_evenly(np.flatnonzero(own == f), labels) for f in sorted(inside)])
        return cls(Machines.fit(x[some], own[some], sorted(inside)), inside)

    def predict(self, x: np.ndarray) -> tuple[list[str], np.ndarray]:
        family = self.families.shares(x)
        best = family.argmax(axis=1)
        names, score = np.empty(len(x), dtype=object), family.max(axis=1)
        for f in np.unique(best):
            rows = best == f
            machines = self.languages[self.families.names[f]]
            shares = machines.shares(x[rows])
            names[rows] = [machines.names[k] for k in shares.argmax(axis=1)]
            score[rows] *= shares.max(axis=1)
        return names.tolist(), np.clip(score, 0, 1)


def fit_language(
    df: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", sample: int = SAMPLE, families=None
) -> LanguageModel | None:
    """Fit on at most ``sample`` rows of each language; of many languages on fewer of each, ``ROWS`` in all, but
    ``FEWEST`` at least. No language is left out.

    Rows without text or language are left out, and repeated rows count once. The sample is the rows with the smallest
    hashes of key and text, so it is the same whatever the partitions. None if no row has a language.
    """
    rows = df.filter(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(
        F.col(text).alias("_text"), F.col(lang).alias("_lang"), F.xxhash64(F.col(key), F.lit(7), F.col(text)).alias("_order")
    )
    counts = rows.groupBy("_lang").agg(F.approx_count_distinct("_order").alias("n")).collect()
    if not counts:
        return None
    sample = min(sample, max(FEWEST, ROWS // len(counts)))
    # Hashes are even, so a share of their range holds that share of the rows, give or take a little.
    share = {r["_lang"]: min(1.0, 1.25 * (sample + 6 * sample**0.5) / r["n"]) for r in counts}
    limits = [(name, int(s * 2**64) - 2**63 - (s == 1.0)) for name, s in share.items()]
    limits = df.sparkSession.createDataFrame(limits, "_lang string, _limit long")
    # A row for each language bounds the broadcast; copies of a row become one before they move.
    chosen = rows.join(F.broadcast(limits), "_lang").filter(F.col("_order") <= F.col("_limit"))
    chosen = chosen.groupBy("_lang", "_order").agg(F.first("_text").alias("_text"))

    def make():
        def work(batch):
            texts = batch.column("_text").to_pylist()
            vectors = [v.tobytes() for v in features(texts).astype(np.float16)]
            return {"_lang": batch.column("_lang"), "_order": batch.column("_order"), "_vector": vectors}

        return work

    picked = sorted(map(tuple, map_chunks(chosen, "_text", make, "_lang string, _order long, _vector binary").collect()))
    seen: dict[str, int] = {}
    kept = [r for r in picked if seen.setdefault(r[0], 0) < sample and not seen.update({r[0]: seen[r[0]] + 1})]
    x = np.array([np.frombuffer(v, dtype=np.float16) for _, _, v in kept]).astype(np.float32)
    return LanguageModel.fit(x, np.array([name for name, _, _ in kept], dtype=object), families)


def identify_language(df: DataFrame, model: LanguageModel | None, text: str = "text") -> DataFrame:
    """All columns of ``df`` with ``lang_pred`` and ``score`` (0 to 1: the product of both steps' shares).

    A text that is null or has no letter is ``und`` with score 0, and so is every text if ``model`` is None.
    Columns of these names that ``df`` has are replaced. Rows are scored one by one, so repeated rows and
    other nulls change nothing. No shuffle.
    """
    rest = df.drop("lang_pred", "score")
    names, fields = rest.columns, ", ".join(f"`{n}` {t}" for n, t in rest.dtypes)

    def make():
        def work(batch):
            texts = pc.fill_null(batch.column(text), "").to_pylist()
            real = np.array([model is not None and has_letter(t) for t in texts], dtype=bool)
            found, scores = np.full(len(texts), UNKNOWN, dtype=object), np.zeros(len(texts))
            if real.any():
                found[real], scores[real] = model.predict(features([t for t, r in zip(texts, real) if r]))
            return {n: batch.column(n) for n in names} | {"lang_pred": pa.array(found.tolist(), pa.string()), "score": scores}

        return work

    return map_chunks(rest, text, make, f"{fields}, lang_pred string, score double")
