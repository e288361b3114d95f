"""Arrow columns of vectors as matrices, and the one cosine that all operators on vectors use."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of an array column whose lengths are equal, as doubles."""
    return np.asarray(column.flatten(), dtype=np.float64).reshape(len(column), -1)


def scaled(x: np.ndarray) -> np.ndarray:
    """Each row over its largest component: no square over- or underflows, and no angle changes."""
    return x / np.abs(x).max(axis=1, keepdims=True)


def unit(x: np.ndarray) -> np.ndarray:
    x = scaled(x)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosine of each row of ``a`` with the same row of ``b``; the value depends on the two vectors alone."""
    return (a * b).sum(axis=1) / np.sqrt((a * a).sum(axis=1) * (b * b).sum(axis=1))
