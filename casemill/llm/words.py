"""Words of whole batches of texts, and what a worker remembers about words.

Texts are laid end to end and cut into words as one array; equal words are found by Arrow's dictionaries; what
a tokenizer makes of a word is a run in one array, and that of a text a gather of such runs.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa

#: Words that a worker remembers, unless it is told another number; beyond, the half used least is let go.
REMEMBERED = 400_000

__all__ = ["WordStore", "bytes_list", "distinct_words", "ragged", "word_starts"]


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Positions of all runs, one after the other."""
    ends = np.cumsum(lengths)
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)


def word_starts(data: np.ndarray, texts: np.ndarray) -> np.ndarray:
    """Where words start in texts that begin at ``texts``, none of them empty: there, and at single spaces between two
    characters that are surely no white space."""
    at = np.flatnonzero(data == 32)
    first = np.zeros(len(data) + 1, dtype=bool)
    first[texts] = first[-1] = True
    at = at[~first[at] & ~first[at + 1]]
    blank = np.zeros(256, dtype=bool)
    blank[[*range(9, 14), *range(28, 33)]] = True
    after, before = data[at + 1], data[at - 1]
    # Other white space has two bytes from 0xC2, or three from 0xE1 to 0xE3.
    two, three = data[at - 2] == 0xC2, (data[at - 3] >= 0xE1) & (data[at - 3] <= 0xE3)
    ok = ~blank[after] & ~blank[before] & (after != 0xC2) & ~((after >= 0xE1) & (after <= 0xE3)) & ~((before >= 0x80) & (two | three))
    return np.sort(np.concatenate([texts, at[ok]]))


def bytes_list(column: pa.Array) -> list[bytes]:
    """As ``to_pylist``, without a scalar for each."""
    return column.to_numpy(zero_copy_only=False).tolist()


def distinct_words(data: bytes, starts: np.ndarray) -> tuple[list[bytes], np.ndarray]:
    """The distinct words among those that start at ``starts``, each as long as to the next, and which one each is."""
    offsets = np.append(starts, len(data)).astype(np.int64)
    column = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data)])
    encoded = column.dictionary_encode()
    return bytes_list(encoded.dictionary), encoded.indices.to_numpy()


class WordStore:
    """For each word remembered a run of ``values``: its ids."""

    def __init__(self, fixed: dict[bytes, list[int]] | None = None, most: int = REMEMBERED):
        self.fixed, self.most = fixed or {}, most
        self.known: dict[bytes, int] = {}
        self.starts, self.lengths, self.uses = (np.zeros(0, dtype=np.int64) for _ in range(3))
        self.values = np.zeros(0, dtype=np.uint32)
        self.add(list(self.fixed), [len(v) for v in self.fixed.values()], np.array(sum(self.fixed.values(), []), dtype=np.uint32))

    def add(self, words: list[bytes], lengths, values: np.ndarray) -> None:
        lengths = np.asarray(lengths, dtype=np.int64)
        self.known.update(zip(words, range(len(self.starts), len(self.starts) + len(words))))
        self.starts = np.concatenate([self.starts, len(self.values) + np.cumsum(lengths) - lengths])
        self.lengths = np.concatenate([self.lengths, lengths])
        self.uses = np.concatenate([self.uses, np.zeros(len(words), dtype=np.int64)])
        self.values = np.concatenate([self.values, values.astype(np.uint32)])

    def shrink(self) -> None:
        """If there are too many, keep the fixed words and, of the others, the half of ``most`` used most that were used again."""
        if len(self.known) <= self.most:
            return
        self.uses[: len(self.fixed)] = np.iinfo(np.int64).max
        used = np.argsort(-self.uses, kind="stable")[: len(self.fixed) + self.most // 2]
        used = np.sort(used[self.uses[used] > 1])
        words, lengths = list(self.known), self.lengths[used]
        self.values = self.values[ragged(self.starts[used], lengths)]
        self.known = {words[i]: n for n, i in enumerate(used.tolist())}
        self.starts, self.lengths = np.cumsum(lengths) - lengths, lengths
        self.uses = np.zeros(len(used), dtype=np.int64)

    def places(self, words: list[bytes], learn: Callable[[list[bytes]], tuple]) -> np.ndarray:
        """Where distinct words are kept; ``learn`` gives lengths and values of those that are new."""
        found = list(map(self.known.get, words))
        if None in found:
            new = [i for i, x in enumerate(found) if x is None]
            fresh = [words[i] for i in new]
            first = len(self.starts)
            self.add(fresh, *learn(fresh))
            for n, i in enumerate(new, first):
                found[i] = n
        at = np.array(found, dtype=np.int64)
        self.uses[at] += 1
        return at

    def runs(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lengths and values of words by their places."""
        lengths = self.lengths[at]
        return lengths, self.values[ragged(self.starts[at], lengths)]
