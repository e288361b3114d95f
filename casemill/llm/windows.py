"""Fixed windows over symbol sequences, and the anchor that stands for each window.

A window is ``width`` consecutive symbols. Its anchor is the leftmost of its grams of ``gram``
symbols with the smallest hash, so equal windows have equal anchors at the same place, and
neighbouring windows mostly share one: about two of ``width - gram + 2`` symbols start an anchor.
A window whose anchor occurs once in the corpus occurs once itself. All functions work on many
sequences laid end to end in one array; a window never crosses from one into the next.
"""

from __future__ import annotations

import numpy as np

_U = np.uint64
_PLACE = _U((1 << 24) - 1)
#: Symbols of one call; the place of a gram takes 24 bits of the key that is minimised.
LONGEST = 1 << 23

with np.errstate(over="ignore"):
    _GOLDEN = _U(0x9E3779B97F4A7C15)
    _M1, _M2 = _U(0xBF58476D1CE4E5B9), _U(0x94D049BB133111EB)


def mix(x):
    """A bijection of 64-bit numbers in which every bit depends on every other."""
    x = (x ^ (x >> _U(30))) * _M1
    x = (x ^ (x >> _U(27))) * _M2
    return x ^ (x >> _U(31))


_BYTE = mix((np.arange(256, dtype=np.uint64) + _U(1)) * _GOLDEN)


#: Odd multipliers, one for each doubling.
_TURN = mix((np.arange(64, dtype=np.uint64) + _U(101)) * _GOLDEN) | _U(1)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BLOCK = 1 << 20


def byte_symbols(data: bytes) -> np.ndarray:
    """A symbol for each byte."""
    return _BYTE[np.frombuffer(data, dtype=np.uint8)]


def word_symbols(data: bytes) -> np.ndarray:
    """A symbol for each word, that is, each run of bytes other than white space (9 to 13, and 32)."""
    out, at = [], 0
    while at < len(data):
        end = at + _BLOCK
        while end < len(data) and not _SPACE[data[end]]:
            end += 1
        part = np.frombuffer(data, dtype=np.uint8, count=min(end, len(data)) - at, offset=at)
        at = end
        inside = np.flatnonzero(~_SPACE[part])
        if not len(inside):
            continue
        new = np.concatenate([[True], np.diff(inside) > 1])
        starts = np.flatnonzero(new)
        sizes = np.diff(np.append(starts, len(inside)))
        place = np.arange(len(inside)) - np.repeat(starts, sizes)
        powers = np.cumprod(np.full(int(sizes.max()), _TURN[60]))
        out.append(mix(np.add.reduceat(_BYTE[part[inside]] * powers[place], starts) + sizes.astype(np.uint64)))
    return np.concatenate(out) if out else np.zeros(0, dtype=np.uint64)


def _spans(base, lengths):
    """Hashes of all runs of each length, by doubling: run 2L = run L and the next run L."""
    out, size, ladder = {}, 1, {1: base}
    while size * 2 <= max(lengths):
        level = ladder[size]
        n = max(len(level) - size, 0)
        ladder[size * 2] = level[:n] * _TURN[size.bit_length()] + level[size : size + n]
        size *= 2
    for want in lengths:
        at, acc, n = 0, None, max(len(base) - want + 1, 0)
        for size in sorted(ladder, reverse=True):
            if want & size:
                part = ladder[size][at : at + n]
                acc = part if acc is None else acc * _TURN[40 + size.bit_length()] + part
                at += size
        out[want] = acc
    return out


def _sliding_min(key, size):
    """Smallest of each ``size`` neighbours."""
    n, have, level = len(key) - size + 1, 1, key
    while have * 2 <= size:
        level = np.minimum(level[: len(level) - have], level[have:])
        have *= 2
    return np.minimum(level[:n], level[size - have : size - have + n])


class Anchored:
    """Runs of windows with one anchor: ``first`` and ``last`` window start, ``place`` and ``anchor``
    hash of the anchor's gram, ``sequence`` index, and ``window`` hashes by start."""

    def __init__(self, symbols, lengths, width, gram):
        """``lengths``: symbols of each sequence, in order."""
        if len(symbols) > 2 * LONGEST:
            raise ValueError("too many symbols in one call")
        lengths = np.asarray(lengths, dtype=np.int64)
        self.bounds = np.concatenate([[0], np.cumsum(lengths)])
        empty = np.zeros(0, dtype=np.int64)
        self.first = self.last = self.place = self.sequence = empty
        self.anchor = self.window = np.zeros(0, dtype=np.uint64)
        if len(symbols) < width:
            return
        hashes = _spans(symbols, [gram, width])
        grams, self.window = mix(hashes[gram]), hashes[width]
        key = (grams & ~_PLACE) | np.arange(len(grams), dtype=np.uint64)
        best = _sliding_min(key, width - gram + 1)[: len(self.window)]
        counts = np.maximum(lengths - width + 1, 0)
        used = np.flatnonzero(counts)
        counts = counts[used]
        ends = np.cumsum(counts)
        starts = np.repeat(self.bounds[used] - (ends - counts), counts) + np.arange(ends[-1] if len(ends) else 0)
        if not len(starts):
            return
        place = (best[starts] & _PLACE).astype(np.int64)
        owner = np.repeat(used, counts)
        new = np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1]) | (owner[1:] != owner[:-1])]))
        self.first, self.place, self.sequence = starts[new], place[new], owner[new]
        self.last = starts[np.concatenate([new[1:] - 1, [len(starts) - 1]])]
        self.anchor = grams[self.place]

    def context(self):
        """A hash of all symbols that the windows of each run cover."""
        with np.errstate(over="ignore"):
            span = (self.last - self.first).astype(np.uint64)
            a, b = mix(self.window[self.first]), mix(self.window[self.last] + _M1)
            return mix(a * _GOLDEN + b + span)


def anchored(sequences, width: int, gram: int, size: int = 1 << 17):
    """``Anchored`` of many sequences, in groups of about ``size`` symbols; a long one is cut into windows'
    starts of ``size`` each. Yields it with, for each of its sequences, the index and the first symbol's place."""
    group, lengths, index, places, held = [], [], [], [], 0
    for i, symbols in enumerate(sequences):
        if len(symbols) < width:
            continue
        for at in range(0, len(symbols) - width + 1, size):
            part = symbols[at : at + size + width - 1]
            group.append(part)
            lengths.append(len(part))
            index.append(i)
            places.append(at)
            held += len(part)
            if held >= size:
                yield Anchored(np.concatenate(group), lengths, width, gram), np.array(index), np.array(places)
                group, lengths, index, places, held = [], [], [], [], 0
    if group:
        yield Anchored(np.concatenate(group), lengths, width, gram), np.array(index), np.array(places)
