"""Remove bytes that repeat, by prefix-free parsing.

The rolling hash of a text's short grams triggers at the smallest in each stretch. Between triggers lie
phrases that overlap by one window, so no phrase that matters is the beginning of another. The parse of the
corpus is its sequence of phrases; equal phrases are one entry of the dictionary, at its first place. The
suffixes of the dictionary, sorted to the depth of a window, and the first places of the phrases in the
parse give the corpus order of equal windows: most of a repetitive corpus is settled by the parse alone,
and only phrases that share a trigger are sorted.
"""

from __future__ import annotations

from hashlib import sha256

import numpy as np
from pyspark.sql import DataFrame

from casemill.llm.repeats import marked, numbered, removed, repeated_ranges
from casemill.llm.windows import byte_symbols

#: Phrases of one trigger that a shard takes together.
HOT = 4000


def suffix_ranks(data: np.ndarray, depth: int) -> np.ndarray:
    """Ranks of all suffixes by their first ``depth`` bytes, by doubling; equal beginnings have equal ranks.
    A suffix that is shorter counts as if zeros followed."""
    rank, size = data.astype(np.int64), 1
    if depth >= 4:  # four bytes are a number already
        padded = np.concatenate([rank, np.zeros(3, dtype=np.int64)])
        rank = (padded[:-3] << 24) | (padded[1:-2] << 16) | (padded[2:-1] << 8) | padded[3:]
        size = 4
        rank = np.unique(rank, return_inverse=True)[1]
    while size < depth:
        step = min(size, depth - size)
        after = np.zeros_like(rank)
        after[: len(rank) - step] = rank[step:] + 1
        rank = np.unique(rank * (len(rank) + 2) + after, return_inverse=True)[1]
        size += step
    return rank


def sort_suffixes(width: int):
    """The method of a shard: sort the suffixes of its phrases; of equal windows, all but the first in corpus order repeat."""

    def resolve(items, seen):
        sizes = np.array([len(x[5]) for x in items])
        counts = sizes - width + 1
        begins = np.cumsum(sizes) - sizes
        ranks = suffix_ranks(np.frombuffer(b"".join(x[5] for x in items), dtype=np.uint8), width)
        owner = np.repeat(np.arange(len(items)), counts)
        inner = np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)
        doc, copy, first = (np.array([x[k] for x in items], dtype=np.int64) for k in (1, 2, 3))
        rank, place = ranks[begins[owner] + inner], first[owner] + inner
        order = np.lexsort((place, copy[owner], doc[owner], rank))
        rank, owner, inner, place = rank[order], owner[order], inner[order], place[order]
        new = np.concatenate([[True], rank[1:] != rank[:-1]])
        head = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
        twin = (doc[owner] == doc[owner[head]]) & (copy[owner] == copy[owner[head]]) & (place == place[head])
        repeat = ~twin
        if seen:
            firsts = np.flatnonzero(new)
            known = [items[owner[j]][5][inner[j] : inner[j] + width] in seen for j in firsts]
            repeat |= np.repeat(known, np.diff(np.append(firsts, len(new))))
        gone: list[list[tuple[int, int]]] = [[] for _ in items]
        at = np.flatnonzero(repeat)
        at = at[np.lexsort((inner[at], owner[at]))]
        o, i = owner[at], inner[at]
        breaks = np.flatnonzero(np.concatenate([[True], (o[1:] != o[:-1]) | (i[1:] != i[:-1] + 1)])) if len(at) else at
        for a, b in zip(breaks, np.append(breaks[1:] - 1, len(at) - 1) if len(at) else breaks):
            gone[o[a]].append((int(i[a]), int(i[b]) + width))
        tail = items[-1][0]
        windows = [[x[5][k : k + width] for k in range(len(x[5]) - width + 1)] if x[0] == tail else () for x in items]
        return gone, windows

    return resolve


def remove_repeated_bytes(df: DataFrame, key: str = "doc_id", text: str = "text", width: int = 100, gram: int = 32, spans: bool = False) -> DataFrame:
    """Remove each UTF-8 byte that is covered by a string of ``width`` bytes which also starts earlier, in a document with
    a smaller key or before in the same; strings are judged on the input and do not cross documents.

    Columns: ``key``, ``n_bytes``, ``n_removed``, ``n_spans`` (maximal removed runs), ``kept_sha256`` (of the remaining
    bytes); with ``spans`` also ``spans``, the runs (start, exclusive end), and ``kept``, the bytes that remain. A null text is
    empty. Every row gives a row. A null key counts as the last; rows of one key with several texts are ordered
    by hashes of the texts; rows of one key and one text are one document, and each gets its result.
    """
    docs = numbered(df, key, text)
    ranges = repeated_ranges(docs, byte_symbols, lambda data: lambda a, b: data[a:b], sort_suffixes(width), width, gram, 30_000, HOT)

    def make():
        def work(data, ranges):
            out = {n: [] for n in ("n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", "kept")}
            for whole, gone in zip(data, ranges):
                cut = marked(gone, len(whole))
                edges = np.flatnonzero(np.diff(np.concatenate([[0], cut.astype(np.int8), [0]]))).reshape(-1, 2).tolist()
                kept = np.frombuffer(whole, dtype=np.uint8)[~cut].tobytes() if gone else whole
                for name, value in zip(out, (len(whole), int(cut.sum()), len(edges), sha256(kept).hexdigest(), edges, kept)):
                    out[name].append(value)
            return out

        return work

    schema = "n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", spans array<array<long>>, kept binary" if spans else "")
    return removed(docs, ranges, make, schema).withColumnRenamed("_key", key)
