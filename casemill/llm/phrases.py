"""Remove words that repeat: windows of words, confirmed and located by Aho-Corasick automata."""

from __future__ import annotations

from collections import Counter
from hashlib import sha256

import ahocorasick
import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casemill.llm.repeats import marked, numbered, removed, repeated_ranges
from casemill.llm.windows import word_symbols

#: Surroundings of one anchor that a shard takes together.
HOT = 400


def _slicer(data: bytes):
    words = data.split()  # bytes 9 to 13 and 32
    return lambda a, b: b" ".join(words[a:b])


def locate_repeats(width: int):
    """The method of a shard: passages that come at two places are confirmed, compiled into one automaton,
    and located in all slices of the shard, which it reads as one stream."""

    def resolve(items, seen):
        places, windows = [], []
        for _, doc, copy, first, _, data in items:
            words = data.split(b" ")
            cuts = np.cumsum([0] + [len(w) + 1 for w in words]).tolist()
            windows.append([data[cuts[i] : cuts[i + width] - 1] for i in range(len(words) - width + 1)])
            places.append((doc, copy, first))
        counts = Counter(w for ws in windows for w in ws)
        passages = [w for w, n in counts.items() if n > 1 or w in seen]
        gone: list[list[tuple[int, int]]] = [[] for _ in items]
        if not passages:
            return gone, windows
        automaton = ahocorasick.Automaton()
        for k, passage in enumerate(passages):
            automaton.add_word(f" {passage.decode('latin-1')} ", k)
        automaton.make_automaton()
        sizes = [len(x[5]) + 2 for x in items]
        starts = np.cumsum([0, *sizes])
        stream = b"\n".join(b" " + x[5] + b" " for x in items)
        starts += np.arange(len(starts))
        hits = np.array(list(automaton.iter(stream.decode("latin-1"))), dtype=np.int64).reshape(-1, 2)
        begin = hits[:, 0] - np.array([len(p) for p in passages])[hits[:, 1]]  # of the passage's first word
        owner = np.searchsorted(starts, begin, side="right") - 1
        blanks = np.cumsum(np.frombuffer(stream, dtype=np.uint8) == 32)
        word = blanks[begin] - blanks[starts[owner]]  # words of the slice before the passage
        located = sorted(zip(hits[:, 1].tolist(), owner.tolist(), word.tolist()), key=lambda x: (x[0], *places[x[1]][:2], places[x[1]][2] + x[2]))
        at, head = None, None
        for k, i, w in located:
            here = (*places[i][:2], places[i][2] + w)
            if k != at:
                at, head = k, here
                if passages[k] not in seen:
                    continue
                head = None
            if here != head:
                gone[i].append((w, w + width))
        return gone, windows

    return resolve


def remove_repeated_words(
    df: DataFrame, key: str = "doc_id", text: str = "text", width: int = 20, gram: int = 8, texts: bool = False, carry: list[str] | tuple = ()
) -> DataFrame:
    """Remove each word that is covered by a window of ``width`` words which also starts earlier, in a document with a
    smaller key or before in the same; windows are judged on the input.

    Columns: ``key``, ``n_words``, ``n_removed``, ``kept_sha256`` (of the kept words joined by one space); with ``texts``
    also ``kept``: the words that are left, with the white space before each (the first word has none; a text
    that loses nothing stays as it is); and ``carried``, a struct of the columns ``carry``. Words are runs of bytes other than 9 to 13 and 32. A null or empty text has none.
    Every row gives a row. A null key counts as the last; rows of one key with several texts are ordered by
    hashes of the texts; rows of one key and one text are one document, and each gets its result.
    """
    docs = numbered(df, key, text, carry)
    ranges = repeated_ranges(docs, word_symbols, _slicer, locate_repeats(width), width, gram, 4000, HOT)

    def make():
        def work(data, ranges):
            out = {n: [] for n in ("n_words", "n_removed", "kept_sha256", "kept")}
            for whole, gone in zip(data, ranges):
                words = whole.split()
                cut = marked(gone, len(words))
                kept = [w for w, c in zip(words, cut.tolist()) if not c] if gone else words
                rest = None
                if texts:
                    rest = kept_text(whole, cut).decode() if gone else whole.decode()
                for name, value in zip(out, (len(words), int(cut.sum()), sha256(b" ".join(kept)).hexdigest(), rest)):
                    out[name].append(value)
            return out

        return work

    schema = "n_words long, n_removed long, kept_sha256 string" + (", kept string" if texts else "")
    out = removed(docs, ranges, make, schema)
    return out.select(F.col("_key").alias(key), "n_words", "n_removed", "kept_sha256", *(["kept"] if texts else []), *([F.col("_rest").alias("carried")] if carry else []))


def kept_text(data: bytes, cut: np.ndarray) -> bytes:
    """The text without the words that are cut and the white space before them."""
    space = np.zeros(256, dtype=bool)
    space[[9, 10, 11, 12, 13, 32]] = True
    inside = ~space[np.frombuffer(data, dtype=np.uint8)]
    new = inside & ~np.concatenate([[False], inside[:-1]])
    ends = np.flatnonzero(inside & ~np.concatenate([inside[1:], [False]])) + 1
    begins = np.concatenate([[0], ends[:-1]]) if new.any() else ends
    return b"".join(data[a:b] for a, b, c in zip(begins.tolist(), ends.tolist(), cut.tolist()) if not c).lstrip(b" \t\n\r\x0b\x0c")
