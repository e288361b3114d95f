"""BPE as an automaton over tokens.

The automaton starts with one state and a loop for every byte. Merge number ``i`` of the pair
``(u, v)`` is one gadget: wherever a ``u`` arc leads to a state with a ``v`` arc, that state is split
off for ``u`` without its ``v`` arc, and an arc ``uv`` is drawn past it. After all gadgets, a state is
known by the token that leads to it, and the accepted paths are the token sequences that BPE makes.
50,000 gadgets leave nearly every token as an arc of nearly every state, so the arcs are stored as
what the gadgets did: which arc was cut when, and which state a new one was split from. Whether an
arc exists is read off these tables, and kept.
"""

from __future__ import annotations

import json
from hashlib import sha256

import ahocorasick
import numpy as np
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from casemill.llm.common import map_chunks, per_process
from casemill.llm.words import WordStore, distinct_words, ragged, word_starts

# The pre-split of byte-level BPE and its bytes that are printed as themselves.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
PRINTED = [(33, 126), (161, 172), (174, 255)]

#: Arcs that a worker process remembers before it starts anew, and parts of words before it lets older ones go.
REMEMBERED = 200_000


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a vocabulary file: itself, or one from 256 on."""
    own = [b for a, z in PRINTED for b in range(a, z + 1)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class MergeAutomaton:
    """``labels``: bytes of each token id; ``merges``: pairs of ids in the order of their gadgets."""

    def __init__(self, labels: dict[int, bytes], merges: list[tuple[int, int]]):
        self.labels = labels
        self.ids = {label: i for i, label in labels.items()}
        self.born: dict[int, int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        self.cut: dict[tuple[int, int], int] = {}
        for when, (u, v) in enumerate(merges, 1):
            self.cut.setdefault((u, v), when)
            token = self.ids.get(labels[u] + labels[v])
            if token is not None and token not in self.born:
                self.born[token], self.parts[token] = when, (u, v)
        self.arcs: dict[int, bool] = {}  # by state and token in one number
        self.made: dict[int, bool] = {}
        self.sizes = {token: len(label) for token, label in labels.items()}
        self.table = ahocorasick.Automaton()  # of labels, a letter for each byte
        for label, token in self.ids.items():
            if self.exists(token):
                self.table.add_word(label.decode("latin-1"), token)
        self.table.make_automaton()

    def _arc(self, state: int, token: int, before: float) -> bool:
        """Is there an arc ``token`` at the state that ``state`` leads to, after the gadgets below ``before``?"""
        born, parts, cut = self.born, self.parts, self.cut
        while True:
            if cut.get((state, token), before) < before:
                return False
            a, b = born.get(state, 0), born.get(token, 0)
            if not a and not b:
                return True
            if a > b:  # split off from the state of its right part
                before, state = a, parts[state][1]
            else:  # drawn past the arc of its left part; a gadget works from the left
                before, token = b + 1, parts[token][0]

    def _arc_kept(self, state: int, token: int) -> bool:
        if len(self.arcs) >= REMEMBERED:
            self.arcs.clear()
        known = self.arcs[state << 20 | token] = self._arc(state, token, float("inf"))
        return known

    def exists(self, token: int) -> bool:
        """Was an arc of this token ever drawn? Some tokens of a vocabulary are never made."""
        if (known := self.made.get(token)) is None:
            known = True
            if token in self.parts:
                u, v = self.parts[token]
                known = self.exists(u) and self.exists(v) and self._arc(u, v, self.born[token])
            self.made[token] = known
        return known

    def path(self, word: bytes) -> list[int]:
        """The only accepted path that spells ``word``, as ids.

        Each prefix has one last token: of the labels that end there, the longest with an arc from the
        state where it starts. The label table reports the labels of each end, longest first.
        """
        n = len(word)
        token, before, sizes, arcs = [-1] * (n + 1), [0] * (n + 1), self.sizes, self.arcs
        for end, label in self.table.iter(word.decode("latin-1")):
            end += 1
            if token[end] < 0:
                start = end - sizes[label]
                if start:
                    last = token[start]
                    if last < 0:
                        continue
                    open_ = arcs.get(last << 20 | label)
                    if not (self._arc_kept(last, label) if open_ is None else open_):
                        continue
                token[end], before[end] = label, start
        out = []
        while n:
            if token[n] >= 0:
                out.append(token[n])
                n = before[n]
            else:  # a byte that no token spells
                n -= 1
        return out[::-1]


class Codec:
    """Encode and decode whole texts as a byte-level BPE file of the tokenizers library describes."""

    def __init__(self, file: str):
        with open(file, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        vocab = spec["model"]["vocab"]
        labels = {i: bytes(letters[c] for c in t) for t, i in vocab.items() if all(c in letters for c in t)}
        pairs = [m.split(" ", 1) if isinstance(m, str) else m for m in spec["model"]["merges"]]
        self.automaton = MergeAutomaton(labels, [(vocab[u], vocab[v]) for u, v in pairs])
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.label = {**labels, **{i: t.encode() for t, i in self.special.items()}}
        self.stops = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.split = regex.compile(SPLIT)
        self.store = WordStore({c.encode(): [i] for c, i in self.special.items()})
        self.parts: dict[str, list[int]] = {}
        self.older: dict[str, list[int]] = {}
        self.label_sizes = np.zeros(1 + max(self.label), dtype=np.int64)
        self.label_sizes[list(self.label)] = list(map(len, self.label.values()))
        self.label_starts = np.cumsum(self.label_sizes) - self.label_sizes
        self.label_bytes = np.frombuffer(b"".join(self.label[i] for i in sorted(self.label)), dtype=np.uint8)

    def _learn(self, words: list[bytes]):
        """Lengths and ids of words whose ends are ends of what the pre-split makes."""
        path, split, parts = self.automaton.path, self.split.findall, self.parts
        lengths, ids = [], []
        for word in words:
            before = len(ids)
            for part in split(word.decode()):
                known = parts.get(part)
                if known is None:
                    known = parts[part] = self.older.get(part) or path(part.encode())
                ids += known
            lengths.append(len(ids) - before)
        if len(parts) > REMEMBERED:  # those of the last generation that are not asked for again are let go
            self.parts, self.older = {}, parts
        return lengths, np.array(ids, dtype=np.uint32)

    def _stretches(self, texts: list[str]) -> tuple[list[bytes], np.ndarray]:
        """Texts cut at special tokens, and which text each stretch is of."""
        parts, owner = [], []
        for n, text in enumerate(texts):
            at = 0
            for m in self.stops.finditer(text) if self.stops else ():
                for part in (text[at : m.start()], m.group()):
                    if part:
                        parts.append(part.encode())
                        owner.append(n)
                at = m.end()
            if at < len(text):
                parts.append(text[at:].encode())
                owner.append(n)
        return parts, np.array(owner, dtype=np.int64)

    def encode_all(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """How many ids each text has, and the ids of all."""
        parts, owner = self._stretches(texts)
        if not parts:
            return np.zeros(len(texts), dtype=np.int64), np.zeros(0, dtype=np.uint32)
        begins = np.cumsum([0, *map(len, parts)])[:-1]
        data = b"".join(parts)
        starts = word_starts(np.frombuffer(data, dtype=np.uint8), begins)
        self.store.shrink()
        words, code = distinct_words(data, starts)
        lengths, ids = self.store.runs(self.store.places(words, self._learn)[code])
        counts = np.zeros(len(texts), dtype=np.int64)
        np.add.at(counts, owner, np.add.reduceat(lengths, np.searchsorted(starts, begins)))
        return counts, ids

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        return self.encode_all([text])[1].astype("<u4").tobytes()

    def spell(self, ids: np.ndarray) -> bytes:
        """The labels of the arcs, in a row."""
        return self.label_bytes[ragged(self.label_starts[ids], self.label_sizes[ids])].tobytes()

    def decode(self, ids: bytes) -> str:
        """Emit the labels of the arcs."""
        return self.spell(np.frombuffer(ids, "<u4")).decode("utf-8", "replace")


def bpe_round_trip(df: DataFrame, file: str, key: str = "doc_id", text: str = "text", tokens: bool = False) -> DataFrame:
    """Encode and decode each whole text: ``key``, ``n_tokens``, ``ids_sha256``, ``decoded_sha256``; with
    ``tokens`` also ``ids`` (little-endian 32-bit) and ``decoded``.

    A null text is empty: no tokens. Every row gives one row, also repeated ones and rows with a null key.
    ``file`` is read by each task, so it must be at the same place on all executors. No shuffle.
    """
    kind, name = dict(df.dtypes)[key], ("codec", file)
    more = ", ids binary, decoded string" if tokens else ""

    def make():
        codec = per_process(name, lambda: Codec(file))

        def work(batch):
            counts, every = codec.encode_all(pc.fill_null(batch.column("_text"), "").to_pylist())
            data, ends = every.astype("<u4").tobytes(), np.append(0, 4 * np.cumsum(counts)).tolist()
            ids = [data[a:b] for a, b in zip(ends, ends[1:])]
            decoded = [codec.decode(x) for x in ids]
            out = {
                "_key": batch.column("_key"),
                "n_tokens": counts,
                "ids_sha256": [sha256(x).hexdigest() for x in ids],
                "decoded_sha256": [sha256(x.encode()).hexdigest() for x in decoded],
            }
            return out | ({"ids": ids, "decoded": decoded} if tokens else {})

        return work

    rows = df.selectExpr(f"`{key}` AS _key", f"`{text}` AS _text")
    out = map_chunks(rows, "_text", make, f"_key {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string{more}", name)
    return out.withColumnRenamed("_key", key)
