"""Pack documents into sequences of fixed length: concatenate and cut.

All ids of all documents, each closed by an end id, form one stream in the order of the stored
rows; sequence ``k`` is the window ``[k * size, (k + 1) * size)`` of it, so only the last is padded.
Pass one tokenises and stores each document's ids with the count before it in its partition. The
totals of the partitions, summed up in order, give each partition's place in the stream. Pass two
cuts each document where a window ends. No text and no ids are shuffled.
"""

from __future__ import annotations

import os
from itertools import chain
from string import punctuation
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from casemill.llm.common import map_chunks, per_process, store, text_bytes
from casemill.llm.words import REMEMBERED, WordStore, bytes_list, distinct_words, ragged

#: Words that are tokenised together.
TOGETHER = 200


class Tokens:
    """Ids of texts by the tokenizers library, word by word.

    A space ends a word for any tokenizer that drops white space before it splits, as the one this
    operator is meant for does; the ids of a text are those of its words in a row.
    """

    def __init__(self, file: str, words: bool = True, remember: int = REMEMBERED):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(file)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.words, self.store, self.halves = words, WordStore({b" ": []}, remember), WordStore({b"": []}, remember)
        self.last = None
        if suffix := getattr(self.tokenizer.model, "end_of_word_suffix", None):
            self.last = np.zeros(1 + max(self.tokenizer.get_vocab().values()), dtype=bool)
            self.last[[i for t, i in self.tokenizer.get_vocab().items() if t.endswith(suffix)]] = True
        # A special token that parts a text before anything else is done to it.
        added = self.tokenizer.get_added_tokens_decoder()
        marks = [(i, t.content) for i, t in sorted(added.items()) if t.special and not (t.lstrip or t.rstrip or t.single_word or t.normalized)]
        self.mark = marks[0] if marks else None

    def _ids(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Lengths and ids of texts, one by one."""
        found = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        return np.array(list(map(len, found)), dtype=np.int64), np.array(list(chain.from_iterable(found)), dtype=np.uint32)

    def _together(self, words: list[str], between: str, ends_of, closing: int) -> tuple[np.ndarray, np.ndarray]:
        """Lengths and ids of words that are encoded as one text with ``between`` after each; ``ends_of`` says which ids
        end a word, of which ``closing`` are not its own."""
        lengths, values = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.uint32)]
        groups = [words[i : i + TOGETHER] for i in range(0, len(words), TOGETHER)]
        for ws, e in zip(groups, self.tokenizer.encode_batch_fast([between.join([*g, ""]) for g in groups], add_special_tokens=False)):
            ids = np.array(e.ids, dtype=np.uint32)
            ends = ends_of(ids)
            at = np.flatnonzero(ends)
            if len(at) == len(ws):
                size, ids = np.diff(at, prepend=-1) - closing, ids[~ends] if closing else ids
            else:
                size, ids = self._ids(ws)
            lengths.append(size)
            values.append(ids)
        return np.concatenate(lengths), np.concatenate(values)

    def _plain(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Words that are letters, or marks, alone: a word ends where a last piece does."""
        words = [w.decode() for w in words]
        return self._ids(words) if self.last is None else self._together(words, " ", lambda ids: self.last[ids], 0)

    def _other(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Any words, with a special token between, unless one holds it."""
        if self.mark is None or any(self.mark[1] in w for w in words):
            return self._ids(words)
        return self._together(words, self.mark[1], lambda ids: ids == self.mark[0], 1)

    @staticmethod
    def _halves(words: pa.Array) -> tuple[pa.Array, pa.Array, np.ndarray]:
        """Letters in lower case, the marks that close them, and which words are nothing else. Letters of Latin-1 stay
        letters under NFC and lower case, so marks stand apart from them."""
        cores = pc.utf8_rtrim(words, characters=punctuation)
        plain = pc.and_(pc.utf8_is_alpha(cores), pc.invert(pc.match_substring_regex(cores, r"[^\x00-\x{ff}]")))
        sizes, whole = (pc.binary_length(x).to_numpy(zero_copy_only=False).astype(np.int64) for x in (cores, words))
        data, starts = b"".join(bytes_list(words.cast(pa.binary()))), np.cumsum(whole) - whole
        tails = np.frombuffer(data, dtype=np.uint8)[ragged(starts + sizes, whole - sizes)].tobytes()
        offsets = np.append(0, np.cumsum(whole - sizes)).astype(np.int32)
        tails = pa.Array.from_buffers(pa.string(), len(words), [None, pa.py_buffer(offsets), pa.py_buffer(tails)])
        return pc.utf8_lower(cores), tails, plain.to_numpy(zero_copy_only=False)

    def _learn(self, words: list[bytes]):
        """Lengths and ids of new words, each with the space before it."""
        column = pa.array([w[1:] for w in words], pa.binary()).cast(pa.string())
        cores, tails, plain = self._halves(column)
        places = []
        for half in (cores, tails):
            chosen = half.filter(pa.array(plain)).dictionary_encode()
            places.append(self.halves.places(bytes_list(chosen.dictionary.cast(pa.binary())), self._plain)[chosen.indices.to_numpy()])
        of_halves, first = self.halves.runs(np.stack(places, axis=1).ravel())
        of_others, second = self._other(column.filter(pa.array(~plain)).to_pylist())
        lengths, at = np.zeros(len(words), dtype=np.int64), np.zeros(len(words), dtype=np.int64)
        for chosen, sizes, before in ((plain, of_halves.reshape(-1, 2).sum(axis=1), 0), (~plain, of_others, len(first))):
            lengths[chosen], at[chosen] = sizes, before + np.cumsum(sizes) - sizes
        return lengths, np.concatenate([first, second])[ragged(at, lengths)]

    def encode(self, texts: list[bytes], end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """How many ids each text has, with the end id that closes it, and the ids of all."""
        if not self.words:
            counts, ids = self._ids([t.decode() for t in texts])
            return counts + 1, np.insert(ids, np.cumsum(counts), np.uint32(end_id))
        data = b" " + b" ".join(texts)
        begins = np.cumsum([0, *(len(t) + 1 for t in texts)])[:-1]
        starts = np.flatnonzero(np.frombuffer(data, dtype=np.uint8) == 32)
        self.store.shrink()
        self.halves.shrink()
        words, code = distinct_words(data, starts)
        places = self.store.places(words, self._learn)
        lengths, ids = self.store.runs(places[code])
        counts = np.add.reduceat(lengths, np.searchsorted(starts, begins)) if texts else np.zeros(0, dtype=np.int64)
        own = np.ones(len(ids) + len(counts), dtype=bool)
        own[np.cumsum(counts + 1) - 1] = False
        out = np.full(len(own), end_id, dtype=np.uint32)
        out[own] = ids
        return counts + 1, out


def pack_documents(
    df: DataFrame,
    file: str,
    size: int = 4096,
    end_id: int = 2,
    key: str = "doc_id",
    text: str = "text",
    words: bool = True,
    tokens: bool = False,
    remember: int = REMEMBERED,
) -> DataFrame:
    """Cut all documents into sequences of ``size`` tokens; one row for each piece.

    Columns: ``key``, ``start`` (the document's ids before the piece), ``length``, ``ids_crc32`` (of its ids
    as little-endian unsigned 32-bit integers), ``doc_tokens`` (with the end id), ``sequence_id``, ``offset``
    (in the sequence, gapless from 0), ``continues`` (the piece is the rest of what a border cut); with
    ``tokens`` also ``ids``. A null or empty text gives the end id alone. Rows are documents: repeated rows,
    equal or null keys are packed each. An empty table gives no rows. ``words=False`` is for tokenizers
    that keep white space. A worker process remembers ``remember`` words, twice: 100 bytes or so for each. One job runs when this is called: it stores the ids in the shared folder.
    """
    kind, name = dict(df.dtypes)[key], ("tokens", file, words, remember)

    def count():
        encoder = per_process(name, lambda: Tokens(file, words, remember))
        part, before = TaskContext.get().partitionId(), 0

        def work(batch):
            nonlocal before
            sizes, ids = encoder.encode(text_bytes(batch.column("_text")), end_id)
            places = before + np.cumsum(sizes) - sizes
            before += int(sizes.sum())
            offsets = np.append(0, 4 * np.cumsum(sizes)).astype(np.int64)
            held = pa.Array.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(ids.astype("<u4").tobytes())])
            return {"_key": batch.column("_key"), "_part": np.full(len(sizes), part), "_before": places, "_n": sizes, "_ids": held.cast(pa.binary())}

        return work

    def cut():
        def work(batch):
            rows = {n: [] for n in ("start", "length", "ids_crc32", "sequence_id", "offset", "continues", "ids")}
            owner = []
            bases = (batch.column("_base").to_numpy() + batch.column("_before").to_numpy()).tolist()
            for i, (base, ids) in enumerate(zip(bases, batch.column("_ids").to_pylist())):
                at, n = 0, len(ids) // 4
                while at < n:
                    sequence, offset = divmod(base + at, size)
                    take = min(n - at, size - offset)
                    piece = ids[4 * at : 4 * (at + take)]
                    owner.append(i)
                    for name, value in zip(rows, (at, take, crc32(piece), sequence, offset, at > 0, piece)):
                        rows[name].append(value)
                    at += take
            owner = np.array(owner, dtype=np.int64)
            return rows | {"_key": batch.column("_key").take(owner), "doc_tokens": batch.column("_n").take(owner)}

        return work

    rows = df.selectExpr(f"`{key}` AS _key", f"`{text}` AS _text")
    ids = store(map_chunks(rows, "_text", count, f"_key {kind}, _part long, _before long, _n long, _ids binary", name), "ids")
    totals = ids.groupBy("_part").agg(F.sum("_n").alias("_total"))
    order = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each task of pass one
    bases = totals.select("_part", F.coalesce(F.sum("_total").over(order), F.lit(0)).alias("_base"))
    # Two numbers for each task of pass one: that bounds what is broadcast, and the ids stay where they are.
    placed = ids.join(F.broadcast(bases), "_part").select("_key", "_base", "_before", "_n", "_ids")
    out = map_chunks(
        placed,
        "_ids",
        cut,
        f"_key {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, "
        "continues boolean" + (", ids binary" if tokens else ""),
    )
    return out.withColumnRenamed("_key", key)
