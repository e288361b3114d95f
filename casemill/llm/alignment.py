"""How two tokenizers cut the same texts: links between their tokens, counted by inverted pair bitmaps.

Both token sequences cover the same bytes. Byte offsets where tokens of both end cut them into groups; a token
of one and a token of the other are linked where their ranges overlap, once for each stretch between two
neighbouring ends. For each pair of ids an inverted index keeps the documents that hold it linked: a container
for up to 65,536 documents of a task, as a sorted array or, where half of that is shorter, a bitmap, and planes for
the binary digits of how often beyond once. The containers of a pair hold different documents, so their union is
their list, its popcount the sum. Popcounts give the corpus-wide counts of documents and links;
these go back to the containers, and walking the postings sums them up for each document.

A space between two characters that are not white space starts a word for both tokenizers, so a text is
tokenised and aligned word by word, and a worker remembers words.
"""

from __future__ import annotations

import json
import os
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from casemill.llm.bpe import byte_letters
from casemill.llm.common import chunks, let_go, map_groups, per_process, store, text_bytes
from casemill.llm.words import bytes_list, distinct_words, ragged, word_starts

#: Words that a worker remembers; entries (a pair in a document) after which a container is closed; documents in one.
REMEMBERED, ENTRIES, DOCUMENTS = 200_000, 4_000_000, 1 << 16
#: Bytes of a container as a bitmap; words that are tokenised together; rows of an output batch.
BITMAP, TOGETHER, BATCH = DOCUMENTS // 8, 2000, 50_000

__all__ = ["Aligner", "align_tokenizers", "decode_containers", "encode_containers", "pair_counts", "pair_index"]


class Aligner:
    """Tokens of two tokenizer files on words, aligned; what a word gives is remembered."""

    def __init__(self, byte_file: str, piece_file: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(byte_file)
        self.a.encode_special_tokens = True
        self.a.no_truncation()
        self.a.no_padding()
        self.b = SentencePieceProcessor(model_file=piece_file)
        with open(byte_file, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        vocab = spec["model"]["vocab"] | {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        labels = {i: bytes(map(letters.__getitem__, t)) if all(c in letters for c in t) else t.encode() for t, i in vocab.items()}
        self.a_labels = [labels.get(i, b"") for i in range(max(labels) + 1)]
        pieces = map(self.b.id_to_piece, range(self.b.get_piece_size()))
        self.b_labels = [
            bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)
        ]
        self.a_sizes, self.b_sizes = (np.array(list(map(len, x)), dtype=np.int64) for x in (self.a_labels, self.b_labels))
        self.width = max(len(self.a_labels), len(self.b_labels))
        self.digits = [str(i).encode() + end for end in (b",", b"|", b";") for i in range(self.width)]
        self._clear()

    def _clear(self):
        self.known: dict[bytes, int] = {}
        self.strings: list[bytes] = []
        self.counts = np.zeros((0, 4), dtype=np.int64)  # tokens of a and b, groups, links; no tokens: does not fit
        self.starts = np.zeros(0, dtype=np.int64)
        self.pairs = np.zeros(0, dtype=np.int64)
        self.uses = np.zeros(0, dtype=np.int64)

    def _shrink(self):
        """Keep the words used most, at most half of what is remembered."""
        used = np.argsort(-self.uses, kind="stable")[: REMEMBERED // 2]
        used = np.sort(used[self.uses[used] > 1])
        words, strings, counts = list(self.known), self.strings, self.counts[used]
        pairs = self.pairs[ragged(self.starts[used], counts[:, 3])]
        self.known = {words[i]: n for n, i in enumerate(used.tolist())}
        self.strings = [strings[i] for i in used.tolist()]
        self.counts, self.pairs = counts, pairs
        self.starts = np.cumsum(counts[:, 3]) - counts[:, 3]
        self.uses = np.zeros(len(used), dtype=np.int64)

    def _aligned(self, words: list[bytes]):
        """Counts, strings and pairs of words laid end to end; None if the tokens do not spell them."""
        data = b"".join(words)
        text = data.decode()
        a = np.array(self.a.encode(text, add_special_tokens=False).ids, dtype=np.int64)
        b = np.array(self.b.encode(text[1:]), dtype=np.int64)
        if b"".join(map(self.b_labels.__getitem__, b.tolist())) != data or b"".join(map(self.a_labels.__getitem__, a.tolist())) != data:
            return None
        at_a, at_b, ends = np.cumsum(self.a_sizes[a]), np.cumsum(self.b_sizes[b]), np.cumsum(list(map(len, words)))
        both, every = np.intersect1d(at_a, at_b, assume_unique=True), np.union1d(at_a, at_b)
        if len(words) > 1 and not np.isin(ends, both).all():
            return None
        pairs = a[np.searchsorted(at_a, every)] * len(self.b_labels) + b[np.searchsorted(at_b, every)]
        upto = np.stack([np.searchsorted(x, ends, "right") for x in (at_a, at_b, both, every)], axis=1)
        counts = np.diff(upto, axis=0, prepend=0)
        # The tokens of a group, those of a first, each with what follows it.
        owner = np.concatenate([2 * np.searchsorted(both, at_a), 2 * np.searchsorted(both, at_b) + 1])
        order = np.argsort(owner, kind="stable")
        owner, codes = owner[order], np.concatenate([a, b])[order]
        last = np.append(owner[1:] != owner[:-1], True)
        codes = codes + self.width * np.where(last, 1 + owner % 2, 0)
        parts = list(map(self.digits.__getitem__, codes.tolist()))
        cuts = [0, *(upto[:, 0] + upto[:, 1]).tolist()]
        return counts, [b"".join(parts[x:y])[:-1] for x, y in zip(cuts, cuts[1:])], pairs

    def _learn(self, words: list[bytes]):
        """Results of new words, in their order."""
        alone, together, done = [], [], {}
        for i, w in enumerate(words):
            text = w.decode()
            (alone if text[1:2].isspace() or text[-1:].isspace() else together).append(i)
        todo = [[i] for i in alone] + [together[i : i + TOGETHER] for i in range(0, len(together), TOGETHER)]
        while todo:
            part = todo.pop()
            if not part:
                continue
            found = self._aligned([words[i] for i in part])
            if found is not None:
                counts, strings, pairs = found
                cuts = np.cumsum(counts[:, 3])[:-1]
                done.update((i, x) for i, x in zip(part, zip(counts, strings, np.split(pairs, cuts))))
            elif len(part) == 1:
                done[part[0]] = (np.zeros(4, dtype=np.int64), b"", np.zeros(0, dtype=np.int64))
            else:
                todo += [part[: len(part) // 2], part[len(part) // 2 :]]
        return [done[i] for i in range(len(words))]

    def _add(self, words: list[bytes]) -> None:
        learned = self._learn(words)
        self.known.update(zip(words, range(len(self.strings), len(self.strings) + len(words))))
        self.strings += [x[1] for x in learned]
        counts = np.stack([x[0] for x in learned])
        self.starts = np.concatenate([self.starts, len(self.pairs) + np.cumsum(counts[:, 3]) - counts[:, 3]])
        self.counts = np.concatenate([self.counts, counts])
        self.pairs = np.concatenate([self.pairs, *(x[2] for x in learned)])
        self.uses = np.concatenate([self.uses, np.zeros(len(words), dtype=np.int64)])

    def align(self, texts: list[bytes]):
        """For each text its counts (tokens of a and b, groups, links) and its groups as text; and for each link the
        index of its text and its pair."""
        counts, groups = np.zeros((len(texts), 4), dtype=np.int64), [b""] * len(texts)
        live = [i for i, t in enumerate(texts) if t]
        if not live:
            return counts, groups, np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        data = b" " + b" ".join(texts[i] for i in live)
        sizes = np.array([len(texts[i]) + 1 for i in live], dtype=np.int64)
        begins = np.cumsum(sizes) - sizes
        starts = word_starts(np.frombuffer(data, dtype=np.uint8), begins)
        if len(self.known) > REMEMBERED:
            self._shrink()
        distinct, codes = distinct_words(data, starts)
        if new := [w for w in distinct if w not in self.known]:
            self._add(new)
        named = np.array([self.known[w] for w in distinct], dtype=np.int64)
        self.uses[named] += np.bincount(codes, minlength=len(distinct))
        words, firsts = named[codes], np.searchsorted(starts, begins)
        bad = np.logical_or.reduceat(self.counts[words, 0] == 0, firsts)
        lasts = np.append(firsts[1:], len(words))
        summed = np.add.reduceat(self.counts[words], firsts, axis=0)
        keep = np.repeat(~bad, lasts - firsts)
        strings = list(map(self.strings.__getitem__, words.tolist()))
        links_of, pairs_of = [], []
        for n, i in enumerate(live):
            if not bad[n]:
                counts[i], groups[i] = summed[n], b";".join(strings[firsts[n] : lasts[n]])
            else:  # a word does not fit, so the whole text decides
                (own, groups[i], pairs), counts[i] = self._learn([b" " + texts[i]])[0], 0
                counts[i] = own
                links_of.append(np.full(len(pairs), i))
                pairs_of.append(pairs)
        used = words[keep]
        lengths = self.counts[used, 3]
        text_of = np.repeat(np.array(live, dtype=np.int64), lasts - firsts)[keep]
        links_of.append(np.repeat(text_of, lengths))
        pairs_of.append(self.pairs[ragged(self.starts[used], lengths)])
        return counts, groups, np.concatenate(links_of), np.concatenate(pairs_of)


def encode_containers(sizes: np.ndarray, low: np.ndarray) -> pa.Array:
    """Sets of numbers below 65,536, ``sizes`` of them after each other and sorted: little-endian, or a bitmap if that is no longer."""
    own = 2 * sizes
    lengths = np.minimum(own, BITMAP)
    starts, ends = np.cumsum(own) - own, np.cumsum(lengths)
    plain, parts, at = low.astype("<u2").tobytes(), [], 0
    for i in np.flatnonzero(own >= BITMAP).tolist():
        bits = np.zeros(DOCUMENTS, dtype=bool)
        bits[np.frombuffer(plain, "<u2", int(sizes[i]), int(starts[i]))] = True
        parts += [plain[at : starts[i]], np.packbits(bits).tobytes()]
        at = int(starts[i] + own[i])
    data = b"".join([*parts, plain[at:]])
    offsets = np.concatenate([[0], ends]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(data)])


def decode_containers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The size of each set, and the numbers of all."""
    lengths = pc.binary_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
    data = b"".join(bytes_list(column))
    sizes, starts, parts, at = lengths // 2, np.cumsum(lengths) - lengths, [], 0
    for i in np.flatnonzero(lengths == BITMAP).tolist():
        start = int(starts[i])
        parts.append(np.frombuffer(data, "<u2", (start - at) // 2, at))
        bits = np.frombuffer(data, np.uint8, BITMAP, start)
        parts.append(np.flatnonzero(np.unpackbits(bits)).astype("<u2"))
        sizes[i], at = len(parts[-1]), start + BITMAP
    parts.append(np.frombuffer(data, "<u2", (len(data) - at) // 2, at))
    return sizes, np.concatenate(parts).astype(np.int64)


def _postings(keys: np.ndarray, often: np.ndarray) -> dict:
    """Postings of one container from sorted keys (a pair, then a document in 16 bits) and how often each holds."""
    pairs, low = keys >> 16, keys & 0xFFFF
    new = np.flatnonzero(np.append(True, pairs[1:] != pairs[:-1]))
    sizes = np.diff(np.append(new, len(keys)))
    more = often - 1
    digits = np.frexp(np.maximum.reduceat(more, new).astype(np.float64))[1].astype(np.int64)  # of the largest
    base = np.cumsum(digits) - digits
    row = np.repeat(np.arange(len(new)), sizes)
    some = np.flatnonzero(more)
    planes, places = [], []
    for k in range(int(digits.max()) if len(digits) else 0):
        on = some[(more[some] >> k) & 1 == 1]
        planes.append(base[row[on]] + k)
        places.append(low[on])
    plane = np.concatenate([*planes, np.zeros(0, dtype=np.int64)])
    order = np.argsort(plane, kind="stable")
    held = encode_containers(np.bincount(plane, minlength=int(digits.sum())), np.concatenate([*places, np.zeros(0, dtype=np.int64)])[order])
    return {
        "pair": pairs[new],
        "docs": sizes,
        "links": np.add.reduceat(often, new),
        "bitmap": encode_containers(sizes, low),
        "planes": pa.ListArray.from_arrays(pa.array(np.append(base, digits.sum()), pa.int32()), held),
    }


_DOCS = "n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, low int"
_PAIRS = "pair long, docs long, links long, bitmap binary, planes array<binary>"


def pair_index(df: DataFrame, byte_file: str, piece_file: str, key: str = "doc_id", text: str = "text", groups: bool = False) -> DataFrame:
    """The stored index: for each document a row without ``pair``, and for each pair of a ``container`` a row with its
    postings (``docs``, ``links``, ``bitmap``, ``planes``). With ``groups`` also the groups of each document, as text."""
    kind = dict(df.dtypes)[key]
    schema = _parse_datatype_string(f"container long, _key {kind}, {_DOCS}, groups string, {_PAIRS}")
    arrow, name, entries = to_arrow_schema(schema), ("aligner", byte_file, piece_file), ENTRIES

    def rows(n, columns):
        whole = [pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type) for f in arrow]
        batch = pa.RecordBatch.from_arrays(whole, schema=arrow)
        for at in range(0, n, BATCH):
            yield batch.slice(at, BATCH)

    def run(batches):
        let_go(name)
        aligner = per_process(name, lambda: Aligner(byte_file, piece_file))
        container, used, keys, often = TaskContext.get().partitionId() << 24, 0, [], []

        def close():
            nonlocal container, used, keys, often
            every, times = np.concatenate(keys), np.concatenate(often)
            order = np.argsort(every)
            every, times = every[order], times[order]
            keys, often = [], []
            if len(every):
                columns = _postings(every, times)
                columns["container"] = np.full(len(columns["pair"]), container)
                yield from rows(len(columns["pair"]), columns)
            container, used = container + 1, 0

        for batch in chunks(batches, "_text"):
            texts = text_bytes(batch.column("_text"))
            counts, strings, owner, pairs = aligner.align(texts)
            if used + len(texts) > DOCUMENTS:
                yield from close()
            own, times = np.unique(pairs << 16 | (owner + used), return_counts=True)
            keys.append(own)
            often.append(times.astype(np.int64))
            columns = dict(zip(("n_a", "n_b", "n_groups", "n_links"), counts.T))
            columns["container"] = np.full(len(texts), container)
            columns["_key"] = batch.column("_key")
            columns["low"] = np.arange(used, used + len(texts))
            columns["groups_sha256"] = [sha256(s).hexdigest() if s else "" for s in strings]
            if groups:
                columns["groups"] = [s.decode() for s in strings]
            yield from rows(len(texts), columns)
            used += len(texts)
            if sum(map(len, keys)) >= entries:
                yield from close()
        if keys:
            yield from close()

    source = df.selectExpr(f"`{key}` AS _key", f"`{text}` AS _text")
    return store(source.mapInArrow(run, schema), "pairs")


def pair_counts(index: DataFrame, width: int) -> DataFrame:
    """``pair`` with its ids ``a`` and ``b``, the documents and links that hold it, and ``best``: no pair of ``a`` has more documents."""
    counts = index.filter("pair IS NOT NULL").groupBy("pair").agg(F.sum("docs").alias("docs"), F.sum("links").alias("links"))
    counts = counts.withColumn("a", F.call_function("div", F.col("pair"), F.lit(width).cast("long"))).withColumn("b", F.col("pair") % width)
    most = F.max("docs").over(Window.partitionBy("a"))  # at most a row for each id of the other vocabulary
    return counts.withColumn("best", F.col("docs") == most)


def _walk(batch: pa.RecordBatch) -> dict:
    """Walk the postings of one container: each gives its pair's count to the documents it holds."""
    step = batch.column("step").to_numpy()
    docs, counts, postings = (batch.slice(int(np.searchsorted(step, k)), int((step == k).sum())) for k in range(3))
    low = docs.column("low").to_numpy(zero_copy_only=False).astype(np.int64)
    size = int(low.max()) + 1 if len(low) else 0
    worth = counts.column("docs").to_numpy(zero_copy_only=False).astype(np.int64)
    best = counts.column("best").to_numpy(zero_copy_only=False).astype(np.int64)
    total = np.zeros((2, size), dtype=np.int64)

    def give(pair, where, times):
        for out, value in zip(total, (worth, best)):
            value = value[pair] * times
            for shift in (0, 26):  # the sums are of doubles, so of numbers that stay whole in them
                digit = value >> 26 if shift else value & ((1 << 26) - 1)
                out += np.bincount(where, weights=digit, minlength=size).astype(np.int64) << shift

    if len(postings):
        if not counts.column("pair").equals(postings.column("pair")):
            raise ValueError("a container lacks counts of its pairs")
        sizes, where = decode_containers(postings.column("bitmap"))
        give(np.repeat(np.arange(len(sizes)), sizes), where, 1)
        planes = postings.column("planes")
        held = pc.list_value_length(planes).to_numpy(zero_copy_only=False).astype(np.int64)
        pair, digit = np.repeat(np.arange(len(held)), held), ragged(np.zeros(len(held), dtype=np.int64), held)
        sizes, where = decode_containers(planes.flatten())
        give(np.repeat(pair, sizes), where, np.repeat(1 << digit, sizes))
    names = ["_key", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "groups"]
    return {n: docs.column(n) for n in names} | {"n_best": total[1][low], "count_sum": total[0][low]}


def align_tokenizers(
    df: DataFrame, byte_file: str, piece_file: str, key: str = "doc_id", text: str = "text", groups: bool = False
) -> DataFrame:
    """Align the tokens of a byte-level BPE file (a, on space and text) and of a sentencepiece model (b) on each whole text.

    One row for each row: ``key``, ``n_a``, ``n_b`` tokens, ``n_groups``, ``n_links``, ``n_best`` (links whose pair no other pair
    of its a id exceeds in documents), ``count_sum`` (documents of its pair, over links), ``groups_sha256`` (of
    ``a1,a2|b1;a3|b2,b3``); with ``groups`` also that text. Rows are documents, also repeated ones and rows with equal or null
    keys. Null and empty texts, and texts that the tokens do not spell byte by byte, have no tokens: zeros and ''.
    Strings of special tokens are plain text. An empty table gives no rows; other columns play no part. The files must
    be at the same place on all executors. One job runs when this is called: it stores the index.
    """
    from sentencepiece import SentencePieceProcessor

    kind, width = dict(df.dtypes)[key], SentencePieceProcessor(model_file=piece_file).get_piece_size()
    index = pair_index(df, byte_file, piece_file, key, text, groups)
    held = index.filter("pair IS NOT NULL")
    counts = held.select("container", "pair").join(pair_counts(index, width).select("pair", "docs", "best"), "pair")
    names = ["container", "_key", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "low", "groups"]
    docs = index.filter("pair IS NULL").select(F.lit(0).alias("step"), *names)
    counts = counts.select(F.lit(1).alias("step"), "container", "pair", "docs", "best")
    postings = held.select(F.lit(2).alias("step"), "container", "pair", "bitmap", "planes")
    rows = docs.unionByName(counts, True).unionByName(postings, True)
    schema = f"_key {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string, groups string"
    out = map_groups(rows, ["container"], ["step", "pair"], _walk, schema).withColumnRenamed("_key", key)
    return out if groups else out.drop("groups")
