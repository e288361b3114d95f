"""Aligned tokenizers against both libraries and plain counting."""

import random
from collections import Counter
from hashlib import sha256

import numpy as np
import pytest

from casemill.llm import alignment
from casemill.llm.alignment import Aligner, align_tokenizers, decode_containers, encode_containers, pair_counts, pair_index
from tests.llm.fixtures import DOCUMENTS, documents

tokenizers = pytest.importorskip("tokenizers")
sentencepiece = pytest.importorskip("sentencepiece")
public = pytest.importorskip("public_tokenizers")
FILES = ("byte_bpe_50k.json", "piece_bpe_32k.model")


def byte_of():
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Plain:
    def __init__(self):
        self.a = tokenizers.Tokenizer.from_file(public.path(FILES[0]))
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=public.path(FILES[1]))
        self.letters = byte_of()

    def tokens(self, text):
        a = self.a.encode(" " + text, add_special_tokens=False)
        a = [(i, bytes(self.letters[c] for c in t)) for i, t in zip(a.ids, a.tokens)]
        b = []
        for i in self.b.encode(text):
            piece = self.b.id_to_piece(i)
            b.append((i, bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode()))
        whole = (" " + text).encode()
        if not text or any(b"".join(x for _, x in side) != whole for side in (a, b)):
            return [], []
        return a, b

    def align(self, text):
        """Tokens of both, groups as text, and linked occurrences."""
        a, b = self.tokens(text)
        spans = []
        for side in (a, b):
            ends = np.cumsum([len(x) for _, x in side]).tolist()
            spans.append([(i, e - len(x), e) for (i, x), e in zip(side, ends)])
        links = [(x, y) for x, p, q in spans[0] for y, r, s in spans[1] if max(p, r) < min(q, s)]
        groups, held = [], ([], [])
        common = {e for *_, e in spans[0]} & {e for *_, e in spans[1]}
        for end in sorted(common):
            for out, side in zip(held, spans):
                out += [str(i) for i, _, e in side if e <= end][len(out) + sum(len(g[side is spans[1]]) for g in groups) :]
            groups.append(tuple(list(h) for h in held))
            held = ([], [])
        return a, b, ";".join(f"{','.join(x)}|{','.join(y)}" for x, y in groups), links


@pytest.fixture(scope="module")
def plain():
    return Plain()


def odd_texts():
    rng = random.Random(5)
    bits = ["a", "the", "ing", " ", "  ", "\n", "\t", "é", "ü", "中", "🙂", "▁", "<0x41>", "<s>", "<|endoftext|>", "'s", "1", "2024", ".", ",", " ", "　", "\x1c", "́", "X", "\x00", " "]
    return ["".join(rng.choice(bits) for _ in range(rng.randint(0, 12))) for _ in range(1500)]


def test_aligner_equals_plain_alignment(plain):
    aligner = Aligner(*map(public.path, FILES))
    texts = odd_texts() + [r[1] or "" for r in documents()][:150] + ["a " * 500, "x" * 600]
    for part in (texts, texts[::-1]):
        counts, groups, owner, pairs = aligner.align([t.encode() for t in part])
        held = [Counter() for _ in part]
        for i, p in zip(owner.tolist(), pairs.tolist()):
            held[i][divmod(p, 32000)] += 1
        for i, text in enumerate(part):
            a, b, want, links = plain.align(text)
            assert (counts[i].tolist(), groups[i].decode()) == ([len(a), len(b), want.count(";") + bool(want), len(links)], want), repr(text)
            assert held[i] == Counter(links)


def test_words_are_forgotten(plain, monkeypatch):
    monkeypatch.setattr(alignment, "REMEMBERED", 40)
    aligner, texts = Aligner(*map(public.path, FILES)), odd_texts()[:300]
    for at in range(0, 300, 10):
        counts, groups, *_ = aligner.align([t.encode() for t in texts[at : at + 10]])
        for text, got in zip(texts[at : at + 10], groups):
            assert got.decode() == plain.align(text)[2]


def test_containers():
    rng = np.random.default_rng(3)
    sets = [np.sort(rng.choice(65536, n, replace=False)) for n in (0, 1, 5, 4095, 4096, 65536, 3, 30000, 0)]
    column = encode_containers(np.array(list(map(len, sets))), np.concatenate(sets))
    sizes, low = decode_containers(column)
    assert sizes.tolist() == list(map(len, sets)) and (low == np.concatenate(sets)).all()
    assert max(map(len, column.to_pylist())) == 8192
    assert decode_containers(column.slice(0, 0))[1].tolist() == []


@pytest.mark.parametrize("entries", [4_000_000, 1])
def test_documents(spark, plain, monkeypatch, entries):
    monkeypatch.setattr(alignment, "ENTRIES", entries)
    rows = documents()[:220]
    rows += [(70, "the the the the " * 9, None, None, None), (70, "the the the the " * 9, None, None, None), (71, "a▁b", None, None, None)]
    df = spark.createDataFrame(rows, DOCUMENTS).repartition(3)
    df = df.withColumn("pair", df.doc_id).withColumn("a.b", df.text).withColumn("container", df.lang)
    aligned = [plain.align(r[1] or "") for r in rows]
    docs, links = Counter(), Counter()
    for *_, found in aligned:
        docs.update(set(found))
        links.update(found)
    most = {}
    for (a, _), n in docs.items():
        most[a] = max(n, most.get(a, 0))
    want = Counter()
    for r, (a, b, groups, found) in zip(rows, aligned):
        best = sum(docs[p] == most[p[0]] for p in found)
        digest = sha256(groups.encode()).hexdigest() if groups else ""
        want[r[0], len(a), len(b), groups.count(";") + bool(groups), len(found), best, sum(docs[p] for p in found), digest] += 1
    out = align_tokenizers(df, *map(public.path, FILES))
    assert out.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert Counter(map(tuple, out.collect())) == want
    counted = pair_counts(pair_index(df, *map(public.path, FILES)), 32000).collect()
    assert {(r.a, r.b): (r.docs, r.links, r.best) for r in counted} == {p: (n, links[p], n == most[p[0]]) for p, n in docs.items()}
    assert sorted(r.groups for r in align_tokenizers(df, *map(public.path, FILES), groups=True).collect()) == sorted(x[2] for x in aligned)


def test_empty(spark):
    none = spark.createDataFrame([], DOCUMENTS)
    assert align_tokenizers(none, *map(public.path, FILES)).collect() == []
    blank = spark.createDataFrame([(1, None, None, None, None), (None, "", None, None, None)], DOCUMENTS)
    assert sorted(map(tuple, align_tokenizers(blank, *map(public.path, FILES)).collect()), key=str) == [(1, 0, 0, 0, 0, 0, 0, ""), (None, 0, 0, 0, 0, 0, 0, "")]
