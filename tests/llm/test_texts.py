"""Operators on texts against brute force and against the libraries they stand for."""

import random
import re
from collections import Counter
from hashlib import sha256
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest

from casemill.llm import minhash, phrases, repeats, suffixes
from casemill.llm.common import one_batch
from casemill.llm.bpe import Codec, bpe_round_trip
from casemill.llm.minhash import keep_one, near_duplicates
from casemill.llm.packing import pack_documents
from casemill.llm.phrases import kept_text, remove_repeated_words
from casemill.llm.secrets import MORE_RULES, SecretScanner, scan_secrets
from casemill.llm.suffixes import remove_repeated_bytes, suffix_ranks
from tests.llm.fixtures import DOCUMENTS, documents, in_order

tokenizers = pytest.importorskip("tokenizers")
public = pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def rows():
    return documents()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCUMENTS).repartition(5)


def le32(ids):
    return np.array(ids, dtype="<u4").tobytes()


def test_bpe_equals_the_library(spark, rows, docs):
    library = tokenizers.Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    rng = random.Random(2)
    letters = "aab  \n\t'sétRe.,!?0123İſ中文🙂　tion\x1c"
    extra = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 50))) for _ in range(800)]
    extra += ["a<|endoftext|> b", "<|endoftext|><|endoftext|>", "can't  we'll 's", "aaaaaaaa" * 40]
    codec = Codec(public.path("byte_bpe_50k.json"))
    for text in extra + [r[1] or "" for r in rows]:
        ids = library.encode(text, add_special_tokens=False).ids
        assert codec.encode(text) == le32(ids)
        assert codec.decode(codec.encode(text)) == library.decode(ids, skip_special_tokens=False)
    want = Counter()
    for key, text, *_ in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids
        want[key, len(ids), sha256(le32(ids)).hexdigest(), sha256((text or "").encode()).hexdigest()] += 1
    assert Counter(map(tuple, bpe_round_trip(docs, public.path("byte_bpe_50k.json")).collect())) == want


def test_packing(spark, rows, docs):
    file = public.path("word_bpe_49k.json")
    library = tokenizers.Tokenizer.from_file(file)
    packed = pack_documents(docs, file, size=64, tokens=True).collect()
    want = Counter((k, tuple([*library.encode(t or "", add_special_tokens=False).ids, 2])) for k, t, *_ in rows)
    stream = sorted(packed, key=lambda r: (r.sequence_id, r.offset))
    place, whole, parts = 0, Counter(), []
    for r in stream:
        assert r.sequence_id * 64 + r.offset == place and 0 < r.length <= 64 - r.offset
        assert r.ids_crc32 == crc32(r.ids) and len(r.ids) == 4 * r.length
        assert r.start == sum(x.length for x in parts) and r.continues == bool(parts)
        parts.append(r)
        place += r.length
        if r.start + r.length == r.doc_tokens:
            whole[r.doc_id, tuple(np.frombuffer(b"".join(x.ids for x in parts), "<u4").tolist())] += 1
            parts = []
    assert not parts and whole == want


def test_groups_of_any_size_are_whole():
    """Three rows that share 800 MB each: beyond what one batch of 32-bit offsets holds."""
    data = pa.py_buffer(bytes(800 << 20))
    offsets = pa.py_buffer(np.array([0, 800 << 20], dtype=np.int32))
    row = pa.Array.from_buffers(pa.binary(), 1, [None, offsets, data])
    whole = one_batch([pa.RecordBatch.from_arrays([row, pa.array([i])], names=["x", "n"]) for i in range(3)])
    assert whole.column("n").to_pylist() == [0, 1, 2] and pc.sum(pc.binary_length(whole.column("x"))).as_py() == 3 * (800 << 20)
    assert one_batch([pa.RecordBatch.from_arrays([pa.array([], pa.list_(pa.binary()))], names=["x"])]) is None


def test_empty_tables(spark, docs):
    none = docs.limit(0)
    file = public.path("word_bpe_49k.json")
    for out in (
        bpe_round_trip(none, public.path("byte_bpe_50k.json")),
        pack_documents(none, file),
        scan_secrets(none),
        remove_repeated_words(none),
        remove_repeated_bytes(none),
        near_duplicates(none),
    ):
        assert out.collect() == []


ASSIGN = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def secrets_of(text):
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[1]) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    for k, rule in enumerate(MORE_RULES, 3):
        out += [(m.start(), k, m.end()) for m in re.finditer(rule.find, text) if not rule.keep or re.fullmatch(rule.keep, m[0])]
    return sorted(out)


def test_secrets(spark, rows, docs):
    rng = random.Random(3)
    bits = ["password", "Passwd", "token", "api_key", "APIKEY", " ", ":", "=", "'", '"', "abc", "abcdef12", "AKIA", "AKIA" + "Z" * 9, "0123456789abcdef0", "deadbeef" * 3, "é", "ſecret", "\n", "ghp_" + "a1" * 18, "xoxb-", "-----BEGIN RSA PRIVATE KEY-----", "sk_live_" + "9" * 20, "-", "_"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 14))) for _ in range(3000)] + ["0" * 50_000, ""]
    scanner = SecretScanner()
    found = scanner.scan([t.encode() for t in texts])
    for text, spans in zip(texts, found):
        data = text.encode()
        assert [(len(data[:a].decode()), r, len(data[:b].decode())) for a, r, b in spans] == secrets_of(text)
    kinds = [r.kind for r in scanner.rules]
    want = Counter()
    for key, text, *_ in rows:
        spans = secrets_of(text or "")
        name = lambda x: f"{kinds[x[1]]}:{x[0]}:{x[2]}"
        base = ",".join(map(name, (x for x in spans if x[1] < 3)))
        counts = [sum(x[1] == k for x in spans) for k in range(3)]
        want[key, *counts, sha256(base.encode()).hexdigest(), ",".join(map(name, spans))] += 1
    assert Counter(map(tuple, scan_secrets(docs).collect())) == want


def test_redaction_keeps_the_rest(spark):
    df = spark.createDataFrame([(1, "é token=abcdef99 end", 5), (2, None, 6)], "doc_id long, text string, spans_ int")
    out = {r.doc_id: (r.redacted, r.carried.spans_) for r in scan_secrets(df, redact=True, carry=["spans_"]).collect()}
    assert out == {1: ("é <assign> end", 5), 2: (None, 6)}


def covered(rows, width, split, join):
    """Rows of one key and one text are one document."""
    order = {}
    for key, text, *_ in in_order(rows):
        order.setdefault(key, {}).setdefault(text or "", None)
    seen, out = set(), {}
    for key, texts in order.items():
        for text in texts:
            symbols = split(text.encode())
            gone = [False] * len(symbols)
            for i in range(len(symbols) - width + 1):
                window = join(symbols[i : i + width])
                if window in seen:
                    gone[i : i + width] = [True] * width
                seen.add(window)
            out[key, text] = symbols, gone
    return out


def one_text_a_key(rows):
    seen = {}
    return [r for r in rows if seen.setdefault(r[0], r[1]) == r[1]]


@pytest.mark.parametrize("crowd", [(16, 400), (2, 3)])
def test_repeated_words_and_bytes(spark, rows, crowd, monkeypatch):
    monkeypatch.setattr(repeats, "CROWD", crowd[0])
    monkeypatch.setattr(phrases, "HOT", crowd[1])
    monkeypatch.setattr(suffixes, "HOT", crowd[1])
    rows = one_text_a_key(rows)
    df = spark.createDataFrame(rows, DOCUMENTS).repartition(3)
    for remove, width, split, join in (
        (remove_repeated_words, 20, bytes.split, b" ".join),
        (remove_repeated_bytes, 100, lambda x: [x[i : i + 1] for i in range(len(x))], b"".join),
    ):
        whole = covered(rows, width, split, join)
        want = Counter()
        for key, text, *_ in rows:
            symbols, gone = whole[key, text or ""]
            kept = join([s for s, g in zip(symbols, gone) if not g])
            want[key, len(symbols), sum(gone), sha256(kept).hexdigest()] += 1
        out = remove(df)
        got = Counter((r[0], r[1], r[2], r[-1]) for r in out.collect())
        assert got == want
        assert sum(r[2] for r in want) > 0


def test_several_texts_of_one_key(spark):
    text = " ".join(map(str, range(30)))
    df = spark.createDataFrame([(1, text), (1, text), (1, text + " x"), (None, text)], "doc_id long, text string")
    out = Counter((r.doc_id, r.n_words, r.n_removed) for r in remove_repeated_words(df).collect())
    assert out in (Counter({(1, 30, 0): 2, (1, 31, 30): 1, (None, 30, 30): 1}), Counter({(1, 30, 30): 2, (1, 31, 0): 1, (None, 30, 30): 1}))


def test_kept_text():
    assert kept_text(b" a\n b  c d ", np.array([False, True, False, True])) == b"a  c"
    assert kept_text(b"a b", np.array([True, False])) == b"b"


def test_suffix_ranks():
    rng = np.random.default_rng(1)
    data = rng.integers(97, 99, 300).astype(np.uint8)
    ranks = suffix_ranks(data, 10)
    text = data.tobytes()
    order = sorted({text[i : i + 10].ljust(10, b"\0") for i in range(300)})
    assert [order.index(text[i : i + 10].ljust(10, b"\0")) for i in range(300)] == ranks.tolist()


def shingle_set(text, size):
    words = (text or "").encode().lower().split()
    return frozenset([tuple(words)] if 0 < len(words) < size else [tuple(words[i : i + size]) for i in range(len(words) - size + 1)])


@pytest.mark.parametrize("block", [1000, 10])
def test_near_duplicates(spark, rows, docs, block, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", block)
    sets = [shingle_set(r[1], 3) for r in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if common and 100 * common >= 85 * (len(sets[i]) + len(sets[j]) - common):
                a, b = group[i], group[j]
                group = [b if g == a else g for g in group]
    last = float("inf")
    keys = [last if r[0] is None else r[0] for r in rows]
    least = {}
    for g, k in zip(group, keys):
        least[g] = min(least.get(g, last), k)
    want = Counter((r[0], len(s), None if least[g] == last else least[g], k == least[g]) for r, s, g, k in zip(rows, sets, group, keys))
    out = near_duplicates(docs, size=3, percent=85).select("doc_id", "n_shingles", "component_id", "kept")
    assert Counter(map(tuple, out.collect())) == want


def test_keep_one_keeps_rows_without_words(spark):
    rows = [(None, None, "a"), (None, "", "b"), (None, None, "a"), (3, " \n\t", "c"), (3, " \n\t", "d"), (4, "x y z", "e"), (4, "x y z", "f"), (5, "\u00a0", "g")]
    df = spark.createDataFrame(rows, "doc_id long, text string, other string")
    out = sorted(r.other for r in keep_one(df).collect())
    assert out[:5] == ["a", "a", "b", "c", "d"] and out[5] in ("e", "f") and out[6:] == ["g"]


def test_keep_one(spark):
    text = " ".join(map(str, range(60)))
    rows = [(4, text, 1), (4, text, 1), (2, text + " x", 2), (9, "other words", 3), (8, "", 4), (7, None, 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, _hash long")
    assert sorted((r.doc_id, r._hash) for r in keep_one(df).collect()) == [(2, 2), (7, 5), (8, 4), (9, 3)]
