"""The whole pipeline against a plain version of each of its stages."""

import os
from collections import Counter
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

import corpus_pipeline as pipeline
from casemill.llm.common import crc_fold
from casemill.llm.phrases import kept_text
from casemill.llm.quality import THRESHOLD, document_statistics, fit_quality, statistics
from tests.llm.test_texts import covered, secrets_of, shingle_set

tokenizers = pytest.importorskip("tokenizers")
public = pytest.importorskip("public_tokenizers")
SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture
def folder(tmp_path):
    """The smallest test tables, and planted in them near copies of long documents, and a secret."""
    docs, labels = (pq.read_table(f"{SF}/{n}.parquet") for n in ("documents", "labels"))
    rows = docs.to_pylist()
    long = [r for r in rows if r["text"] and len(r["text"].split()) > 200][:12]
    for n, r in enumerate(long):
        rows.append(r | {"doc_id": 10_000 + n, "text": r["text"] + f" last{n}"})
    secret = " ".join(reversed(long[0]["text"].split()))
    rows.append(long[0] | {"doc_id": 11_000, "text": secret[:900] + ' password = "hunter2hunter2" ' + secret[900:]})
    pq.write_table(pa.Table.from_pylist(rows, docs.schema), tmp_path / "documents.parquet")
    pq.write_table(labels, tmp_path / "labels.parquet")
    return str(tmp_path)


def plain_quality(spark, folder, docs):
    """The learned model on each text, without Spark."""
    table = spark.read.parquet(f"{folder}/documents.parquet")
    stats = document_statistics(table.filter(crc_fold(table.doc_id) != 0))
    model = fit_quality(stats, spark.read.parquet(f"{folder}/labels.parquet"))
    scores = model.score(statistics([(t or "").encode() for _, t in docs]))
    return [d for d, s in zip(docs, scores) if s >= THRESHOLD]


def plain_near_dedup(docs):
    """All pairs; of what hangs together the smallest key stays."""
    sets = [shingle_set(t, 5) for _, t in docs]
    group = list(range(len(docs)))
    for i in range(len(docs)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if common and 100 * common >= 80 * (len(sets[i]) + len(sets[j]) - common):
                group = [group[j] if g == group[i] else g for g in group]
    least = {}
    for (key, _), g in zip(docs, group):
        least[g] = min(key, least.get(g, key))
    return [d for d, g in zip(docs, group) if d[0] == least[g]]


def plain_substring_dedup(docs):
    whole = covered(docs, 20, bytes.split, b" ".join)
    return [(k, t if t is None else kept_text(t.encode(), np.array(whole[k, t][1], dtype=bool)).decode()) for k, t in docs]


def plain_secret_scan(docs, kinds):
    """Spans that overlap or touch the one before go with it; each run of them is replaced by the kind of its first."""
    out = []
    for key, text in docs:
        parts, at = [], 0
        for start, kind, end in secrets_of(text or ""):
            if start >= at:
                parts += [text[at:start], f"<{kinds[kind]}>"]
            at = max(at, end)
        out.append((key, None if text is None else "".join(parts) + text[at:]))
    return out


def stored(df):
    return sorted((r.doc_id, r.text) for r in df.select("doc_id", "text").collect())


def test_stages_and_run(spark, folder):
    from casemill.llm.secrets import BASE_RULES, MORE_RULES

    kinds = [r.kind for r in BASE_RULES + MORE_RULES]
    rows = pq.read_table(f"{folder}/documents.parquet", columns=["doc_id", "text"]).to_pylist()
    docs = sorted((r["doc_id"], r["text"]) for r in rows)
    plain = [lambda d: plain_quality(spark, folder, d), plain_near_dedup, plain_substring_dedup, lambda d: plain_secret_scan(d, kinds)]
    df, sizes = spark.read.parquet(f"{folder}/documents.parquet"), [len(docs)]
    changed = []
    for (_, stage), check in zip(pipeline.STAGES[:-1], plain, strict=True):
        df = pipeline.store(stage(spark, df, folder), "stage")
        before, docs = dict(docs), check(docs)
        assert stored(df) == sorted(docs)
        sizes.append(len(docs))
        changed.append(sum(before[k] != t for k, t in docs))
    assert sizes[0] > sizes[1] > sizes[2] == sizes[3] == sizes[4] and changed[:2] == [0, 0] and changed[2] > 0 and changed[3] > 0

    library = tokenizers.Tokenizer.from_file(public.path("word_bpe_49k.json"))
    want = {k: np.array([*library.encode(t or "", add_special_tokens=False).ids, 2], dtype="<u4") for k, t in docs}
    packed = sorted(pipeline.run(spark, folder).collect(), key=lambda r: (r.sequence_id, r.offset))
    place, seen = 0, Counter()
    for r in packed:
        ids = want[r.doc_id][r.start : r.start + r.length]
        assert r.sequence_id * 4096 + r.offset == place and r.offset + r.length <= 4096
        assert r.start == seen[r.doc_id] and r.doc_tokens == len(want[r.doc_id]) and r.ids_crc32 == crc32(ids.tobytes())
        seen[r.doc_id] += r.length
        place += r.length
    assert seen == {k: len(x) for k, x in want.items()}
