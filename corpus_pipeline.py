"""From raw documents to packed sequences, as stages that are each written and read again."""

from __future__ import annotations

from pyspark.sql import functions as F

from casemill.llm.common import crc_fold, store
from casemill.llm.minhash import keep_one
from casemill.llm.packing import pack_documents
from casemill.llm.phrases import remove_repeated_words
from casemill.llm.quality import THRESHOLD, document_statistics, fit_quality, score_quality
from casemill.llm.queries import table, tokenizer
from casemill.llm.secrets import scan_secrets


def quality(spark, docs, sf_dir):
    """Documents that the classifier does not reject. It learns from the labels outside the held-out fold."""
    stats = store(document_statistics(docs.filter(crc_fold(F.col("doc_id")) != 0)), "statistics")
    model = fit_quality(stats, table(spark, sf_dir, "labels"))
    score = "score_" + "_".join(docs.columns)  # a name that no column has
    return score_quality(docs, model, column=score).filter(F.col(score) >= THRESHOLD).drop(score)


def near_dedup(spark, docs, sf_dir):
    """One document of each group of near duplicates: five words a shingle, similarity 0.8 or more."""
    return keep_one(docs)


def _with_text(found, docs, text):
    """The columns of ``docs`` with a new text and its length; a null text stays null."""
    where = {c: f"carried.`{c}`" for c in docs.columns} | {"doc_id": "doc_id"}
    new = F.when(F.col("carried.text").isNotNull(), F.col(text))
    columns = {"text": new, "n_chars": F.when(new.isNotNull(), F.length(new)).otherwise(F.col("carried.n_chars"))}
    return found.select(*((columns[c].cast(t) if c in columns else F.col(where[c])).alias(c) for c, t in docs.dtypes))


def substring_dedup(spark, docs, sf_dir):
    """All documents without the words that a passage of 20 words or more repeats."""
    rest = [c for c in docs.columns if c != "doc_id"]
    return _with_text(remove_repeated_words(docs, texts=True, carry=rest), docs, "kept")


def secret_scan(spark, docs, sf_dir):
    """All documents with secrets replaced by their kind."""
    rest = [c for c in docs.columns if c != "doc_id"]
    return _with_text(scan_secrets(docs, redact=True, carry=rest), docs, "redacted")


def packing(spark, docs, sf_dir):
    """The documents' ids in sequences of 4096."""
    # Executors have the stages before behind them, so a worker remembers fewer words than it could.
    return pack_documents(docs, tokenizer("word_bpe_49k.json"), remember=100_000)


STAGES = [
    ("quality", quality),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("secret_scan", secret_scan),
    ("packing", packing),
]
#: A trained model decides in the first stage and a tokenizer in the last; SQL can state neither.
ORACLE_SQL = None


def run(spark, sf_dir):
    """All stages on ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = store(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
