"""The operators bound to the test tables with production settings: one query for each."""

from __future__ import annotations

from pyspark.sql import functions as F

from casemill.llm.alignment import align_tokenizers
from casemill.llm.bpe import bpe_round_trip
from casemill.llm.common import crc_fold, store
from casemill.llm.descent import link_vectors
from casemill.llm.filters import audit_filters
from casemill.llm.impact import search_products
from casemill.llm.language import fit_language, identify_language
from casemill.llm.minhash import near_duplicates
from casemill.llm.packing import pack_documents
from casemill.llm.quality import THRESHOLD, document_statistics, fit_quality, score_statistics
from casemill.llm.partitions import search_vectors
from casemill.llm.phrases import remove_repeated_words
from casemill.llm.secrets import scan_secrets
from casemill.llm.suffixes import remove_repeated_bytes

QUERIES = {}
ORACLES = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer(name):
    """A public tokenizer file; the package that holds them is installed on all executors."""
    import public_tokenizers

    return public_tokenizers.path(name)


@query
def op1_language_svm(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = fit_language(docs.filter(crc_fold(F.col("doc_id")) != 0))
    scored = identify_language(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", (crc_fold(F.col("doc_id")) == 0).alias("held_out"), "lang_pred", "score")


@query
def op2_phrase_automata(spark, sf_dir):
    return remove_repeated_words(table(spark, sf_dir, "documents"))


@query
def op3_secret_automaton(spark, sf_dir):
    return scan_secrets(table(spark, sf_dir, "documents"))


@query
def op4_pack_concat(spark, sf_dir):
    return pack_documents(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"))


@query
def op5_learned_partitions(spark, sf_dir):
    return search_vectors(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


@query
def op6_nn_descent(spark, sf_dir):
    return link_vectors(table(spark, sf_dir, "embeddings"))


@query
def op7_prefix_free_parsing(spark, sf_dir):
    return remove_repeated_bytes(table(spark, sf_dir, "documents"))


@query
def op8_circulant_minhash(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents"), size=3, percent=85)


@query
def op9_quality_fourier(spark, sf_dir):
    stats = store(document_statistics(table(spark, sf_dir, "documents")), "statistics")
    held_out = crc_fold(F.col("doc_id")) == 0
    model = fit_quality(stats.filter(~held_out), table(spark, sf_dir, "labels"))
    scored = score_statistics(stats, model)
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


@query
def op10_bpe_automaton(spark, sf_dir):
    return bpe_round_trip(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))


@query
def op11_pair_bitmaps(spark, sf_dir):
    return align_tokenizers(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"), tokenizer("piece_bpe_32k.model"))


@query
def op12_impact_index(spark, sf_dir):
    return search_products(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


ORACLES["op12_impact_index"] = """
WITH flat AS (
  SELECT vec_id, generate_subscripts(embedding, 1) AS place, unnest(embedding) AS value FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0
),
ints AS (
  SELECT vec_id, list(floor(1024 * CAST(value AS DOUBLE)) ORDER BY place) AS x FROM flat
  GROUP BY vec_id HAVING bool_and(value IS NOT NULL AND isfinite(value))
),
pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_dot_product(q.x, c.x) AS BIGINT) AS score
  FROM ints q JOIN ints c ON len(q.x) = len(c.x) AND q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0
),
ranked AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM pairs
)
SELECT * FROM ranked WHERE rank <= 10
"""


@query
def op13_removal_potential(spark, sf_dir):
    flags = {"good_lost": "quality = 1", "toxic_lost": "toxic = 1"}
    return audit_filters(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), flags)


ORACLES["op13_removal_potential"] = r"""
WITH texts AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
words AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w FROM texts),
firsts AS (SELECT t, min(coalesce(doc_id, 9223372036854775807)) AS first FROM texts GROUP BY t),
fails AS (
  SELECT part, doc_id,
    (CASE WHEN len(w) < 100 THEN 'A' ELSE '' END)
    || (CASE WHEN 100 * len(list_distinct(w)) < 80 * len(w) THEN 'B' ELSE '' END)
    || (CASE WHEN 100 * (length(words.t) - length(regexp_replace(words.t, '[A-Z]', '', 'g'))) > 10 * length(words.t) THEN 'C' ELSE '' END)
    || (CASE WHEN regexp_matches(words.t, '[#$%&*|]') THEN 'D' ELSE '' END)
    || (CASE WHEN coalesce(doc_id, 9223372036854775807) > first THEN 'E' ELSE '' END) AS failed
  FROM words JOIN firsts ON words.t = firsts.t
),
marks AS (
  SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic
  FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id
),
counted AS (
  SELECT part, failed, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic
  FROM fails LEFT JOIN marks ON fails.doc_id = marks.doc_id GROUP BY part, failed
),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
orders AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5
),
steps AS (
  SELECT filter_order, step, substr(filter_order, step, 1) AS own, substr(filter_order, 1, step - 1) AS earlier
  FROM orders, (SELECT unnest([1, 2, 3, 4, 5]) AS step)
),
seen AS (
  SELECT *, contains(failed, own) AS fails_own, translate(failed, earlier, '') <> failed AS gone FROM counted, steps
),
summed AS (
  SELECT part, filter_order, step, own,
    sum(CASE WHEN NOT fails_own AND NOT gone THEN n ELSE 0 END) AS kept,
    sum(CASE WHEN fails_own AND NOT gone THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN fails_own AND gone THEN n ELSE 0 END) AS redundant,
    sum(CASE WHEN failed = own THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN fails_own AND NOT gone THEN good ELSE 0 END) AS good_lost,
    sum(CASE WHEN fails_own AND NOT gone THEN toxic ELSE 0 END) AS toxic_lost
  FROM seen GROUP BY part, filter_order, step, own
)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
  CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost,
  CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley
FROM summed
"""
