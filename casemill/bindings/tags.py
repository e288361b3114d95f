"""Tagging and masking of the document texts."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from casemill.bindings.registry import query, table, texts
from casemill.operators.masking import mask_column
from casemill.operators.profile import mention_counts
from casemill.operators.tagging import (
    flagged_sentences,
    tag_entities,
    tag_gazetteer,
    tag_gazetteer_table,
    tag_with_hook,
    with_words,
)
from casemill.plans.outcomes import determination_sentences
from casemill.rules.defaults import ENTITY_LABELS

EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+"
PERSONAL = EMAIL + r"|[0-9a-f]{40}"

# One pattern per label that occurs in the test documents.
_STEMS = ["the", "tion", "ing", "der", "sch", "ent", "ion", "and", "eau", "que", "los", "ich", "her", "con", "ado"]
RULES = {label: f"[a-z]*{stem}[a-z]*" for label, stem in zip(ENTITY_LABELS, _STEMS, strict=True)}

# Terms of the gazetteer, two of them of two words.
TERMS = {
    "the": "ARTICLE",
    "der": "ARTICLE",
    "la": "ARTICLE",
    "of the": "PHRASE",
    "in the": "PHRASE",
    "and": "LINK",
    "und": "LINK",
    "et": "LINK",
}


@query(
    "tag_entities",
    "SELECT doc_id, "
    + ", ".join(f"array_to_string(regexp_extract_all(text, '{p}'), '|') AS \"{x}\"" for x, p in RULES.items())
    + " FROM documents",
)
def _(spark, sf):
    tagged = tag_entities(texts(spark, sf, "doc_id", "text"), "text", RULES)
    return tagged.select("doc_id", *[F.array_join(x, "|").alias(x) for x in RULES])


_TERM_ROWS = ", ".join(f"('{t}', '{x}')" for t, x in TERMS.items())
_GRAMS = r"""(SELECT doc_id, i AS pos, w[i] AS one, w[i] || ' ' || w[i + 1] AS two FROM (
    SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM (SELECT doc_id,
      list_filter(string_split(regexp_replace(lower(regexp_replace(text, '\s+', ' ', 'g')), '[^\p{L}\p{N} ]', ' ', 'g'), ' '),
        lambda x: x <> '') AS w FROM documents)))"""


@query(
    "tag_gazetteer",
    f"""WITH terms(term, label) AS (VALUES {_TERM_ROWS}),
        hits AS (SELECT doc_id, pos, term, label FROM {_GRAMS} g JOIN terms ON g.one = term OR g.two = term)
        SELECT d.doc_id, """
    + ", ".join(
        f"coalesce(string_agg(term, '|' ORDER BY pos, term) FILTER (WHERE label = '{x}'), '') AS \"{x}\""
        for x in sorted(set(TERMS.values()))
    )
    + " FROM documents d LEFT JOIN hits h USING (doc_id) GROUP BY d.doc_id",
)
def _(spark, sf):
    tagged = tag_gazetteer(texts(spark, sf, "doc_id", "text"), "doc_id", "text", TERMS)
    return tagged.select("doc_id", *[F.array_join(x, "|").alias(x) for x in sorted(set(TERMS.values()))])


_ITEM_GRAMS = _GRAMS.replace("doc_id", "item_id").replace("FROM documents", "FROM benchmark")


@query(
    "tag_gazetteer_table",
    f"""WITH terms AS (SELECT DISTINCT two AS term FROM {_ITEM_GRAMS} WHERE two IS NOT NULL)
        SELECT d.doc_id, coalesce(string_agg(two, '|' ORDER BY pos) FILTER (WHERE term IS NOT NULL), '') AS runs
        FROM documents d LEFT JOIN (SELECT * FROM {_GRAMS} g JOIN terms ON g.two = term) h USING (doc_id) GROUP BY d.doc_id""",
)
def _(spark, sf):
    """All runs of two words that the benchmark has, found in the documents."""
    words = with_words(table(spark, sf, "benchmark").select("text"), "text")
    runs = F.transform("_words", lambda w, i: F.slice("_words", i + 1, 2))
    pairs = words.select(F.explode(F.filter(runs, lambda r: F.size(r) == 2)).alias("run"))
    terms = pairs.select(F.array_join("run", " ").alias("term"), F.lit("RUN").alias("label")).distinct()
    tagged = tag_gazetteer_table(texts(spark, sf, "doc_id", "text"), "doc_id", "text", terms, ["RUN"], 2)
    return tagged.select("doc_id", F.array_join("RUN", "|").alias("runs"))


_TURNS = "conversations"


@query(
    "flagged_sentences",
    f"""SELECT conv_id, turn, array_to_string(regexp_extract_all(text, '[a-z]*tion[a-z]*'), '|') AS spans
        FROM {_TURNS} WHERE regexp_matches(text, '[a-z]*tion[a-z]*')""",
)
def _(spark, sf):
    turns = table(spark, sf, "conversations").select("conv_id", "turn", "text")
    flagged = flagged_sentences(turns, "text", "[a-z]*tion[a-z]*", "spans")
    return flagged.withColumn("spans", F.array_join("spans", "|"))


@query(
    "determination_sentences",
    """SELECT doc_id, CAST(i - 1 AS BIGINT) AS position, array_to_string(regexp_extract_all(tail[i], '[a-z]*tion[a-z]*'), '|') AS spans
       FROM (SELECT doc_id, tail, unnest(range(1, len(tail) + 1)) AS i FROM (SELECT doc_id,
         list_filter(string_split(text, chr(10)), lambda p: trim(p) <> '')[-10:] AS tail FROM documents))
       WHERE regexp_matches(tail[i], '[a-z]*tion[a-z]*')""",
)
def _(spark, sf):
    found = determination_sentences(texts(spark, sf, "doc_id", "text"), "doc_id", "text", "[a-z]*tion[a-z]*")
    return found.select(
        "doc_id",
        F.col("position").cast("bigint"),
        F.array_join("extracted_sentences_determination", "|").alias("spans"),
    )


def _make_email_tagger():
    pattern = re.compile(EMAIL)
    return lambda texts: [{"EMAIL": pattern.findall(t)} for t in texts]


@query(
    "tag_with_hook",
    f"SELECT doc_id, array_to_string(regexp_extract_all(text, '{EMAIL}'), '|') AS \"EMAIL\" FROM documents",
)
def _(spark, sf):
    known = texts(spark, sf, "doc_id", "text").filter(F.col("text").isNotNull())
    tagged = tag_with_hook(known, "text", ["EMAIL"], _make_email_tagger)
    return tagged.select("doc_id", F.array_join("EMAIL", "|").alias("EMAIL"))


@query(
    "mask_spans",
    f"""WITH spans AS (SELECT doc_id, text, regexp_extract_all(text, '{PERSONAL}') AS m,
          string_split_regex(text, '{PERSONAL}') AS rest FROM documents)
        SELECT doc_id, array_to_string(list_transform(range(1, len(rest) + 1), lambda i: rest[i] || coalesce(
          substr(m[i], 1, greatest(length(m[i]) - 20, 0)) || repeat('X', least(length(m[i]), 20)), '')), '') AS text
        FROM spans""",
)
def _(spark, sf):
    return mask_column(texts(spark, sf, "doc_id", "text"), "text", PERSONAL)


@query(
    "mention_counts",
    """SELECT place, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '[a-z]+tion')) AS place FROM documents)
       WHERE place <> 'ation' GROUP BY place""",
)
def _(spark, sf):
    tagged = tag_entities(texts(spark, sf, "text"), "text", {"GPE": "[a-z]+tion"})
    return mention_counts(tagged, "GPE", ["ation"])
