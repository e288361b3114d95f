"""Entity tagging: pattern rules, a gazetteer, or a batch function of the user."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from casemill.functions.arrays import empty_texts, let
from casemill.functions.text import all_matches, first_match, normalize_text
from casemill.operators.joins import literal_table
from casemill.rules.defaults import (
    COVER_RULES,
    ENTITY_RULES,
    HEARING_MODE_PATTERN,
    HEARING_TYPE_PATTERN,
)
from casemill.workdir import materialize


# Gazetteer terms that are looked up inside the row.
INLINE_TERMS = 2000


# A rule for a stem in a run of characters of one class, such as [a-z]*tion[a-z]* or [a-z]+ing.
_STEM_RULE = re.compile(r"(\[(?:[A-Za-z0-9]-[A-Za-z0-9]|[A-Za-z0-9_])+\])([*+])([A-Za-z0-9_]+)(?:\1([*+]))?")
# So many different rules of one class share its runs; fewer are searched for faster one by one.
STEM_RULES = 2


def _stem_rule(pattern: str) -> re.Match | None:
    found = _STEM_RULE.fullmatch(pattern)
    return found if found and re.fullmatch(f"{found[1]}+", found[3]) else None


def _stem_matches(runs: Column, rule: re.Match) -> Column:
    """All matches of a stem rule from the runs of its class: each match lies in one run, and a run has one at most."""
    held = F.filter(runs, lambda run: F.contains(run, F.lit(rule[3])))
    if (rule[2], rule[4]) != ("*", "*"):  # else the match is the run
        held = F.filter(F.transform(held, lambda run: F.regexp_extract(run, rule[0], 0)), lambda m: m != "")
    return F.coalesce(held, empty_texts())


def tag_entities(df: DataFrame, text: str, rules: dict[str, str] = ENTITY_RULES) -> DataFrame:
    """One ``array<string>`` column per label; empty when nothing matches.

    A pattern of several labels is searched for once. Rules for stems (``STEM_RULES`` or more of one class of characters)
    are looked up in the runs of that class, which are cut out of a text once for all of them: the search for such a
    pattern begins anew at each character of each run, and does so for each rule.
    """
    patterns = list(dict.fromkeys(rules.values()))
    stems = {p: found for p in patterns if (found := _stem_rule(p))}
    shared = [c for c, n in Counter(found[1] for found in stems.values()).items() if n >= STEM_RULES]
    stems = {p: found for p, found in stems.items() if found[1] in shared}
    if not shared and len(patterns) == len(rules):
        return df.select("*", *[all_matches(F.col(text), p).alias(label) for label, p in rules.items()])
    taken = {c.lower() for c in [*df.columns, *rules]}
    mark = "_"  # of names that no column has
    while any(c.startswith(mark) for c in taken):
        mark += "_"
    runs = {c: f"{mark}runs{i}" for i, c in enumerate(shared)}
    found = {p: f"{mark}found{i}" for i, p in enumerate(patterns)}
    cut = df.select("*", *[F.regexp_extract_all(F.col(text), F.lit(f"{c}+"), F.lit(0)).alias(name) for c, name in runs.items()])
    searched = cut.select(
        "*",
        *[(_stem_matches(F.col(runs[stems[p][1]]), stems[p]) if p in stems else all_matches(F.col(text), p)).alias(name) for p, name in found.items()],
    )
    return searched.select("*", *[F.col(found[p]).alias(label) for label, p in rules.items()]).drop(*runs.values(), *found.values())


def tag_cover(
    df: DataFrame,
    text: str,
    rules: dict[str, str] = COVER_RULES,
    hearing_type: str = HEARING_TYPE_PATTERN,
    hearing_mode: str = HEARING_MODE_PATTERN,
) -> DataFrame:
    """Cover entities and the hearing flags."""
    names = {
        "DATE": "extracted_dates",
        "GPE": "extracted_gpe",
        "ORG": "extracted_org",
        "PERSON": "extracted_persons",
    }
    tagged = tag_entities(df, text, {name: rules[label] for label, name in names.items()})
    return tagged.select(
        "*",
        first_match(F.col(text), f"(?i){hearing_type}").alias("public_private_hearing"),
        first_match(F.col(text), f"(?i){hearing_mode}").alias("in_chamber_virtual"),
    )


def flagged_sentences(df: DataFrame, text: str, pattern: str, found: str) -> DataFrame:
    """Rows with at least one span of one label, with the spans instead of the text. Texts without a match are
    left out by one look; the others are searched once."""
    matching = df.filter(F.col(text).rlike(pattern))
    return matching.withColumn(found, all_matches(F.col(text), pattern)).drop(text)


def with_words(df: DataFrame, text: str) -> DataFrame:
    """All columns and, as ``_words``, the words that terms are looked up in."""
    clean = F.regexp_replace(normalize_text(F.coalesce(F.col(text), F.lit(""))), r"[^\p{L}\p{N} ]", " ")
    return df.withColumn("_words", F.filter(F.split(clean, " "), lambda w: w != ""))


def _word_grams(df: DataFrame, text: str, lengths: list[int], openers: list[str]) -> DataFrame:
    """All columns and, as ``_grams``, the word n-grams of some lengths at each word, in text order.

    Words that are no ``openers`` open no term and get an empty array, so almost no n-gram is built.
    """
    sizes = F.array(*[F.lit(n) for n in lengths])

    def starting_at(i):
        fitting = F.filter(sizes, lambda n: i + n <= F.size("_words"))
        return F.transform(fitting, lambda n: F.array_join(F.slice("_words", i + 1, n), " "))

    grams = let(
        F.array_intersect("_words", F.array(*[F.lit(w) for w in openers])),
        lambda found: F.transform(
            "_words",
            lambda w, i: F.when(F.array_contains(found, w), starting_at(i)).otherwise(empty_texts()),
        ),
    )
    return with_words(df, text).withColumn("_grams", grams).drop("_words")


def _known_terms(terms: list[str]) -> Column:
    """The n-grams that are terms: their distinct set by hash first, then all occurrences."""
    known = F.array_intersect("_grams", F.array(*[F.lit(t) for t in terms]))
    return let(known, lambda k: F.filter("_grams", lambda g: F.array_contains(k, g)))


def tag_gazetteer(
    df: DataFrame, key: str, text: str, terms: dict[str, str], inline_terms: int = INLINE_TERMS
) -> DataFrame:
    """``key`` and one array of found terms per label, in text order: one row for each row, also for rows
    with one key or without a text, whose arrays are empty.

    ``terms`` maps a lower-case term of one or more words to its label. Up to ``inline_terms`` terms are
    looked up inside the row, without a shuffle; more terms become a table. The result is the same.
    """
    labels = sorted(set(terms.values()))
    if len(terms) > inline_terms:
        columns = {"term": list(terms), "label": list(terms.values())}
        table = literal_table(df.sparkSession, columns, dict.fromkeys(columns, "string"))
        return tag_gazetteer_table(df, key, text, table, labels, max(len(t.split(" ")) for t in terms))
    grams = _word_grams(
        df.select(key, text),
        text,
        sorted({len(term.split(" ")) for term in terms}),
        sorted({term.split(" ")[0] for term in terms}),
    )
    flat = grams.select(key, F.flatten("_grams").alias("_grams"))
    found = {x: _known_terms([t for t, y in terms.items() if y == x]) for x in labels}
    return flat.select(key, *[c.alias(x) for x, c in found.items()])


def _candidates(df: DataFrame, key: str, text: str, terms: DataFrame, longest: int) -> DataFrame:
    """A row for each word run that may be a term: ``term``, its place ``_pos``, and the number ``_row`` and the key of its row.

    A first look goes to an index of the words that open a term, each with the lengths of its terms; only runs of such a
    length at such a word are built. Of every row one run stays without that, its first, so that no row is lost.
    """
    parts = F.split("term", " ")
    openers = terms.select(parts[0].alias("_word"), F.size(parts).alias("_size")).groupBy("_word").agg(F.collect_set("_size").alias("_sizes"))
    numbered = with_words(df.select(key, text).withColumn("_row", F.monotonically_increasing_id()), text)
    runs = F.transform("_words", lambda w, i: F.slice("_words", i + 1, F.lit(longest)))
    words = numbered.select(key, "_row", F.posexplode_outer(runs).alias("_pos", "_run"))
    opening = words.withColumn("_word", F.element_at("_run", 1)).join(openers, "_word", "left")
    kept = opening.filter(F.col("_sizes").isNotNull() | (F.coalesce("_pos", F.lit(0)) == 0))
    fitting = F.filter("_sizes", lambda n: n <= F.size("_run"))
    found = F.transform(fitting, lambda n: F.array_join(F.slice("_run", F.lit(1), n), " "))
    return kept.select(key, "_row", "_pos", F.posexplode_outer(found).alias("_nth", "term"))


def tag_gazetteer_table(
    df: DataFrame, key: str, text: str, terms: DataFrame, labels: list[str], longest: int
) -> DataFrame:
    """``tag_gazetteer`` with a table ``term``, ``label`` of any size, whose terms have ``longest`` words at most.

    Words that open no term, and runs of a length that no term of their first word has, are left out before terms are
    looked up; no term is part of the plan. What is looked up is stored first, in one job when this is called, each
    row under a number, so that its hits come together again whatever its key, and whichever tasks run again. Common runs
    that are no terms leave with the join, and adaptive execution splits those that are.
    """
    known = terms.select("term", "label").distinct()
    grams = materialize(_candidates(df, key, text, known, longest), "candidates")
    # The first run of a row is kept without a hit too.
    first = (F.coalesce("_pos", F.lit(0)) == 0) & (F.coalesce("_nth", F.lit(0)) == 0)
    hits = grams.join(known, "term", "left").filter(F.col("label").isNotNull() | first)
    hit = F.struct("_pos", F.length("term").alias("_size"), "term")
    per_label = [
        F.transform(
            F.array_sort(F.collect_list(F.when(F.col("label") == x, hit))), lambda h: h["term"]
        ).alias(x)
        for x in labels
    ]
    return hits.groupBy("_row").agg(F.first(key).alias(key), *per_label).drop("_row")


def tag_with_hook(
    df: DataFrame,
    text: str,
    labels: list[str],
    make_tagger: Callable[[], Callable[[list[str]], list[dict[str, list[str]]]]],
) -> DataFrame:
    """Tag with the user's own batch function, in Arrow batches.

    ``make_tagger`` runs once per task and returns the function that maps a batch of texts to one
    dictionary ``label -> spans`` each, so that a model is loaded once and not per row. Filter rows
    before this step: Spark cannot move a filter through it.
    """
    schema = T.StructType(
        df.schema.fields + [T.StructField(x, T.ArrayType(T.StringType())) for x in labels]
    )

    def tag(batches):
        tagger = make_tagger()
        for batch in batches:
            found = tagger(batch[text].fillna("").tolist())
            columns = {x: pd.Series([f.get(x, []) for f in found], dtype=object) for x in labels}
            yield batch.assign(**{x: s.set_axis(batch.index) for x, s in columns.items()})

    return df.mapInPandas(tag, schema)
