"""Row filters, casts, null handling, joins, set operations, splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from casemill.bindings.registry import query, table
from casemill.bindings.scores import binned, scored
from casemill.functions.arrays import sorted_distinct
from casemill.functions.keys import lenient_key, nullable_key, strict_key
from casemill.functions.text import paragraphs
from casemill.operators.cleaning import (
    decided_only,
    drop_incomplete,
    drop_values,
    map_values,
    null_markers,
    rename_features,
)
from casemill.operators.joins import (
    dimension_counts,
    gold_join,
    hot_keys,
    label_join,
    left_join_fill,
    literal_table,
    natural_outer_join,
    salted_join,
)
from casemill.operators.outcomes import case_votes, duplicate_rows, duplicate_totals
from casemill.operators.sampling import (
    first_rows,
    last_rows,
    last_write_wins,
    oversample,
    shuffle_rows,
    split_by_hash,
    split_exact,
)
from casemill.plans.outcomes import tail_sentences
from casemill.rules.defaults import NO_KEY, OUTCOME_NAMES


def docs(spark, sf):
    return table(spark, sf, "documents")


def labels(spark, sf):
    return table(spark, sf, "labels")


def raw_keys(spark, sf):
    """Document keys as files would hold them: plain, as a float, a marker, or missing."""
    key = F.col("doc_id").cast("string")
    return docs(spark, sf).select(
        "doc_id",
        F.when(F.col("lang") == "en", key)
        .when(F.col("lang") == "fr", F.concat(key, F.lit(".0")))
        .when(F.col("lang") == "de", F.lit(NO_KEY))
        .alias("raw_id"),
    )


_RAW_KEYS = """(SELECT doc_id, CASE lang WHEN 'en' THEN CAST(doc_id AS VARCHAR)
    WHEN 'fr' THEN CAST(doc_id AS VARCHAR) || '.0' WHEN 'de' THEN 'no_match_filename' END AS raw_id
    FROM documents)"""


def sentences(spark, sf):
    """Non-blank paragraphs of all documents with their position."""
    return docs(spark, sf).select("doc_id", F.posexplode(paragraphs(F.col("text"))).alias("position", "text"))


def long_documents(spark, sf):
    """Documents of very many sentences, told by their length: no text is read."""
    return hot_keys(docs(spark, sf).select("doc_id", "n_chars"), ["doc_id"], weight=F.coalesce(F.col("n_chars") / 100, F.lit(0)) + 1)


_SENTENCES = """(SELECT doc_id, i - 1 AS position, parts[i] AS text FROM (
    SELECT doc_id, parts, unnest(range(1, len(parts) + 1)) AS i FROM (
      SELECT doc_id, list_filter(string_split(text, chr(10)), lambda p: trim(p) <> '') AS parts FROM documents)))"""


@query("select_features", "SELECT doc_id, text, lang FROM documents")
def _(spark, sf):
    return docs(spark, sf).drop("source", "n_chars")


@query(
    "rename_features",
    """SELECT doc_id, text AS "TRIBUNAL", lang AS "LOC_HEARING", source AS "JUDGE" FROM documents""",
)
def _(spark, sf):
    extracted = docs(spark, sf).select(
        "doc_id",
        F.col("text").alias("extracted_org"),
        F.col("lang").alias("extracted_gpe"),
        F.col("source").alias("judge_name"),
    )
    return rename_features(extracted)


@query(
    "cast_strict",
    """SELECT doc_id, CAST(raw_id AS BIGINT) AS decision_id FROM
       (SELECT doc_id, CASE WHEN lang = 'de' THEN 'no_match_filename' ELSE CAST(doc_id AS VARCHAR) END AS raw_id FROM documents)
       WHERE raw_id <> 'no_match_filename'""",
)
def _(spark, sf):
    raw = docs(spark, sf).select(
        "doc_id",
        F.when(F.col("lang") == "de", NO_KEY).otherwise(F.col("doc_id").cast("string")).alias("raw_id"),
    )
    kept = drop_values(raw, "raw_id", [NO_KEY])
    return kept.select("doc_id", strict_key(F.col("raw_id")).alias("decision_id"))


@query(
    "coerce_key",
    f"SELECT doc_id, CAST(coalesce(try_cast(raw_id AS DOUBLE), 0) AS BIGINT) AS decision_id FROM {_RAW_KEYS}",
)
def _(spark, sf):
    return raw_keys(spark, sf).select("doc_id", lenient_key(F.col("raw_id")).alias("decision_id"))


@query(
    "coerce_key_nullable",
    f"SELECT doc_id, CAST(round(try_cast(raw_id AS DOUBLE)) AS BIGINT) AS decision_id FROM {_RAW_KEYS}",
)
def _(spark, sf):
    return raw_keys(spark, sf).select("doc_id", nullable_key(F.col("raw_id")).alias("decision_id"))


@query(
    "sentinel_filter",
    f"SELECT doc_id, raw_id FROM {_RAW_KEYS} WHERE raw_id IS NULL OR raw_id <> 'no_match_filename'",
)
def _(spark, sf):
    return drop_values(raw_keys(spark, sf), "raw_id", [NO_KEY])


def partly_labelled(spark, sf):
    return docs(spark, sf).select("doc_id", "lang").join(labels(spark, sf), "doc_id", "left")


@query(
    "drop_incomplete_rows",
    "SELECT doc_id, lang, CAST(quality AS BIGINT) AS quality, CAST(toxic AS BIGINT) AS toxic FROM documents JOIN labels USING (doc_id) WHERE quality IS NOT NULL AND toxic IS NOT NULL",
)
def _(spark, sf):
    kept = drop_incomplete(partly_labelled(spark, sf))
    return kept.select("doc_id", "lang", F.col("quality").cast("bigint"), F.col("toxic").cast("bigint"))


@query(
    "drop_unlabelled",
    "SELECT doc_id, lang, CAST(quality AS BIGINT) AS quality FROM documents JOIN labels USING (doc_id) WHERE quality IS NOT NULL",
)
def _(spark, sf):
    kept = drop_incomplete(partly_labelled(spark, sf), ["quality"])
    return kept.select("doc_id", "lang", F.col("quality").cast("bigint"))


@query(
    "non_null_text",
    "SELECT doc_id, text FROM (SELECT doc_id, CASE WHEN lang <> 'es' THEN text END AS text FROM documents) WHERE text IS NOT NULL",
)
def _(spark, sf):
    partly = docs(spark, sf).select("doc_id", F.when(F.col("lang") != "es", F.col("text")).alias("text"))
    return drop_incomplete(partly, ["text"])


@query(
    "null_markers",
    """SELECT doc_id, CASE WHEN lang = 'en' THEN text END AS org, CASE WHEN lang IN ('en', 'fr') THEN source END AS place
       FROM documents""",
)
def _(spark, sf):
    lang = F.col("lang")
    cells = docs(spark, sf).select(
        "doc_id",
        F.when(lang == "en", F.col("text")).when(lang == "fr", "[]").when(lang == "de", "[None]").otherwise("''").alias("org"),
        F.when(lang.isin("en", "fr"), F.col("source")).otherwise("").alias("place"),
    )
    return null_markers(cells, ["org", "place"])


@query(
    "default_fill",
    """SELECT doc_id, coalesce(CAST(quality AS BIGINT), 0) AS quality,
       coalesce(CASE WHEN toxic = 1 THEN 'toxic' END, 'in chambers') AS mode
       FROM documents LEFT JOIN labels USING (doc_id)""",
)
def _(spark, sf):
    cells = partly_labelled(spark, sf).select(
        "doc_id", F.col("quality").cast("bigint"), F.when(F.col("toxic") == 1, "toxic").alias("mode")
    )
    return cells.na.fill({"quality": 0, "mode": "in chambers"})


@query(
    "map_labels",
    """SELECT doc_id, CASE quality WHEN 0 THEN 'REJECTED' WHEN 1 THEN 'GRANTED' END AS label,
       CASE CASE toxic WHEN 0 THEN 'NEGATIVE' ELSE 'POSITIVE' END WHEN 'NEGATIVE' THEN 'REJECTED' ELSE 'GRANTED' END AS prediction
       FROM labels""",
)
def _(spark, sf):
    predicted = F.when(F.col("toxic") == 0, "NEGATIVE").otherwise("POSITIVE")
    return labels(spark, sf).select(
        "doc_id",
        map_values(F.col("quality"), OUTCOME_NAMES).alias("label"),
        map_values(predicted, {"NEGATIVE": "REJECTED", "POSITIVE": "GRANTED"}).alias("prediction"),
    )


# Joins ---------------------------------------------------------------------------------------


@query(
    "left_join_fill",
    """SELECT doc_id, lang, coalesce(CAST(quality AS BIGINT), 0) AS quality, coalesce(CAST(toxic AS BIGINT), 0) AS toxic
       FROM documents LEFT JOIN labels USING (doc_id)""",
)
def _(spark, sf):
    judged = labels(spark, sf).select("doc_id", F.col("quality").cast("bigint"), F.col("toxic").cast("bigint"))
    covers = docs(spark, sf).select("doc_id", "lang")
    return left_join_fill(covers, judged, "doc_id", {"quality": 0, "toxic": 0})


@query(
    "gold_join",
    f"""SELECT doc_id, CAST(position AS BIGINT) AS position, text, CAST(quality AS BIGINT) AS decision
        FROM {_SENTENCES} JOIN labels USING (doc_id)""",
)
def _(spark, sf):
    gold = labels(spark, sf).select("doc_id", F.col("quality").cast("bigint").alias("decision"))
    silver = sentences(spark, sf).withColumn("position", F.col("position").cast("bigint"))
    return gold_join(silver, gold, "doc_id", hot=long_documents(spark, sf))


@query(
    "label_join",
    f"""SELECT CAST(try_cast(raw_id AS DOUBLE) AS BIGINT) AS doc_id, CAST(quality AS BIGINT) AS decision_outcome
        FROM (SELECT raw_id FROM {_RAW_KEYS}) k JOIN labels l ON l.doc_id = CAST(try_cast(raw_id AS DOUBLE) AS BIGINT)""",
)
def _(spark, sf):
    features = raw_keys(spark, sf).select(nullable_key(F.col("raw_id")).alias("doc_id"))
    outcomes = labels(spark, sf).select("doc_id", F.col("quality").cast("bigint").alias("decision_outcome"))
    return label_join(features, outcomes, "doc_id", "decision_outcome")


@query(
    "feature_outer_join",
    f"""WITH main AS (SELECT doc_id AS decision_id, CAST(coalesce(quality, 2) AS BIGINT) AS decision_outcome,
          position, text FROM {_SENTENCES} LEFT JOIN labels USING (doc_id)),
        cover AS (SELECT page_id AS decision_id, CAST(1 AS BIGINT) AS decision_outcome, url FROM pages)
        SELECT decision_id, decision_outcome, CAST(position AS BIGINT) AS position, text, url
        FROM main FULL OUTER JOIN cover USING (decision_id, decision_outcome)""",
)
def _(spark, sf):
    known = labels(spark, sf).select("doc_id", "quality")
    hot = long_documents(spark, sf)
    key = [F.col("doc_id").alias("decision_id"), F.coalesce("quality", F.lit(2)).cast("bigint").alias("decision_outcome")]
    joined = salted_join(sentences(spark, sf), known, ["doc_id"], "left", hot=hot)
    main = joined.select(*key, F.col("position").cast("bigint").alias("position"), "text")
    # The keys of the sentences, without making or joining sentences.
    filled = docs(spark, sf).filter(F.size(paragraphs(F.col("text"))) > 0).select("doc_id")
    keys = filled.join(known, "doc_id", "left").select(*key)
    cover = table(spark, sf, "pages").select(
        F.col("page_id").alias("decision_id"), F.lit(1).cast("bigint").alias("decision_outcome"), "url"
    )
    return natural_outer_join(main, cover, hot=hot.withColumnRenamed("doc_id", "decision_id"), keys=keys)


# Members with a code; the others are unknown to the code table.
_CODED = [f"NATION_{i}" for i in range(22)]


@query(
    "dim_left_join",
    """WITH members AS (SELECT n_nationkey, n_name, 'N' || lpad(CAST(n_nationkey AS VARCHAR), 2, '0') AS code
         FROM nation WHERE n_name <> 'NATION_0' AND n_nationkey < 22),
       counted AS (SELECT s_nationkey AS n_nationkey, count(*) AS n FROM supplier GROUP BY 1),
       joined AS (SELECT n_name, code, coalesce(n, 0) AS occurrences FROM members LEFT JOIN counted USING (n_nationkey))
       SELECT n_name, code, occurrences, min(occurrences) OVER () AS least, max(occurrences) OVER () AS most FROM joined""",
)
def _(spark, sf):
    nation = table(spark, sf, "nation").select("n_nationkey", "n_name")
    codes = literal_table(
        spark,
        {"n_name": _CODED, "code": [f"N{i:02d}" for i in range(len(_CODED))]},
        {"n_name": "string", "code": "string"},
    )
    members = nation.join(codes, "n_name", "left")
    counted = (
        table(spark, sf, "supplier")
        .groupBy(F.col("s_nationkey").alias("n_nationkey"))
        .agg(F.count(F.lit(1)).alias("occurrences"))
        .join(nation, "n_nationkey")
        .select("n_name", "occurrences")
    )
    joined = dimension_counts(members, counted, "n_name", "occurrences", "code", ["NATION_0"]).select(
        "n_name", "code", "occurrences"
    )
    ends = joined.agg(F.struct(F.min("occurrences").alias("least"), F.max("occurrences").alias("most"))).scalar()
    return joined.select("*", ends["least"].alias("least"), ends["most"].alias("most"))


# Row sets ------------------------------------------------------------------------------------


@query(
    "duplicate_rows",
    """SELECT event_id, user_id FROM (SELECT event_id, user_id,
         count(*) OVER (PARTITION BY user_id * 10000 + month(ts) * 100 + day(ts)) AS n FROM events) WHERE n > 1""",
)
def _(spark, sf):
    cases = scored(spark, sf).select("event_id", "user_id", "decision_id")
    return duplicate_rows(cases, "decision_id").select("event_id", "user_id")


@query(
    "single_rows",
    """SELECT event_id, user_id FROM (SELECT event_id, user_id,
         count(*) OVER (PARTITION BY user_id * 10000 + month(ts) * 100 + day(ts)) AS n FROM events) WHERE n = 1""",
)
def _(spark, sf):
    cases = scored(spark, sf).select("event_id", "user_id", "decision_id")
    return duplicate_rows(cases, "decision_id", keep="unique").select("event_id", "user_id")


@query(
    "duplicate_totals",
    """SELECT CAST(coalesce(sum(CASE WHEN n > 1 THEN n END), 0) AS BIGINT) AS duplicate_rows, count(CASE WHEN n = 1 THEN 1 END) AS single_rows
       FROM (SELECT count(*) AS n FROM events GROUP BY user_id * 10000 + month(ts) * 100 + day(ts))""",
)
def _(spark, sf):
    return duplicate_totals(scored(spark, sf), "decision_id")


@query(
    "tail_paragraphs",
    f"""SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY position) - 1 AS BIGINT) AS position, text
        FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY position DESC) AS rn FROM {_SENTENCES})
        WHERE rn <= 10""",
)
def _(spark, sf):
    tail = tail_sentences(docs(spark, sf), "doc_id", "text")
    return tail.select("doc_id", F.col("position").cast("bigint"), "text")


@query(
    "tail_rows",
    """SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn
       FROM conversations) WHERE rn <= 3""",
)
def _(spark, sf):
    turns = table(spark, sf, "conversations").select("conv_id", "turn", "role")
    return last_rows(turns, "conv_id", "turn", 3)


@query("sort_by_key", "SELECT doc_id, lang FROM documents ORDER BY doc_id")
def _(spark, sf):
    return docs(spark, sf).select("doc_id", "lang").orderBy("doc_id")


@query("first_rows", "SELECT doc_id, source FROM documents ORDER BY source, doc_id LIMIT 100")
def _(spark, sf):
    return first_rows(docs(spark, sf).select("doc_id", "source"), ["source", "doc_id"], 100)


@query("shuffle_rows", "SELECT doc_id, lang FROM documents ORDER BY md5('0|' || doc_id)")
def _(spark, sf):
    return shuffle_rows(docs(spark, sf).select("doc_id", "lang"), ["doc_id"])


@query(
    "split_exact",
    """SELECT doc_id, CASE WHEN row_number() OVER (ORDER BY md5('0|' || doc_id)) <= floor(0.2 * count(*) OVER ())
       THEN 'test' ELSE 'train' END AS split FROM documents""",
)
def _(spark, sf):
    return split_exact(docs(spark, sf).select("doc_id"), ["doc_id"])


@query(
    "split_hash",
    """SELECT doc_id, CASE WHEN CAST('0x' || substr(md5('0|' || source), 1, 8) AS BIGINT) % 10000 < 2000
       THEN 'test' ELSE 'train' END AS split FROM documents""",
)
def _(spark, sf):
    return split_by_hash(docs(spark, sf).select("doc_id", "source"), ["source"]).drop("source")


@query(
    "oversample",
    """SELECT doc_id, CAST(toxic AS BIGINT) AS toxic, CAST(unnest(range(1, CASE WHEN toxic = 1 THEN 6 ELSE 2 END)) AS BIGINT) AS copy
       FROM labels""",
)
def _(spark, sf):
    rows = oversample(labels(spark, sf), "toxic")
    return rows.select("doc_id", F.col("toxic").cast("bigint"), F.col("copy").cast("bigint"))


@query(
    "union_splits",
    """SELECT item_id AS id, 'benchmark' AS part, text FROM benchmark
       UNION ALL SELECT doc_id, 'documents', text FROM documents""",
)
def _(spark, sf):
    test = table(spark, sf, "benchmark").select(F.col("item_id").alias("id"), F.lit("benchmark").alias("part"), "text")
    train = docs(spark, sf).select("text", F.lit("documents").alias("part"), F.col("doc_id").alias("id"))
    return test.unionByName(train)


@query(
    "dedupe_array",
    """SELECT doc_id, array_to_string(list_sort(list_distinct(regexp_extract_all(text, '[a-z]+tion'))), '|') AS nouns
       FROM documents""",
)
def _(spark, sf):
    nouns = F.regexp_extract_all("text", F.lit("[a-z]+tion"), F.lit(0))
    return docs(spark, sf).select("doc_id", F.array_join(sorted_distinct(nouns), "|").alias("nouns"))


@query(
    "dedupe_by_key",
    """SELECT source, doc_id, lang, n_chars FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id DESC) AS rn
       FROM documents) WHERE rn = 1""",
)
def _(spark, sf):
    return last_write_wins(docs(spark, sf).select("source", "doc_id", "lang", "n_chars"), "source", "doc_id")


@query(
    "binary_task",
    """WITH votes AS (SELECT user_id * 10000 + month(ts) * 100 + day(ts) AS decision_id,
         count(CASE WHEN (value % 10) / 10 < 0.4 THEN 1 END) AS a, count(CASE WHEN (value % 10) / 10 > 0.6 THEN 1 END) AS b,
         count(*) AS n FROM events GROUP BY 1)
       SELECT decision_id, CAST(CASE WHEN a > b AND a > n - a - b THEN 0 ELSE 1 END AS BIGINT) AS decision_outcome
       FROM votes WHERE (a > b AND a > n - a - b) OR (b > a AND b > n - a - b)""",
)
def _(spark, sf):
    voted = case_votes(binned(spark, sf), "decision_id", "class")
    return decided_only(voted, "decision_outcome").select(
        "decision_id", F.col("decision_outcome").cast("bigint")
    )
