"""Text, date and key expressions, and the reconciliation of two extractions."""

from __future__ import annotations

from pyspark.sql import functions as F

from casemill.bindings.registry import pages, query, table, texts
from casemill.functions.arrays import argmax
from casemill.functions.dates import (
    clean_date_items,
    date_span,
    latest_date,
    parse_date,
    parsed_dates,
    print_date,
)
from casemill.functions.html import signature_items
from casemill.functions.keys import key_from_path
from casemill.functions.similarity import token_set_similarity
from casemill.functions.text import (
    apply_fixups,
    array_to_text,
    clean_lines,
    collapse_separators,
    first_match,
    join_features,
    normalize_text,
    parse_list_repr,
    strip_punctuation,
)
from casemill.operators.classify import tokens
from casemill.operators.cleaning import as_text_columns
from casemill.operators.reconcile import reconcile_dates, reconcile_names
from casemill.rules.defaults import HEARING_MODE_PATTERN, HEARING_TYPE_PATTERN
from casemill.sources.files import spread


def docs(spark, sf):
    return texts(spark, sf, "doc_id", "lang", "text")


@query("normalize_text", r"SELECT doc_id, regexp_replace(lower(text), '\s+', ' ', 'g') AS text FROM documents")
def _(spark, sf):
    return docs(spark, sf).select("doc_id", normalize_text(F.col("text")).alias("text"))


@query(
    "extract_key",
    r"""SELECT page_id, coalesce(nullif(regexp_extract(url, '/(\d{1,6})(?:\.html|/?$)', 1), ''), 'no_match_filename') AS decision_id FROM pages""",
)
def _(spark, sf):
    key = key_from_path(F.col("url"), r"/(\d{1,6})(?:\.html|/?$)")
    return table(spark, sf, "pages").select("page_id", key.alias("decision_id"))


def covers(spark, sf):
    """Document texts that open with a hearing phrase."""
    lang = F.col("lang")
    phrase = (
        F.when(lang == "en", "a private hearing by telephone")
        .when(lang == "fr", "audience publique by Video-Conference")
        .when(lang == "de", "public  proceedings in chambers")
        .otherwise("none within personal reach")
    )
    return docs(spark, sf).select("doc_id", F.concat_ws("\n", phrase, "text").alias("text"))

_COVERS = """(SELECT doc_id, CASE lang WHEN 'en' THEN 'a private hearing by telephone'
    WHEN 'fr' THEN 'audience publique by Video-Conference' WHEN 'de' THEN 'public  proceedings in chambers'
    ELSE 'none within personal reach' END || chr(10) || text AS text FROM documents)"""


@query(
    "flag_hearing",
    f"SELECT doc_id, nullif(regexp_extract(lower(text), '{HEARING_TYPE_PATTERN}'), '') AS hearing_type FROM {_COVERS}",
)
def _(spark, sf):
    flag = first_match(F.lower("text"), HEARING_TYPE_PATTERN)
    return covers(spark, sf).select("doc_id", flag.alias("hearing_type"))


@query(
    "flag_mode",
    f"SELECT doc_id, nullif(regexp_extract(lower(text), '{HEARING_MODE_PATTERN}'), '') AS hearing_mode FROM {_COVERS}",
)
def _(spark, sf):
    flag = first_match(F.lower("text"), HEARING_MODE_PATTERN)
    return covers(spark, sf).select("doc_id", flag.alias("hearing_mode"))


@query(
    "strip_punct",
    r"""SELECT doc_id, regexp_replace(regexp_replace(text, '[^\p{L}\p{N}_\s\[\]]', ' ', 'g'), ' +', ' ', 'g') AS text FROM documents""",
)
def _(spark, sf):
    return docs(spark, sf).select("doc_id", strip_punctuation(F.col("text")).alias("text"))


def part_features(spark, sf):
    """Part columns as features, some of them missing."""
    return table(spark, sf, "part").select(
        "p_partkey",
        "p_name",
        F.when(F.col("p_size") > 10, F.col("p_brand")).alias("p_brand"),
        F.when(F.col("p_size") > 25, F.col("p_type")).alias("p_type"),
        F.col("p_size").cast("string").alias("p_size"),
    )

_FEATURE_TEXT = """(p_name || '[SEP]' || CASE WHEN p_size > 10 THEN p_brand ELSE '' END || '[SEP]'
    || CASE WHEN p_size > 25 THEN p_type ELSE '' END || '[SEP]' || p_size)"""


@query("assemble_text", f"SELECT p_partkey, {_FEATURE_TEXT} AS text FROM part")
def _(spark, sf):
    typed = as_text_columns(part_features(spark, sf), ["p_name", "p_brand", "p_type", "p_size"])
    text = join_features([F.col(c) for c in ("p_name", "p_brand", "p_type", "p_size")])
    return typed.select("p_partkey", text.alias("text"))


@query(
    "collapse_sep",
    rf"SELECT p_partkey, regexp_replace({_FEATURE_TEXT}, '(\[SEP\]){{2,}}', '[SEP]', 'g') AS text FROM part",
)
def _(spark, sf):
    text = join_features([F.col(c) for c in ("p_name", "p_brand", "p_type", "p_size")])
    return part_features(spark, sf).select("p_partkey", collapse_separators(text).alias("text"))


@query(
    "fixups",
    "SELECT p_partkey, replace(replace(p_name, 'small', 'tiny'), 'bolt', 'screw') AS name FROM part",
)
def _(spark, sf):
    fixed = apply_fixups(F.col("p_name"), {"small": "tiny", "bolt": "screw"})
    return table(spark, sf, "part").select("p_partkey", fixed.alias("name"))


@query(
    "parse_list_repr",
    """SELECT p_partkey, CASE WHEN p_size % 4 = 0 THEN '' WHEN p_size % 4 = 1 THEN p_name || '|o''brien'
       ELSE p_name || '|' || p_type END AS items FROM part""",
)
def _(spark, sf):
    kind = F.col("p_size") % 4
    name = F.concat(F.lit("'"), "p_name", F.lit("'"))
    other = F.concat(F.lit("'"), "p_type", F.lit("'"))
    written = (
        F.when(kind == 0, "set()")
        .when(kind == 1, F.concat(F.lit("["), name, F.lit(", \"o'brien\"]")))
        .when(kind == 2, F.concat(F.lit("{"), name, F.lit(", "), other, F.lit("}")))
        .otherwise(F.concat(F.lit("["), name, F.lit(" "), other, F.lit("]")))
    )
    return table(spark, sf, "part").select(
        "p_partkey", F.array_join(parse_list_repr(written), "|").alias("items")
    )


@query(
    "array_to_text",
    """SELECT doc_id, nullif(array_to_string(regexp_extract_all(text, '[a-z]+tion'), ', '), '') AS nouns FROM documents""",
)
def _(spark, sf):
    nouns = F.regexp_extract_all("text", F.lit("[a-z]+tion"), F.lit(0))
    return docs(spark, sf).select("doc_id", array_to_text(nouns).alias("nouns"))


@query(
    "clean_lines",
    r"""SELECT doc_id, array_to_string(list_filter(list_transform(string_split(lower(text), chr(10)),
       lambda x: regexp_replace(x, '^\s+', '')), lambda x: x <> ''), '|') AS lines FROM documents""",
)
def _(spark, sf):
    return docs(spark, sf).select("doc_id", F.array_join(clean_lines(F.col("text")), "|").alias("lines"))


# Dates ---------------------------------------------------------------------------------------


def dated(spark, sf):
    """Date lists as a cover page shows them, one per order."""
    day = F.col("o_orderdate").cast("date")
    other = F.date_add(day, (F.col("o_custkey") % 400).cast("int"))
    return spread(table(spark, sf, "orders")).select(
        "o_orderkey",
        F.array(
            F.date_format(day, "MMMM d, yyyy"),
            F.lower(F.date_format(other, "MMMM d, yyyy")),
            F.date_format(day, "MMMM d, yyyy"),
            F.lit("october 2007"),
            F.lit("2016"),
            F.lit("february 30, 2017"),
        ).alias("items"),
    )

_DATED = """(SELECT o_orderkey, [a, lower(b), a, 'october 2007', '2016', 'february 30, 2017'] AS items FROM (
    SELECT o_orderkey, strftime(o_orderdate, '%B %-d, %Y') AS a,
      strftime(CAST(o_orderdate AS DATE) + CAST(o_custkey % 400 AS INTEGER), '%B %-d, %Y') AS b FROM orders))"""
_PARSED = f"""(SELECT o_orderkey, list_filter(list_transform(items, lambda x: CAST(try_strptime(x, '%B %d, %Y') AS DATE)),
    lambda d: d IS NOT NULL) AS days FROM {_DATED})"""


@query(
    "parse_dates",
    f"""SELECT o_orderkey, strftime(CAST(try_strptime(items[2], '%B %d, %Y') AS DATE), '%Y-%m-%d') AS day,
        try_strptime(items[6], '%B %d, %Y') IS NULL AS invalid FROM {_DATED}""",
)
def _(spark, sf):
    items = F.col("items")
    return dated(spark, sf).select(
        "o_orderkey",
        F.date_format(parse_date(items[1]), "yyyy-MM-dd").alias("day"),
        parse_date(items[5]).isNull().alias("invalid"),
    )


@query(
    "clean_dates",
    rf"""SELECT o_orderkey, array_to_string(list_sort(list_filter(list_distinct(items),
        lambda d: d <> 'october 2007' AND NOT regexp_matches(d, '^\d{{4}}'))), '|') AS items FROM {_DATED}""",
)
def _(spark, sf):
    cleaned = F.array_sort(clean_date_items(F.col("items")))
    return dated(spark, sf).select("o_orderkey", F.array_join(cleaned, "|").alias("items"))


@query(
    "decision_date_span",
    f"""SELECT o_orderkey, strftime(list_max(days), '%Y-%m-%d') AS decision_date,
        CAST(datediff('day', list_min(days), list_max(days)) AS BIGINT) AS span_days FROM {_PARSED}""",
)
def _(spark, sf):
    days = dated(spark, sf).withColumn("days", parsed_dates(clean_date_items(F.col("items"))))
    return days.select(
        "o_orderkey",
        F.date_format(latest_date(F.col("days")), "yyyy-MM-dd").alias("decision_date"),
        date_span(F.col("days")).cast("bigint").alias("span_days"),
    )


@query("format_date", f"SELECT o_orderkey, strftime(list_max(days), '%B %d, %Y') AS decision_date FROM {_PARSED}")
def _(spark, sf):
    return dated(spark, sf).select("o_orderkey", print_date(latest_date(parsed_dates(F.col("items")))).alias("decision_date"))


@query(
    "argmax_scores",
    """SELECT vec_id, CAST(list_position(embedding, list_max(embedding)) - 1 AS BIGINT) AS prediction FROM embeddings""",
)
def _(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", argmax(F.col("embedding")).cast("bigint").alias("prediction"))


# Reconciliation ------------------------------------------------------------------------------


def two_name_lists(spark, sf):
    """Names of a cover and names of its signature block: equal, written in another way, or none."""
    words = F.split("p_name", " ")
    kind = F.col("p_size") % 3
    first = F.when(F.col("p_size") % 2 == 0, F.array("p_name")).otherwise(F.array("p_name", "p_brand"))
    second = (
        F.when(kind == 0, F.array("p_name"))
        .when(kind == 1, F.array(F.lit("member"), F.concat(words[1], F.lit(", "), words[0])))
        .otherwise(F.array(F.lit("no table found")))
    )
    return table(spark, sf, "part").select("p_partkey", first.alias("first"), second.alias("second"))

_TOKENS = r"list_distinct(list_filter(string_split(regexp_replace(lower(array_to_string({0}, ' ')), '\W', ' ', 'g'), ' '), lambda x: x <> ''))"


@query(
    "reconcile_names",
    f"""WITH lists AS (SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN [p_name] ELSE [p_name, p_brand] END AS a,
          CASE p_size % 3 WHEN 0 THEN [p_name] WHEN 1 THEN ['member', split_part(p_name, ' ', 2) || ', ' || split_part(p_name, ' ', 1)]
          ELSE ['no table found'] END AS b FROM part),
        sets AS (SELECT *, {_TOKENS.format('a')} AS ta, {_TOKENS.format('b')} AS tb FROM lists)
        SELECT p_partkey, CASE WHEN len(list_intersect(a, b)) > 0 THEN array_to_string(list_sort(list_intersect(a, b)), ' ')
          WHEN len(list_intersect(ta, tb)) > 0 AND len(list_intersect(ta, tb)) = least(len(ta), len(tb)) THEN b[-1]
          ELSE '' END AS judge_name FROM sets""",
)
def _(spark, sf):
    return reconcile_names(two_name_lists(spark, sf), "first", "second").select("p_partkey", "judge_name")


@query(
    "reconcile_dates",
    f"""WITH lists AS (SELECT o_orderkey, [strftime(o_orderdate, '%B %-d, %Y')] AS a0, o_custkey % 3 AS kind,
          strftime(CAST(o_orderdate AS DATE) + CAST(CASE o_custkey % 3 WHEN 1 THEN 1 ELSE 0 END AS INTEGER), '%B %-d %Y') AS b1,
          strftime(o_orderdate, '%B') AS m FROM orders)
        SELECT o_orderkey, CASE kind WHEN 0 THEN b1 WHEN 1 THEN '' ELSE m || ' the last' END AS date_decision FROM lists""",
)
def _(spark, sf):
    day = F.col("o_orderdate").cast("date")
    kind = F.col("o_custkey") % 3
    month = F.date_format(day, "MMMM")
    first = F.when(kind == 2, F.array(F.concat(F.lit("last "), month))).otherwise(
        F.array(F.date_format(day, "MMMM d, yyyy"))
    )
    second = (
        F.when(kind == 0, F.array(F.lit("member"), F.date_format(day, "MMMM d yyyy")))
        .when(kind == 1, F.array(F.date_format(F.date_add(day, 1), "MMMM d, yyyy")))
        .otherwise(F.array(F.concat(month, F.lit(" the last"))))
    )
    lists = spread(table(spark, sf, "orders")).select("o_orderkey", first.alias("first"), second.alias("second"))
    return reconcile_dates(lists, "first", "second", short=True).select("o_orderkey", "date_decision")


def _ratio(a, b):
    """SQL of twice the longest common subsequence over both lengths, in percent: one bit per character."""
    bits = f"list_transform(string_split({b}, ''), lambda ch: CAST(list_sum(list_transform(range(length({a})), lambda i: CASE WHEN substr({a}, CAST(i + 1 AS BIGINT), 1) = ch THEN 1::BIGINT << i ELSE 0 END)) AS BIGINT))"
    full = f"((1::BIGINT << length({a})) - 1)"
    fold = f"list_reduce(list_prepend({full}, {bits}), lambda v, m: ((v + (v & m)) | (v - (v & m))) & {full})"
    common = f"(length({a}) - bit_count({fold}))"
    return f"""CASE WHEN {a} = '' OR {b} = '' THEN 0 WHEN {a} = {b} THEN 100
        ELSE round_even(100 * 2 * {common} / (length({a}) + length({b})), 0) END"""


@query(
    "token_set_similarity",
    f"""WITH sets AS (SELECT p_partkey, {_TOKENS.format('[p_name, p_type]')} AS ta, {_TOKENS.format('[p_type, p_brand]')} AS tb FROM part),
        parts AS (SELECT p_partkey, array_to_string(list_sort(list_intersect(ta, tb)), ' ') AS s,
          array_to_string(list_sort(list_filter(ta, lambda x: NOT list_contains(tb, x))), ' ') AS a,
          array_to_string(list_sort(list_filter(tb, lambda x: NOT list_contains(ta, x))), ' ') AS b FROM sets),
        wholes AS (SELECT p_partkey, s, trim(s || ' ' || a) AS wa, trim(s || ' ' || b) AS wb FROM parts)
        SELECT p_partkey, CAST(greatest({_ratio('s', 'wa')}, {_ratio('s', 'wb')}, {_ratio('wa', 'wb')}) AS BIGINT) AS score FROM wholes""",
)
def _(spark, sf):
    score = token_set_similarity(F.concat_ws(" ", "p_name", "p_type"), F.concat_ws(", ", "p_type", "p_brand"), short=True)
    parts = spread(table(spark, sf, "part").select("p_partkey", "p_name", "p_type", "p_brand"))
    return parts.select("p_partkey", score.cast("bigint").alias("score"))


# Signature block -----------------------------------------------------------------------------

_STRIPPED = r"""regexp_replace(html, '(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<!--.*?-->', '', 'g')"""


# A signature with references by name and by number.
_SIGNED = "<p>G&eacute;rard d&#39;Aub&#233;\n&#xC9;milie&nbsp;Roe</p>"


@query(
    "last_block",
    rf"""WITH blocks AS (SELECT page_id, url, CASE WHEN regexp_matches(m, '(?i)<p\b[^>]*>')
             THEN regexp_extract(m, '(?is)^.*<p\b[^>]*>(.*?)(?:</p\s*>|\z)', 1) END AS block
           FROM (SELECT page_id, url, {_STRIPPED} AS m FROM (SELECT page_id, url, html || CASE WHEN page_id % 4 = 0 THEN '{_SIGNED}' ELSE '' END AS html FROM pages))),
         texts AS (SELECT page_id, url, replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(
             regexp_replace(block, '(?s)<[^>]*>', '', 'g'), '&nbsp;', chr(160)), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''),
             '&copy;', '©'), '&middot;', '·'), '&eacute;', 'é'), '&#233;', 'é'), '&#xC9;', 'É'), '&amp;', '&') AS t FROM blocks),
         lined AS (SELECT page_id, url, list_filter(list_transform(string_split(lower(t), chr(10)),
             lambda x: regexp_replace(x, '^[\s\x{{A0}}]+', '')), lambda x: x <> '') AS lines FROM texts)
         SELECT page_id, coalesce(nullif(regexp_extract(url, '/(\d{{1,6}})(?:\.html|/?$)', 1), ''), 'no_match_filename') AS decision_id,
           CASE WHEN lines IS NULL THEN '' WHEN len(list_filter(lines, lambda x: regexp_matches(x, 'tention|lich'))) > 0 THEN 'no table found'
           ELSE array_to_string(lines, '|') END AS items FROM lined""",
)
def _(spark, sf):
    html = F.concat("html", F.when(F.col("page_id") % 4 == 0, _SIGNED).otherwise(""))
    items = signature_items(html, tag="p", triage="tention|lich")
    key = key_from_path(F.col("url"), r"/(\d{1,6})(?:\.html|/?$)")
    return pages(spark, sf, "page_id", "url", "html").select(
        "page_id", key.alias("decision_id"), F.array_join(items, "|").alias("items")
    )


# Tokens --------------------------------------------------------------------------------------


@query(
    "tokenize_truncate",
    r"""SELECT doc_id, array_to_string(list_filter(string_split_regex(lower(text), '\s+'), lambda x: x <> '')[1:512], ' ') AS tokens
       FROM documents""",
)
def _(spark, sf):
    return docs(spark, sf).select("doc_id", F.array_join(tokens(F.col("text")), " ").alias("tokens"))
