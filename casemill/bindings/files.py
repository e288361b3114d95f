"""Sources and sinks. What is read was written from a whole test table to the shared folder."""

from __future__ import annotations

from pyspark.sql import functions as F

from casemill.bindings.registry import query, table
from casemill.functions.text import paragraphs
from casemill.operators.joins import lookup_join
from casemill.operators.masking import mask_column
from casemill.sources.files import (
    merge_shards,
    read_checked,
    read_columns,
    read_delimited,
    read_documents,
    read_named,
    spread,
    write_delimited,
    write_documents,
    write_shards,
)
from casemill.streaming.tagging import clean_stream, read_rejects, read_sentence_stream, tag_stream, write_checked, write_tagged
from casemill.workdir import fresh_path

_DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@query("read_delimited", "SELECT doc_id, text, lang, source, n_chars FROM documents")
def _(spark, sf):
    path = fresh_path(spark, "delimited")
    write_delimited(table(spark, sf, "documents"), path)
    return read_delimited(spark, path, _DOCS)


@query(
    "reject_report",
    """SELECT count(*) AS n_rows, CAST(sum(doc_id) AS BIGINT) AS keys, count(CASE WHEN doc_id % 5 = 0 THEN 1 END) AS n_rejected FROM documents""",
)
def _(spark, sf):
    """Every fifth key spoilt by a letter: what fits is read, what does not is counted."""
    path = fresh_path(spark, "spoilt")
    docs = table(spark, sf, "documents")
    spoilt = F.when(F.col("doc_id") % 5 == 0, F.concat("doc_id", F.lit("x"))).otherwise(F.col("doc_id").cast("string"))
    write_delimited(docs.select(spoilt.alias("doc_id"), "text"), path)
    good, bad = read_checked(spark, path, "doc_id bigint, text string")
    repaired = bad.select(F.regexp_extract("record", r"\A(\d+)x;", 1).cast("bigint").alias("doc_id"), F.lit(1).alias("bad"))
    both = good.select("doc_id", F.lit(0).alias("bad")).unionByName(repaired)
    return both.agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum("doc_id").alias("keys"), F.sum(F.col("bad").cast("bigint")).alias("n_rejected")
    )


@query("pruned_scan", "SELECT doc_id, lang FROM documents")
def _(spark, sf):
    return read_columns(spark, f"{sf}/documents.parquet", ["doc_id", "lang"])


@query(
    "drop_stray_header",
    "SELECT CAST(doc_id AS VARCHAR) AS decision_id, CAST(quality AS VARCHAR) AS decision FROM labels",
)
def _(spark, sf):
    path = fresh_path(spark, "named")
    write_shards(table(spark, sf, "labels").select("doc_id", "quality"), path, 4)
    return read_named(spark, path, ["decision_id", "decision"], "decision_id", "doc_id")


@query("scan_text_dir", "SELECT CAST(item_id AS VARCHAR) AS decision_id, text FROM benchmark")
def _(spark, sf):
    path = fresh_path(spark, "documents")
    write_documents(table(spark, sf, "benchmark"), path, "item_id", F.col("text"))
    return read_documents(spark, path, key_pattern=r"/(\d+)\.txt").drop("path")


@query("parquet_roundtrip", "SELECT doc_id, text, lang, source, n_chars FROM documents")
def _(spark, sf):
    path = fresh_path(spark, "columnar")
    docs = table(spark, sf, "documents")
    docs.write.parquet(path)
    return spark.read.schema(docs.schema).parquet(path)


@query(
    "csv_roundtrip",
    """SELECT doc_id, array_to_string(list_filter(string_split(text, chr(10)), lambda p: trim(p) <> ''), '; ')
       AS paragraphs FROM documents""",
)
def _(spark, sf):
    path = fresh_path(spark, "csv")
    docs = table(spark, sf, "documents").select("doc_id", paragraphs(F.col("text")).alias("paragraphs"))
    write_delimited(docs, path, array_sep="; ")
    return read_delimited(spark, path, "doc_id bigint, paragraphs string")


@query(
    "sharded_sink",
    "SELECT count(*) AS n_rows, CAST(sum(n_chars) AS BIGINT) AS n_chars, CAST(8 AS BIGINT) AS n_shards FROM documents",
)
def _(spark, sf):
    path = fresh_path(spark, "shards")
    write_shards(table(spark, sf, "documents"), path, 8)
    back = merge_shards(spark, path, _DOCS, file="shard").select("n_chars", "shard")
    return back.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.sum("n_chars").alias("n_chars"),
        F.count_distinct("shard").alias("n_shards"),
    )


@query("merge_shards", "SELECT conv_id, turn, role, text FROM conversations")
def _(spark, sf):
    path = fresh_path(spark, "merge")
    write_shards(table(spark, sf, "conversations"), path, 5)
    return merge_shards(spark, f"{path}/*.csv", "conv_id bigint, turn bigint, role string, text string")


@query(
    "literal_dim",
    """WITH names(lang, language) AS (VALUES ('en', 'English'), ('fr', 'French'), ('de', 'German'))
       SELECT language, count(*) AS n FROM documents JOIN names USING (lang) GROUP BY language""",
)
def _(spark, sf):
    named = lookup_join(
        read_columns(spark, f"{sf}/documents.parquet", ["lang"]),
        {"lang": ["en", "fr", "de"], "language": ["English", "French", "German"]},
        {"lang": "string", "language": "string"},
        "lang",
    )
    return named.groupBy("language").agg(F.count(F.lit(1)).alias("n"))


_WORD_PATTERN = "[Tt]h[a-z]+"


@query(
    "mask_dir",
    f"""SELECT CAST(item_id AS VARCHAR) AS decision_id, length(text) AS n_chars,
       CAST(coalesce(list_sum(list_transform(regexp_extract_all(text, '{_WORD_PATTERN}'), lambda s: least(length(s), 20))), 0)
         + length(text) - length(replace(text, 'X', '')) AS BIGINT) AS n_masked
       FROM benchmark""",
)
def _(spark, sf):
    source, target = fresh_path(spark, "plain"), fresh_path(spark, "masked")
    write_documents(table(spark, sf, "benchmark"), source, "item_id", F.col("text"))
    files = read_documents(spark, source, key_pattern=r"/(\d+)\.txt").drop("path")
    masked = mask_column(files, "text", _WORD_PATTERN)
    write_documents(masked, target, "decision_id", F.col("text"))
    back = read_documents(spark, target, key_pattern=r"/(\d+)\.txt")
    return back.select(
        "decision_id",
        F.length("text").cast("bigint").alias("n_chars"),
        (F.length("text") - F.length(F.replace("text", F.lit("X"), F.lit("")))).cast("bigint").alias("n_masked"),
    )


# Rows of a file that arrives on a stream, which one task reads: a larger table lands as more files.
LANDING_ROWS = 2_500


def _land(docs, path):
    write_shards(spread(docs), path, sep=";", rows=LANDING_ROWS)


@query(
    "stream_tagging",
    """SELECT CAST(doc_id AS VARCHAR) AS decision_id,
       array_to_string(regexp_extract_all(text, '[a-z]+tion'), '|') AS nouns,
       array_to_string(regexp_extract_all(text, '[a-z]+ing'), '|') AS verbs
       FROM documents""",
)
def _(spark, sf):
    landing, sink, marks = (fresh_path(spark, n) for n in ("landing", "tagged", "marks"))
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("decision_id"), "text")
    _land(docs, landing)
    stream = read_sentence_stream(spark, landing)
    tagged = tag_stream(stream, rules={"nouns": "[a-z]+tion", "verbs": "[a-z]+ing"})
    running = write_tagged(tagged, sink, marks)
    running.awaitTermination()
    return (
        spark.read.schema(tagged.schema)
        .parquet(sink)
        .select("decision_id", *[F.array_join(c, "|").alias(c) for c in ("nouns", "verbs")])
    )


@query(
    "stream_rejects",
    """SELECT doc_id, CAST(doc_id % 5 = 0 AS BIGINT) AS rejected,
       CASE WHEN doc_id % 5 <> 0 THEN array_to_string(regexp_extract_all(text, '[a-z]+tion'), '|') END AS nouns,
       CASE WHEN doc_id % 5 <> 0 THEN CAST(len(regexp_extract_all(text, '[0-9X]')) AS BIGINT) END AS n_masked
       FROM documents WHERE text IS NOT NULL""",
)
def _(spark, sf):
    """Every fifth key spoilt by a letter: what fits is masked and tagged, what does not is kept apart."""
    landing, sink, rejected, marks = (fresh_path(spark, n) for n in ("landing", "tagged", "rejected", "marks"))
    docs = table(spark, sf, "documents").filter(F.col("text").isNotNull())
    spoilt = F.when(F.col("doc_id") % 5 == 0, F.concat("doc_id", F.lit("x"))).otherwise(F.col("doc_id").cast("string"))
    _land(docs.select(spoilt.alias("doc_id"), "text"), landing)

    def work(sentences):
        masked = clean_stream(sentences, mask="[0-9]").withColumn("n_masked", F.regexp_count("text", F.lit("X")).cast("bigint"))
        return tag_stream(masked, rules={"nouns": "[a-z]+tion"})

    stream = read_sentence_stream(spark, landing, "doc_id bigint, text string", checked=True)
    write_checked(stream, sink, rejected, marks, work).awaitTermination()
    good = spark.read.schema("doc_id bigint, nouns array<string>, n_masked bigint").parquet(sink)
    bad = read_rejects(spark, rejected).select(F.regexp_extract("record", r"\A(\d+)x;", 1).cast("bigint").alias("doc_id"))
    tagged = good.select("doc_id", F.lit(0).cast("bigint").alias("rejected"), F.array_join("nouns", "|").alias("nouns"), "n_masked")
    return tagged.unionByName(bad.withColumn("rejected", F.lit(1).cast("bigint")), allowMissingColumns=True)
