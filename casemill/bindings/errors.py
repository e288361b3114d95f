"""Metrics, error analysis and profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from casemill.bindings.registry import query, table, texts
from casemill.functions.text import join_features
from casemill.operators.metrics import (
    accuracy,
    confusion_matrix,
    eval_bundle,
    f1_multilabel,
    f1_samples,
    f1_score,
    misclassified,
)
from casemill.operators.profile import (
    cleaning_report,
    distinct_cases,
    error_profile,
    null_profile,
    top_words,
    word_counts,
    word_stats,
)


_DOCS = ("doc_id", "text", "lang", "source", "n_chars")


def predictions(spark, sf, predicted_docs=None):
    """Labelled documents with a fixed rule as the prediction, binary and with three classes."""
    if predicted_docs is None:
        predicted_docs = table(spark, sf, "documents")
    labelled = predicted_docs.join(table(spark, sf, "labels"), "doc_id")
    n, lang = F.col("n_chars"), F.col("lang")
    return labelled.select(
        "doc_id",
        F.col("quality").cast("bigint").alias("y"),
        F.when(n > 400, 1).otherwise(0).cast("bigint").alias("p"),
        F.when(lang == "en", 0).when(lang == "fr", 1).otherwise(2).cast("bigint").alias("y3"),
        F.when(n > 2000, 0).when(n > 900, 1).when(n > 300, 2).otherwise(3).cast("bigint").alias("p3"),
        (n / 1000.0).alias("w"),
        F.col("toxic").cast("bigint").alias("toxic"),
        join_features([F.col("lang"), F.col("source"), F.col("text")]).alias("text"),
    )


_P = """(SELECT doc_id, CAST(quality AS BIGINT) AS y, CAST(CASE WHEN n_chars > 400 THEN 1 ELSE 0 END AS BIGINT) AS p,
    CAST(CASE lang WHEN 'en' THEN 0 WHEN 'fr' THEN 1 ELSE 2 END AS BIGINT) AS y3,
    CAST(CASE WHEN n_chars > 2000 THEN 0 WHEN n_chars > 900 THEN 1 WHEN n_chars > 300 THEN 2 ELSE 3 END AS BIGINT) AS p3,
    n_chars / 1000.0::DOUBLE AS w, CAST(toxic AS BIGINT) AS toxic, lang || '[SEP]' || source || '[SEP]' || text AS text
    FROM documents JOIN labels USING (doc_id))"""


def _class_f1(y, p, w="1.0"):
    return f"""(SELECT c AS class, coalesce(2 * sum(CASE WHEN {y} = c AND {p} = c THEN {w} END)
        / nullif(sum(CASE WHEN {y} = c THEN {w} ELSE 0 END) + sum(CASE WHEN {p} = c THEN {w} ELSE 0 END), 0), 0) AS f1,
        sum(CASE WHEN {y} = c THEN {w} ELSE 0 END) AS actual
        FROM {_P} q, (SELECT {y} AS c FROM {_P} UNION SELECT {p} FROM {_P}) k GROUP BY c)"""


def _rounded(df):
    return df.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


@query("accuracy", f"SELECT round(avg(CASE WHEN y = p THEN 1.0::DOUBLE ELSE 0 END), 6) AS accuracy FROM {_P}")
def _(spark, sf):
    return _rounded(accuracy(predictions(spark, sf), "y", "p"))


@query("accuracy_count", f"SELECT CAST(count(CASE WHEN y = p THEN 1 END) AS DOUBLE) AS accuracy FROM {_P}")
def _(spark, sf):
    return _rounded(accuracy(predictions(spark, sf), "y", "p", normalize=False))


@query("accuracy_weighted", f"SELECT round(sum(CASE WHEN y = p THEN w ELSE 0 END) / sum(w), 6) AS accuracy FROM {_P}")
def _(spark, sf):
    return _rounded(accuracy(predictions(spark, sf), "y", "p", weight="w"))


def pairs(spark, sf):
    return predictions(spark, sf).select(
        F.array("y", "toxic").alias("labels"), F.array("p", F.lit(1).cast("bigint") - F.col("p")).alias("predicted")
    )


@query("accuracy_multilabel", f"SELECT round(avg(CASE WHEN y = p AND toxic = 1 - p THEN 1.0::DOUBLE ELSE 0 END), 6) AS accuracy FROM {_P}")
def _(spark, sf):
    return _rounded(accuracy(pairs(spark, sf), "labels", "predicted"))


@query("f1_binary", f"SELECT round(f1, 6) AS f1 FROM {_class_f1('y', 'p', '1.0::DOUBLE')} WHERE class = 1")
def _(spark, sf):
    return _rounded(f1_score(predictions(spark, sf), "y", "p"))


@query("f1_binary_negative", f"SELECT round(f1, 6) AS f1 FROM {_class_f1('y', 'p', '1.0::DOUBLE')} WHERE class = 0")
def _(spark, sf):
    return _rounded(f1_score(predictions(spark, sf), "y", "p", pos_label=0))


@query("f1_macro", f"SELECT round(avg(f1), 6) AS f1 FROM {_class_f1('y3', 'p3', '1.0::DOUBLE')}")
def _(spark, sf):
    return _rounded(f1_score(predictions(spark, sf), "y3", "p3", "macro"))


@query("f1_macro_labels", f"SELECT round(sum(CASE WHEN class IN (0, 2) THEN f1 END) / 3, 6) AS f1 FROM {_class_f1('y3', 'p3', '1.0::DOUBLE')}")
def _(spark, sf):
    return _rounded(f1_score(predictions(spark, sf), "y3", "p3", "macro", labels=[0, 2, 9]))


@query("f1_micro", f"SELECT round(avg(CASE WHEN y3 = p3 THEN 1.0::DOUBLE ELSE 0 END), 6) AS f1 FROM {_P}")
def _(spark, sf):
    return _rounded(f1_score(predictions(spark, sf), "y3", "p3", "micro"))


@query("f1_weighted", f"SELECT round(sum(f1 * actual) / sum(actual), 6) AS f1 FROM {_class_f1('y3', 'p3', '1.0::DOUBLE')}")
def _(spark, sf):
    return _rounded(f1_score(predictions(spark, sf), "y3", "p3", "weighted"))


@query("f1_per_class", f"SELECT class, round(f1, 6) AS f1 FROM {_class_f1('y3', 'p3', '1.0::DOUBLE')}")
def _(spark, sf):
    return _rounded(f1_score(predictions(spark, sf), "y3", "p3", None))


@query("f1_sample_weight", f"SELECT round(sum(f1 * actual) / sum(actual), 6) AS f1 FROM {_class_f1('y3', 'p3', 'w')}")
def _(spark, sf):
    return _rounded(f1_score(predictions(spark, sf), "y3", "p3", "weighted", weight="w"))


@query(
    "f1_multilabel",
    f"""SELECT round((coalesce(2.0::DOUBLE * sum(y * p) / nullif(sum(y) + sum(p), 0), 0)
          + coalesce(2.0::DOUBLE * sum(toxic * (1 - p)) / nullif(sum(toxic) + sum(1 - p), 0), 0)) / 2, 6) AS f1 FROM {_P}""",
)
def _(spark, sf):
    return _rounded(f1_multilabel(pairs(spark, sf), "labels", "predicted"))


@query(
    "f1_samples",
    f"SELECT round(avg(2.0::DOUBLE * (y * p + toxic * (1 - p)) / (y + toxic + 1)), 6) AS f1 FROM {_P}",
)
def _(spark, sf):
    return _rounded(f1_samples(pairs(spark, sf), "labels", "predicted"))


@query(
    "eval_bundle",
    """WITH e AS (SELECT label AS y, list_position(embedding, list_max(embedding)) - 1 AS p FROM embeddings),
       c AS (SELECT k AS class, 2.0::DOUBLE * count(CASE WHEN y = k AND p = k THEN 1 END)
           / nullif(count(CASE WHEN y = k THEN 1 END) + count(CASE WHEN p = k THEN 1 END), 0) AS f1,
           count(CASE WHEN y = k THEN 1 END) AS actual FROM e, (SELECT y AS k FROM e UNION SELECT p FROM e) GROUP BY k)
       SELECT (SELECT round(avg(CASE WHEN y = p THEN 1.0::DOUBLE ELSE 0 END), 6) FROM e) AS accuracy,
         round(avg(f1), 6) AS macro_f1, round(sum(f1 * actual) / sum(actual), 6) AS weighted_f1 FROM c""",
)
def _(spark, sf):
    return _rounded(eval_bundle(table(spark, sf, "embeddings"), "label", "embedding"))


# Error analysis --------------------------------------------------------------------------------


def named_predictions(spark, sf):
    def name(c):
        return F.when(F.col(c) == 0, "REJECTED").otherwise("GRANTED")

    return predictions(spark, sf).select("doc_id", name("y").alias("label"), name("p").alias("prediction"), "text")


@query(
    "confusion_matrix",
    f"""SELECT label, count(CASE WHEN p = 0 THEN 1 END) AS "predicted_REJECTED", count(CASE WHEN p = 1 THEN 1 END) AS "predicted_GRANTED",
        count(CASE WHEN p IS NULL OR p NOT IN (0, 1) THEN 1 END) AS predicted_other
        FROM (VALUES ('REJECTED'), ('GRANTED'), ('other')) AS l(label) LEFT JOIN
          (SELECT CASE y WHEN 0 THEN 'REJECTED' WHEN 1 THEN 'GRANTED' ELSE 'other' END AS label, p, doc_id FROM {_P}) USING (label)
        GROUP BY label""".replace("p IS NULL OR p NOT", "doc_id IS NOT NULL AND (p IS NULL OR p NOT").replace("(0, 1) THEN", "(0, 1)) THEN"),
)
def _(spark, sf):
    return confusion_matrix(named_predictions(spark, sf), "label", "prediction", ["REJECTED", "GRANTED"])


@query("misclassified", f"SELECT doc_id, y, p, text FROM {_P} WHERE y IS DISTINCT FROM p")
def _(spark, sf):
    return misclassified(predictions(spark, sf).select("doc_id", "y", "p", "text"), "y", "p")


_WORDS = r"list_filter(string_split_regex(text, '\s+'), lambda x: x <> '')"


@query(
    "error_profile",
    f"""WITH m AS (SELECT y <> p AS wrong, len({_WORDS}) AS n, (length(text) - length(replace(text, '[SEP]', ''))) / 5 AS s FROM {_P})
        SELECT 'misclassified' AS sample, count(*) AS n, round(avg(n), 6) AS mean_words, round(avg(s), 6) AS mean_separators FROM m WHERE wrong
        UNION ALL SELECT 'all', count(*), round(avg(n), 6), round(avg(s), 6) FROM m""",
)
def _(spark, sf):
    rows = predictions(spark, sf, texts(spark, sf, *_DOCS))
    return _rounded(error_profile(rows, "text", F.col("y") != F.col("p")))


@query(
    "top_words",
    f"""WITH w AS (SELECT y <> p AS wrong, unnest({_WORDS}) AS word FROM {_P}),
        c AS (SELECT 'all' AS sample, word, count(*) AS n FROM w GROUP BY word
              UNION ALL SELECT 'misclassified', word, count(*) FROM w WHERE wrong GROUP BY word)
        SELECT sample, word, n, rank FROM (SELECT *, row_number() OVER (PARTITION BY sample ORDER BY n DESC, encode(word)) AS rank FROM c)
        WHERE rank <= 50""",
)
def _(spark, sf):
    rows = predictions(spark, sf, texts(spark, sf, *_DOCS))
    return top_words(rows, "text", F.col("y") != F.col("p")).withColumn("rank", F.col("rank").cast("bigint"))


@query("word_counts", rf"SELECT word, count(*) AS n FROM (SELECT unnest({_WORDS}) AS word FROM documents) GROUP BY word")
def _(spark, sf):
    return word_counts(texts(spark, sf, "text"), "text")


@query("word_stats", f"SELECT median(n) AS median_words, round(avg(n), 6) AS mean_words FROM (SELECT len({_WORDS}) AS n FROM documents)")
def _(spark, sf):
    return _rounded(word_stats(texts(spark, sf, "text"), "text"))


# Profiles --------------------------------------------------------------------------------------


def partly_labelled(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "lang", "source")
    return docs.join(table(spark, sf, "labels"), "doc_id", "left")


@query("distinct_cases", "SELECT count(DISTINCT quality) + max(CASE WHEN quality IS NULL THEN 1 ELSE 0 END) AS n_cases FROM documents LEFT JOIN labels USING (doc_id)")
def _(spark, sf):
    return distinct_cases(partly_labelled(spark, sf), "quality")


@query(
    "null_profile",
    " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, count(*) - count({c}) AS n_missing FROM documents LEFT JOIN labels USING (doc_id)"
        for c in ("lang", "source", "quality", "toxic")
    ),
)
def _(spark, sf):
    return null_profile(partly_labelled(spark, sf), ["lang", "source", "quality", "toxic"])


@query(
    "cleaning_report",
    """SELECT count(*) AS rows_before, count(quality) AS rows_after, count(*) - count(quality) AS rows_removed,
       count(DISTINCT CASE WHEN quality IS NOT NULL THEN source END) AS cases_after
       FROM documents LEFT JOIN labels USING (doc_id)""",
)
def _(spark, sf):
    return cleaning_report(partly_labelled(spark, sf), "source", ["quality"])
