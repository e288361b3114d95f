"""Tagging of sentence files as they arrive. Every step is stateless, so no watermark is needed."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery

from casemill.functions.text import normalize_text
from casemill.operators.masking import mask_column
from casemill.operators.tagging import tag_entities
from casemill.rules.defaults import ENTITY_RULES
from casemill.schemas import SENTENCES

#: Columns of a checked stream: the text of a row that does not fit the schema, and its file.
CORRUPT, FILE = "_corrupt_record", "_file"


def read_sentence_stream(
    spark: SparkSession,
    path: str,
    schema: T.StructType | str = SENTENCES,
    sep: str = ";",
    files_per_trigger: int = 1000,
    checked: bool = False,
) -> DataFrame:
    """Delimited sentence files of a folder, each file once, by the rules of the batch reader.

    A quoted field may hold line breaks, so a file is read by one task, whatever its size: let a large table arrive as files
    of bounded size (``write_shards`` with ``rows``). A trigger reads ``files_per_trigger`` of them by many tasks.

    A header must have the schema's names in its order. A row that does not fit the schema stops the stream; with
    ``checked`` it stays, with its text in ``CORRUPT`` (NULL for all other rows) and its file in ``FILE``, for
    ``write_checked``.
    """
    declared = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    if checked:
        declared = T.StructType([*declared.fields, T.StructField(CORRUPT, T.StringType())])
    files = spark.readStream.schema(declared).option("maxFilesPerTrigger", files_per_trigger)
    rows = files.option("columnNameOfCorruptRecord", CORRUPT).option("mode", "PERMISSIVE" if checked else "FAILFAST").csv(
        path, sep=sep, header=True, multiLine=True, enforceSchema=False, quote='"', escape='"', emptyValue="", nullValue="", lineSep="\n"
    )
    return rows.select("*", F.col("_metadata.file_path").alias(FILE)) if checked else rows


def clean_stream(sentences: DataFrame, text: str = "text", mask: str | None = None, normalize: bool = False) -> DataFrame:
    """The batch masking and normalising of a text on a stream; masking comes first, as in a batch."""
    masked = sentences if mask is None else mask_column(sentences, text, mask)
    return masked.withColumn(text, normalize_text(F.col(text))) if normalize else masked


def tag_stream(
    sentences: DataFrame, text: str = "text", rules: dict[str, str] = ENTITY_RULES
) -> DataFrame:
    """The batch tagger on a stream: sentences without text are dropped first."""
    return tag_entities(sentences.filter(F.col(text).isNotNull()), text, rules)


def write_tagged(tagged: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append to a Parquet table until all files present are done; a restart goes on where it ended."""
    return (
        tagged.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def write_checked(
    sentences: DataFrame, path: str, rejected: str, checkpoint: str, work: Callable[[DataFrame], DataFrame] = tag_stream
) -> StreamingQuery:
    """The rows of a checked stream that fit, after ``work``, as Parquet, and the others with their files as JSON.

    Both sinks have a folder ``batch=<number>`` for each batch, which a batch that runs again replaces: so a restart after
    any failure leaves each row once. A checkpoint belongs to one pair of sinks. Runs until all files present are done.
    """

    def store(batch: DataFrame, number: int) -> None:
        held = batch.persist()  # parsed once for both sinks
        try:
            good = work(held.filter(F.col(CORRUPT).isNull()).drop(CORRUPT, FILE))
            good.write.mode("overwrite").parquet(f"{path}/batch={number}")
            bad = held.filter(F.col(CORRUPT).isNotNull()).select(F.col(FILE).alias("file"), F.col(CORRUPT).alias("record"))
            bad.write.mode("overwrite").json(f"{rejected}/batch={number}")
        finally:
            held.unpersist()

    stream = sentences.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint)
    return stream.trigger(availableNow=True).start()


def read_rejects(spark: SparkSession, rejected: str) -> DataFrame:
    """What ``write_checked`` has rejected: ``file`` and ``record``."""
    return spark.read.schema("file string, record string").json(rejected).select("file", "record")
