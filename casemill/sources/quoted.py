"""Delimited files whose quoted fields hold line breaks, read by many tasks.

Where a record ends depends on whether a line break stands in quotes, that is, on the parity of all quotes
before it. So the files are read twice, each time in the byte ranges that Spark splits text into. The first
pass counts the quotes of each range; a prefix sum over the ranges of a file tells in which state each
begins. In the second pass each range joins its lines to records on its own. A record that crosses from one range into
another is left out there; its pieces, at most two for a range, meet in a shuffle of their own.

Quotes stand around a field or are doubled in it, so a record has an even number of them. The encoding must be one in
which line breaks and quotes are single ASCII bytes, as in UTF-8 and Latin-1.
"""

from __future__ import annotations

import csv
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from casemill.workdir import materialize

__all__ = ["count_quotes", "open_ranges", "records"]

_RANGE = ["_file", "_start"]


def _lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Lines with the range that holds them: its file and first byte."""
    lines = spark.read.text(path, lineSep="\n")
    return lines.select("value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_start"))


def count_quotes(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """For each range that holds a line its ``quotes`` and its lines with an odd number of them (``odd``). Runs one job."""
    quotes = F.octet_length("value") - F.octet_length(F.replace("value", F.lit('"'), F.lit("")))
    counts = _lines(spark, path).select(*_RANGE, quotes.alias("n"))
    counts = counts.groupBy(*_RANGE).agg(F.sum("n").alias("quotes"), F.sum(F.col("n") % 2).alias("odd"))
    return materialize(counts, "quotes")


def open_ranges(counts: DataFrame) -> DataFrame:
    """The ranges that begin (``begins``) or end (``ends``) within quotes. Of a file, a row for each range is sorted."""
    order = Window.partitionBy("_file").orderBy("_start")
    upto = F.sum("quotes").over(order.rowsBetween(Window.unboundedPreceding, 0))
    states = counts.select(*_RANGE, (upto % 2 == 1).alias("ends"), ((upto - F.col("quotes")) % 2 == 1).alias("begins"))
    return states.filter(F.col("begins") | F.col("ends"))


class _Range:
    """Joins the lines of one range to records. A range that begins within quotes first closes a record of an earlier
    one: its ``head``. What is ``held`` at the end is open, or, of a file's last range, was never closed."""

    def __init__(self, begins: bool):
        self.begins = self.inside = begins
        self.head: bytes | None = None
        self.held: list[bytes] = []

    def add(self, lines: pa.Array) -> list[bytes]:
        """The other records that end in ``lines``."""
        odd = pc.bit_wise_and(pc.count_substring(lines, '"'), 1).to_numpy(zero_copy_only=False)
        texts = lines.to_numpy(zero_copy_only=False).tolist()
        within = (np.cumsum(odd) + int(self.inside)) % 2 == 1
        waiting = self.begins and self.head is None
        if not self.held and not waiting and not within.any():
            return texts
        out, at = [], 0
        for end in np.flatnonzero(~within).tolist():
            record = b"\n".join([*self.held, *texts[at : end + 1]])
            self.held, at = [], end + 1
            if waiting:
                self.head, waiting = record, False
            else:
                out.append(record)
        self.held += texts[at:]
        self.inside = bool(within[-1])
        return out

    def pieces(self) -> Iterator[tuple[bool, bytes]]:
        """What belongs to records that cross ranges, and whether it is where one begins."""
        if self.head is not None:
            yield False, self.head
        if self.held:
            yield not (self.begins and self.head is None), b"\n".join(self.held)


def _ranges(batches, open_at: frozenset) -> Iterator[tuple[tuple[str, int], _Range, list[bytes]]]:
    """A range, what is known of it, and records that end in it, batch by batch; with None at the end of a range."""
    at, now = None, None
    for batch in batches:
        if not batch.num_rows:
            continue
        files, starts = batch.column("_file").to_pylist(), batch.column("_start").to_numpy()
        keys = list(zip(files, starts.tolist()))
        cuts = [0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1]), len(keys)]
        for a, b in zip(cuts, cuts[1:]):
            if keys[a] != at:
                if now is not None:
                    yield at, now, None
                at, now = keys[a], _Range(keys[a] in open_at)
            yield at, now, now.add(batch.column("value").slice(a, b - a))
    if now is not None:
        yield at, now, None


def _text(values: list[bytes], encoding: str) -> pa.Array:
    """As Spark reads text: bytes that are none become U+FFFD."""
    return pa.array([v.decode(encoding, "replace") for v in values], pa.string())


def _checked(record: bytes, file: str, names: list[str], sep: str, encoding: str) -> None:
    found = next(csv.reader([record.decode(encoding, "replace").removeprefix("\ufeff").removesuffix("\r")], delimiter=sep), [])
    if [n.lower() for n in found] != [n.lower() for n in names]:
        raise ValueError(f"the header of {file} is {found}, not {names}")


def records(
    spark: SparkSession, path: str | list[str], counts: DataFrame, names: list[str] | None, sep: str, encoding: str = "UTF-8"
) -> DataFrame:
    """``record``, the text of each record, and ``file``. With ``names`` the first record of each file is a header, which must
    have these names, and is left out. Empty records are left out."""
    opened = open_ranges(counts).collect()  # a row for each range in which a record crosses a border
    begins = frozenset((r["_file"], r["_start"]) for r in opened if r["begins"])
    crossing = spark.createDataFrame([(r["_file"], r["_start"]) for r in opened], "_file string, _start long")
    lines = _lines(spark, path).withColumn("value", F.col("value").cast("binary"))

    def whole(batches):
        fresh = None
        for key, now, found in _ranges(batches, begins):
            if found is None:
                fresh = None
                continue
            if names is not None and key[1] == 0 and fresh is None and found:
                _checked(found[0], key[0], names, sep, encoding)
                found, fresh = found[1:], False
            found = [f for f in found if f]
            if found:
                yield pa.RecordBatch.from_arrays([_text(found, encoding), pa.array([key[0]] * len(found))], names=["record", "file"])

    def pieces(batches):
        seen = None
        for key, now, found in _ranges(batches, begins):
            if found:
                seen = key
            elif found is None:
                rows = [(key[0], key[1], n, starts, starts and key[1] == 0 and seen != key, piece) for n, (starts, piece) in enumerate(now.pieces())]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names=["file", "start", "nth", "begins", "first", "piece"])

    out = lines.mapInArrow(whole, "record string, file string")
    if not opened:
        return out
    # The lines of other ranges are left out before anything is done with them; no line is moved.
    crossed = lines.join(F.broadcast(crossing), _RANGE, "left_semi").mapInArrow(
        pieces, "file string, start long, nth long, begins boolean, first boolean, piece binary"
    )
    order = Window.partitionBy("file").orderBy("start", "nth").rowsBetween(Window.unboundedPreceding, 0)
    numbered = crossed.withColumn("number", F.sum(F.col("begins").cast("long")).over(order))
    numbered = numbered.select("file", "number", "start", "nth", "first", "piece")

    def join(batches):
        for batch in batches:
            texts = [b"\n".join(p["piece"] for p in parts) for parts in batch.column("parts").to_pylist()]
            yield pa.RecordBatch.from_arrays([_text(texts, encoding), batch.column("file")], names=["record", "file"])

    parts = F.sort_array(F.collect_list(F.struct("start", "nth", "piece"))).alias("parts")
    joined = numbered.groupBy("file", "number").agg(parts, F.max("first").alias("first"))
    if names is not None:
        joined = joined.filter(~F.col("first"))  # a header that crosses ranges
    return out.unionByName(joined.select("file", "parts").mapInArrow(join, "record string, file string"))
