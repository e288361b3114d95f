"""Cover what repeats: of each window that also starts earlier, the symbols.

What two operators share. Windows are found by their anchors (``windows``). One shuffle by anchor
settles nearly all: a window whose anchor is alone in the corpus is alone, and of anchors with the
same surroundings all but the first are repeats. What is left are surroundings that share an
anchor and differ further off; their texts are fetched and an operator's own method tells which of
their windows are equal.

Order is by key, then place. A null key comes last. Rows of one key are told apart by a number in the
order of their texts' hashes; rows of one key and one text are one document and get the same result.
"""

from __future__ import annotations

from collections.abc import Callable
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from casemill.llm.common import chunks, let_go, map_chunks, materialize, store, text_bytes
from casemill.llm.windows import anchored

LAST = 2**63 - 1
#: Surroundings of one anchor in a chunk from which they are dealt out one by one.
CROWD = 16


def text_hash(text):
    return F.xxhash64(F.coalesce(text, F.lit("")))


def numbered(df: DataFrame, key: str, text: str, carry: list[str] | tuple = ()) -> DataFrame:
    """``_key``, ``_doc`` and ``_copy`` that identify the document, ``_text``, and the columns ``carry`` as ``_rest``."""
    docs = df.select(
        F.col(key).alias("_key"),
        F.coalesce(F.col(key).cast("long"), F.lit(LAST)).alias("_doc"),
        F.col(text).alias("_text"),
        *([F.struct(*(F.col(f"`{c}`") for c in carry)).alias("_rest")] if carry else []),
    )
    again = docs.groupBy("_doc").count().filter("count > 1").select("_doc")
    marks = docs.select("_doc", text_hash(F.col("_text")).alias("_mark")).join(again, "_doc", "left_semi").distinct()
    copies = materialize(marks.withColumn("_copy", F.row_number().over(Window.partitionBy("_doc").orderBy("_mark")) - 1), "copies")
    rest = ["_rest"] if carry else []
    if copies.isEmpty():  # no key comes twice, so no text has to move
        return docs.select("_key", "_doc", F.lit(0).alias("_copy"), "_text", *rest)
    marked = docs.withColumn("_mark", text_hash(F.col("_text")))
    return marked.join(copies, ["_doc", "_mark"], "left").select(
        "_key", "_doc", F.coalesce("_copy", F.lit(0)).cast("int").alias("_copy"), "_text", *rest
    )


def packed(docs: DataFrame) -> DataFrame:
    """The texts compressed, for a shuffle of whole documents."""
    names = [n for n in docs.columns if n != "_text"]
    kinds = dict(docs.dtypes)

    def make():
        press = zstandard.ZstdCompressor(level=3)

        def work(batch):
            return {n: batch.column(n) for n in names} | {"_data": [press.compress(t) for t in text_bytes(batch.column("_text"))]}

        return work

    return map_chunks(docs, "_text", make, ", ".join(f"{n} {kinds[n]}" for n in names) + ", _data binary")


def joined_runs(doc, copy, first, last, width):
    """Ranges (exclusive ends) that windows ``first`` to ``last`` cover, touching ones of a document as one."""
    if not len(doc):
        return doc, copy, first, last
    order = np.lexsort((first, copy, doc))
    doc, copy, first, last = doc[order], copy[order], first[order], last[order]
    same = (doc[1:] == doc[:-1]) & (copy[1:] == copy[:-1]) & (first[1:] <= last[:-1] + width)
    new = np.flatnonzero(np.concatenate([[True], ~same]))
    return doc[new], copy[new], first[new], last[np.append(new[1:] - 1, len(doc) - 1)] + width


_OCCURRENCES = pa.schema(
    [("_to", pa.int64()), ("_kind", pa.int8()), ("anchor", pa.int64()), ("around", pa.int64()), ("_doc", pa.int64()), ("_copy", pa.int32()), ("first", pa.int64()), ("more", pa.int64())]
)
_SQL = "_to long, _kind byte, anchor long, around long, _doc long, _copy int, first long, more long"
ALONE, CROWDED, MARKER, REMOVED = 0, 1, 2, 3


def _occurrences(docs: DataFrame, symbols, width: int, gram: int) -> DataFrame:
    """A row for each anchor with its surroundings, once in a chunk: ``ALONE``, or ``CROWDED`` if the chunk has many
    surroundings of the anchor, which then also has a ``MARKER``. Later ones in the chunk are ``REMOVED``
    ranges. ``_to`` is what the rows are dealt out by; ``more`` is how far the end lies behind ``first``."""

    def run(batches):
        let_go()
        for batch in chunks(batches, "_text"):
            docs, copies = batch.column("_doc").to_numpy(), batch.column("_copy").to_numpy()
            parts = []
            for runs, index, places in anchored(map(symbols, text_bytes(batch.column("_text"))), width, gram):
                at = places[runs.sequence] - runs.bounds[runs.sequence]
                owner = index[runs.sequence]
                parts.append((runs.anchor.view(np.int64), runs.context().view(np.int64), docs[owner], copies[owner], runs.first + at, runs.last + at))
            if not parts:
                continue
            anchor, around, doc, copy, first, last = (np.concatenate(x) for x in zip(*parts))
            order = np.lexsort((first, copy, doc, around, anchor))
            anchor, around, doc, copy, first, last = (x[order] for x in (anchor, around, doc, copy, first, last))
            new = np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (around[1:] != around[:-1])])
            head = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
            twin = (doc == doc[head]) & (copy == copy[head]) & (first == first[head])
            gone = ~new & ~twin
            ranges = joined_runs(doc[gone], copy[gone], first[gone], last[gone], width)
            anchor, around, doc, copy, first, last = (x[new] for x in (anchor, around, doc, copy, first, last))
            group = np.concatenate([[True], anchor[1:] != anchor[:-1]])
            starts = np.flatnonzero(group)
            sizes = np.diff(np.append(starts, len(anchor)))
            crowd = np.repeat(sizes >= CROWD, sizes)
            marks = starts[sizes >= CROWD]
            kind = np.concatenate([crowd.astype(np.int8), np.full(len(marks), MARKER, np.int8), np.full(len(ranges[0]), REMOVED, np.int8)])
            none, zero = np.zeros(len(ranges[0]), np.int64), np.zeros(len(marks), np.int64)
            to = np.concatenate([np.where(crowd, anchor ^ around, anchor), anchor[marks], ranges[0] * 31 + ranges[2]])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(x, f.type)
                    for x, f in zip(
                        (
                            to,
                            kind,
                            np.concatenate([anchor, anchor[marks], none]),
                            np.concatenate([around, zero, none]),
                            np.concatenate([doc, zero, ranges[0]]),
                            np.concatenate([copy, zero.astype(np.int32), ranges[1]]),
                            np.concatenate([first, zero, ranges[2]]),
                            np.concatenate([last - first, zero, ranges[3] - ranges[2]]),
                        ),
                        _OCCURRENCES,
                    )
                ],
                schema=_OCCURRENCES,
            )

    return docs.select("_doc", "_copy", "_text").mapInArrow(run, _SQL)


def _settled(occurrences: DataFrame, width: int) -> DataFrame:
    """``REMOVED`` ranges; and as ``ALONE`` the first of each surroundings whose anchor has others too."""
    rows = occurrences.repartition("_to")
    here = F.struct("_doc", "_copy", "first")
    same = Window.partitionBy("_to", "anchor", "around").orderBy("_doc", "_copy", "first")
    near = Window.partitionBy("_to", "anchor")
    judged = (
        rows.withColumn("_head", F.first(here).over(same))
        .withColumn("_several", (F.min("around").over(near) != F.max("around").over(near)) | F.max(F.col("_kind").isin(CROWDED, MARKER)).over(near))
        .filter(F.col("_kind") != MARKER)
    )
    gone = F.col("_kind") == REMOVED
    later = ~gone & (here > F.col("_head"))
    return judged.filter(gone | later | F.col("_several")).select(
        (gone | later).alias("gone"),
        "anchor",
        "_doc",
        "_copy",
        "first",
        (F.col("first") + F.col("more") + F.when(later, width).otherwise(0)).alias("last"),
    )


def _slices(docs: DataFrame, open_ends: DataFrame, slicer, width: int, crowd: int) -> DataFrame:
    """The text of each surroundings, under its anchor; of a hot anchor, of each window under a hash of it."""
    hot = open_ends.groupBy("anchor").count().filter(F.col("count") > crowd).select("anchor", F.lit(True).alias("hot"))
    # Stored, so that its size is known: few anchors are hot, and then no row moves to meet them.
    hot = materialize(hot, "hot")
    wanted = open_ends.join(hot, "anchor", "left")
    listed = wanted.groupBy("_doc", "_copy").agg(
        F.collect_list(F.struct("anchor", "first", "last", F.coalesce("hot", F.lit(False)).alias("hot"))).alias("_wanted")
    )
    # Rows of one key and text give the same slices twice; equal places do not count as repeats.
    joined = packed(docs.select("_doc", "_copy", "_text")).join(listed, ["_doc", "_copy"])

    def make():
        unpress = zstandard.ZstdDecompressor()

        def work(batch):
            out = {n: [] for n in ("group", "_doc", "_copy", "first", "last", "slice")}
            columns = (batch.column(n).to_pylist() for n in ("_doc", "_copy", "_data", "_wanted"))
            for doc, copy, data, wanted in zip(*columns):
                cut = slicer(unpress.decompress(data))
                for x in wanted:
                    pieces = [(x["first"], x["last"])]
                    if x["hot"]:
                        pieces = [(i, i) for i in range(x["first"], x["last"] + 1)]
                    for a, b in pieces:
                        piece = cut(a, b + width)
                        group = x["anchor"] ^ (slice_hash(piece) if x["hot"] else 0)
                        for name, value in zip(out, (group, doc, copy, a, b, piece)):
                            out[name].append(value)
            return out

        return work

    return map_chunks(joined, "_data", make, "group long, _doc long, _copy int, first long, last long, slice binary")


def slice_hash(data: bytes) -> int:
    return int.from_bytes(blake2b(data, digest_size=8).digest(), "little", signed=True)


def _told_apart(slices: DataFrame, resolve, width: int, limit: int) -> DataFrame:
    """Ranges of the windows that a method finds to be repeats, group by group."""
    rows = slices.repartition("group").sortWithinPartitions("group", "_doc", "_copy", "first")

    def run(batches):
        let_go()
        items: list[tuple] = []
        held, seen, carried = 0, set(), None

        def flush():
            nonlocal items, held, seen, carried
            last_group = items[-1][0]
            gone, windows = resolve(items, seen if items[0][0] == carried else set())
            out = [(d, c, f + a, f + b) for (_, d, c, f, _, _), spans in zip(items, gone) for a, b in spans]
            keep = {w for x, ws in zip(items, windows) if x[0] == last_group for w in ws}
            seen = keep | seen if carried == last_group and items[0][0] == last_group else keep
            carried, items, held = last_group, [], 0
            columns = list(zip(*out)) or [()] * 4
            return pa.RecordBatch.from_arrays(
                [pa.array(x, t) for x, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.int64()))], names=["_doc", "_copy", "first", "last"]
            )

        for batch in batches:
            for row in zip(*(batch.column(n).to_pylist() for n in ("group", "_doc", "_copy", "first", "last", "slice"))):
                if held >= limit and (row[0] != items[-1][0] or held >= 8 * limit):
                    yield flush()
                items.append(row)
                held += row[4] - row[3] + 1
        if items:
            yield flush()

    return rows.mapInArrow(run, "_doc long, _copy int, first long, last long")


def repeated_ranges(docs: DataFrame, symbols, slicer, resolve: Callable, width: int, gram: int, limit: int, hot: int) -> DataFrame:
    """``_doc``, ``_copy``, ``_ranges``: of each document with repeats, the ranges of symbols to remove.

    ``symbols`` makes hashes of a text's symbols and ``slicer`` a function that returns the bytes of a range
    of them. ``resolve(items, seen)`` gets slices ``(group, doc, copy, first, last, bytes)`` in order, and the
    windows of the first group that came before; it returns for each the ranges that repeat, counted
    from ``first``, and its windows. An anchor with more than ``hot`` surroundings is dealt out by single windows.
    """
    settled = store(_settled(_occurrences(docs, symbols, width, gram), width), "settled")
    open_ends = settled.filter(~F.col("gone")).select("anchor", "_doc", "_copy", "first", "last")
    found = _told_apart(_slices(docs, open_ends, slicer, width, hot), resolve, width, limit)
    gone = settled.filter("gone").select("_doc", "_copy", "first", "last").unionByName(found)
    return gone.groupBy("_doc", "_copy").agg(F.collect_list(F.struct("first", "last")).alias("_ranges"))


def marked(ranges, n: int) -> np.ndarray:
    """Which of ``n`` symbols some range covers."""
    steps = np.zeros(n + 1, dtype=np.int64)
    if ranges:
        pairs = np.array([(r["first"], r["last"]) for r in ranges], dtype=np.int64)
        np.add.at(steps, pairs[:, 0], 1)
        np.add.at(steps, pairs[:, 1], -1)
    return np.cumsum(steps[:n]) > 0


def removed(docs: DataFrame, ranges: DataFrame, make: Callable[[], Callable], schema: str) -> DataFrame:
    """Apply ``work(key column, texts, ranges)`` to all documents, each with the ranges that are removed from it."""
    same = [(n, t) for n, t in docs.dtypes if n in ("_key", "_rest")]
    joined = packed(docs).join(ranges, ["_doc", "_copy"], "left").select(*(n for n, _ in same), "_data", "_ranges")

    def start():
        unpress, work = zstandard.ZstdDecompressor(), make()

        def run(batch):
            texts = [unpress.decompress(x) for x in batch.column("_data").to_pylist()]
            return {n: batch.column(n) for n, _ in same} | work(texts, batch.column("_ranges").to_pylist())

        return run

    return map_chunks(joined, "_data", start, ", ".join(f"{n} {t}" for n, t in same) + f", {schema}")
