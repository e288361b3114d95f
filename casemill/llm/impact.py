"""Exact top-k by inner product: an impact-ordered index, read score at a time.

Vectors are filed in shards. In each shard and dimension the rows are sorted by their impact, that is, their
component, and cut into segments, of which the least and the largest impact are kept: the quantised impact. A
query reads the segments of all dimensions by descending gain, its component times the segment's impact above
the least that the dimension can give. What a row can still reach is the gains it has met plus, for the
dimensions in which it has not been met, the next gains to come. Once rows whose reach is below the k-th best
score known are proven out, and those left are fewer than the postings left, they are rescored on
the original numbers. Nothing stops without that proof.

A first round asks one shard for each query; its k-th score is where all other shards start from.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from casemill.llm.common import let_go, map_groups, materialize, store

#: Rows of a shard, rows of a segment, and queries that meet a shard in one task.
ROWS, SEGMENT, QUERIES = 8192, 128, 512
#: The share of the postings that a query reads between two looks at what it has proven.
STRIDE = 0.125

__all__ = ["ImpactShard", "search_products"]


class ImpactShard:
    """Rows of whole numbers with their posting segments."""

    def __init__(self, x: np.ndarray, order: np.ndarray | None = None):
        self.x, (self.n, self.dim) = x, x.shape
        self.order = np.argsort(x, axis=0, kind="stable").T.astype(np.uint16) if order is None else order
        starts = np.arange(0, self.n, SEGMENT)
        ends = np.minimum(starts + SEGMENT, self.n)
        ranked = np.take_along_axis(x, self.order.T.astype(np.int64), axis=0)
        self.low, self.high = ranked[starts].T, ranked[ends - 1].T  # by dimension and segment
        self.sizes = np.tile(ends - starts, self.dim)
        # Segments of one width: the last one is filled up with a row that does not exist.
        filled = np.full((self.dim, len(starts) * SEGMENT), self.n, dtype=np.int64)
        filled[:, : self.n] = self.order
        self.postings = filled.reshape(self.dim * len(starts), SEGMENT)

    def best(self, q: np.ndarray, k: int, least: int | None, banned: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows that may be among the ``k`` best, ties included, with their exact scores; none below ``least``, none ``banned``."""
        reach = np.maximum(q[:, None] * self.low, q[:, None] * self.high)  # what a segment's rows can get from it
        floor = reach.min(axis=1)
        base, gains = int(floor.sum()), (reach - floor[:, None]).ravel()
        read = np.argsort(-gains, kind="stable")
        read = read[gains[read] > 0]
        gains_read, sizes = gains[read].astype(np.float64), self.sizes[read]
        per_dim = reach.shape[1]
        slack = 1e-9 * (float(np.abs(reach).max(axis=1).sum()) + 1.0)  # the sums below are of doubles
        total, left = int(sizes.sum()), int(sizes.sum())
        met, seen = np.zeros(self.n + 1), np.zeros(self.n + 1)
        allowed = np.ones(self.n, dtype=bool)
        allowed[banned] = False
        at, threshold = 0, least
        while True:
            rest = read[at:]
            coming = np.zeros(self.dim)
            np.maximum.at(coming, rest // per_dim, gains[rest])
            ahead = np.concatenate([[0.0], np.cumsum(np.sort(coming)[::-1])])  # by dimensions that are still to come
            reachable = base + met[:-1] + ahead[self.dim - seen[:-1].astype(np.int64)]
            if threshold is None or at:
                threshold = self._raise(threshold, q, reachable, allowed, k)
            possible = allowed if threshold is None else allowed & (reachable >= threshold - slack)
            alive = int(possible.sum())
            if alive * self.dim <= left or at >= len(read):
                break
            upto = at + int(np.searchsorted(np.cumsum(sizes[at:]), STRIDE * total)) + 1
            part = read[at:upto]
            places = self.postings[part].ravel()
            met += np.bincount(places, weights=np.repeat(gains_read[at:upto], SEGMENT), minlength=self.n + 1)
            seen += np.bincount(places, minlength=self.n + 1)
            left -= int(sizes[at:upto].sum())
            at = upto
        rows = np.flatnonzero(possible)
        scores = self.x[rows] @ q
        if len(rows) > k:
            limit = np.partition(scores, len(rows) - k)[len(rows) - k]
            rows, scores = rows[scores >= limit], scores[scores >= limit]
        if least is not None:
            rows, scores = rows[scores >= least], scores[scores >= least]
        return rows, scores

    def _raise(self, threshold, q, reachable, allowed, k):
        """The k-th exact score of those that reach furthest: a lower bound on the k-th best."""
        rows = np.flatnonzero(allowed)
        if len(rows) < k:
            return threshold
        some = rows[np.argpartition(-reachable[rows], k - 1)[:k]]
        score = int((self.x[some] @ q).min())
        return score if threshold is None else max(threshold, score)


def _shards(rows: DataFrame, dim: int) -> DataFrame:
    """The index: one row for each shard of at most ``ROWS`` rows of a partition."""

    def run(batches):
        let_go()
        task, number, ids, parts, held = TaskContext.get().partitionId(), 0, [], [], 0

        def done():
            nonlocal number, ids, parts, held
            keys, x = np.concatenate(ids), np.concatenate(parts)
            for a in range(0, len(keys), ROWS):
                part = x[a : a + ROWS]
                shard = ImpactShard(part)
                data = (keys[a : a + ROWS].tobytes(), part.tobytes(), shard.order.tobytes())
                columns = [pa.array([(task << 24) + number]), pa.array([len(part)]), *(pa.array([d], pa.binary()) for d in data)]
                yield pa.RecordBatch.from_arrays(columns, names=["shard", "n", "ids", "x", "order"])
                number += 1
            ids, parts, held = [], [], 0

        for batch in batches:
            if batch.num_rows:
                ids.append(batch.column("_id").to_numpy(zero_copy_only=False).astype(np.int64))
                parts.append(np.asarray(batch.column("x").flatten(), dtype=np.int64).reshape(-1, dim))
                held += batch.num_rows
                if held >= ROWS:
                    yield from done()
        if held:
            yield from done()

    return rows.select("_id", "x").mapInArrow(run, "shard long, n long, ids binary, x binary, order binary")


def _ask(index: DataFrame, pairs: DataFrame, queries: DataFrame, dim: int, k: int) -> DataFrame:
    """What each query of a ``pack`` finds in each ``shard`` of ``pairs``: ``query_id``, ``mark``, ``vec_id``, ``score``."""
    kinds = {"ids": "binary", "x": "binary", "order": "binary", "query": "long", "mark": "long", "ints": "array<long>", "least": "long"}
    empty = lambda *names: [F.lit(None).cast(kinds[n]).alias(n) for n in names]
    left = index.join(pairs, "shard").select("shard", "pack", F.lit(False).alias("asks"), "ids", "x", "order", *empty("query", "mark", "ints", "least"))
    right = queries.join(pairs, "pack").select("shard", "pack", F.lit(True).alias("asks"), *empty("ids", "x", "order"), "query", "mark", "ints", "least")

    def read(batch):
        asks = np.asarray(batch.column("asks"))
        if asks.all() or not asks.any():
            return None
        at = int(np.flatnonzero(~asks)[0])
        ids = np.frombuffer(batch.column("ids")[at].as_py(), dtype=np.int64)
        x = np.frombuffer(batch.column("x")[at].as_py(), dtype=np.int64).reshape(len(ids), dim)
        order = np.frombuffer(batch.column("order")[at].as_py(), dtype=np.uint16).reshape(dim, len(ids))
        shard, out = ImpactShard(x, order), [[], [], [], []]
        for i in np.flatnonzero(asks).tolist():
            query, least = batch.column("query")[i].as_py(), batch.column("least")[i].as_py()
            q = np.array(batch.column("ints")[i].as_py(), dtype=np.int64)
            rows, scores = shard.best(q, k, least, np.flatnonzero(ids == query))
            if len(rows) > k:  # ties at the end: those of smaller ids
                keep = np.lexsort((ids[rows], -scores))[:k]
                rows, scores = rows[keep], scores[keep]
            mark = batch.column("mark")[i].as_py()
            for column, values in zip(out, (np.full(len(rows), query), np.full(len(rows), mark), ids[rows], scores)):
                column.append(values)
        return dict(zip(("query_id", "mark", "vec_id", "score"), map(np.concatenate, out)))

    schema = "query_id long, mark long, vec_id long, score long"
    return map_groups(left.unionByName(right), ["shard", "pack"], ["asks", "query"], read, schema)


def _search(rows: DataFrame, dim: int, asked: int, k: int) -> DataFrame:
    index = store(_shards(rows, dim), "index")
    packs = max(1, math.ceil(asked / QUERIES))
    queries = rows.filter("_query").select(F.col("_id").alias("query"), F.xxhash64("x").alias("mark"), F.col("x").alias("ints")).distinct()
    queries = materialize(queries.withColumn("pack", F.pmod(F.xxhash64("query", "mark"), F.lit(packs)).cast("int")), "queries")
    shards = index.select("shard")
    every = shards.select("shard", F.explode(F.sequence(F.lit(0), F.lit(packs - 1))).alias("pack"))
    # A first shard for each pack: as many shards as there are packs, each chosen by its hash.
    first = shards.groupBy(F.pmod(F.xxhash64("shard"), F.lit(packs)).cast("int").alias("pack")).agg(F.min("shard").alias("shard")).select("shard", "pack")
    found = materialize(_ask(index, first, queries.withColumn("least", F.lit(None).cast("long")), dim, k), "first")
    least = found.groupBy("query_id", "mark").agg(F.min("score").alias("least"), F.count("*").alias("n")).filter(F.col("n") >= k)
    known = queries.join(least.select(F.col("query_id").alias("query"), "mark", "least"), ["query", "mark"], "left")
    others = every.join(first, ["shard", "pack"], "left_anti")
    return found.unionByName(_ask(index, others, known.select(*queries.columns, "least"), dim, k))


def search_products(df: DataFrame, is_query, k: int = 10, scale: int = 1024, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The ``k`` rows of largest inner product for each row for which the condition ``is_query`` holds, other than itself,
    each component as the whole number below ``scale`` times it: ``query_id``, ``rank`` (from 1), ``key``, ``score``; all if
    there are fewer. Exact: the ranking is that of a comparison with all rows. Ties go to the smaller key.

    Vectors that are null, empty, or hold a null or a value that is not finite take no part, nor do rows with a null key,
    nor vectors with a component so large that a product of two could need more than 64 bits (beyond 2.6e5 for 64
    components); only vectors of one length are compared. Zero vectors count. Rows of one key do not find each other;
    equal rows are found each; equal queries are asked once, and of different queries with one key each has ranks of its own.
    Jobs run when this is called: they store the index.
    """
    kind = dict(df.dtypes)[key]
    items = F.col(f"`{vector}`")
    rows = df.select(F.col(f"`{key}`").cast("long").alias("_id"), F.transform(items, lambda v: v.cast("double") * scale).alias("x"), is_query.alias("_query"))
    largest = F.floor(F.sqrt(F.lit(float(2**62)) / F.size("x")))
    fits = F.forall("x", lambda v: F.coalesce(~F.isnan(v) & (F.abs(v) < largest), F.lit(False)))
    rows = rows.filter(F.col("_id").isNotNull() & F.col("x").isNotNull()).filter((F.size("x") > 0) & fits)
    rows = rows.select("_id", F.transform("x", lambda v: F.floor(v).cast("long")).alias("x"), F.coalesce("_query", F.lit(False)).alias("_query"))
    out = None
    lengths = rows.groupBy(F.size("x").alias("dim")).agg(F.count_if("_query").alias("asked")).orderBy("dim")
    for dim, asked in ((r["dim"], r["asked"]) for r in lengths.collect() if r["asked"]):
        found = _search(rows.filter(F.size("x") == dim), dim, asked, k)
        out = found if out is None else out.unionByName(found)
    if out is None:
        out = df.sparkSession.createDataFrame([], "query_id long, mark long, vec_id long, score long")
    order = Window.partitionBy("query_id", "mark").orderBy(F.desc("score"), "vec_id")
    ranked = out.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select(F.col("query_id").cast(kind), "rank", F.col("vec_id").cast(kind).alias(key), "score")
