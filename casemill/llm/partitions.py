"""Nearest neighbours by learned partitions.

On a bounded sample, the graph of nearest neighbours is cut into parts of equal size with few edges
between them; a small network learns to tell a vector's part. Where parts hold many rows, each is cut again in the same way by a network of its own, fitted in a task on a
bounded sample of the part, so that parts grow in number with the table. Every row is filed under its most probable
part, and a query is sent to several. How many is measured: queries of an audit are compared with all
rows, and enough parts are opened to hold nearly all of their true neighbours.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from casemill.llm.common import has_direction, map_groups, materialize
from casemill.llm.vectors import cosines, matrix, unit

#: Rows that a network is fitted on; neighbours in the graph; parts of a cut at most; audited queries; their recall.
SAMPLE, NEIGHBOURS, PARTS, AUDIT, RECALL = 4096, 10, 64, 96, 0.95
#: Rows of a part from which it is cut again, about as many as the parts of a whole cut have; rows that this is fitted on.
LEAF, INNER = 1024, 2048
#: Rows and queries of a block that is compared at once.
ROWS, QUERIES = 4096, 1024


def neighbour_graph(x: np.ndarray, k: int) -> np.ndarray:
    """Which rows are among each other's ``k`` nearest, as weights."""
    near = (x @ x.T).astype(np.float32)
    np.fill_diagonal(near, -2)
    k = min(k, len(x) - 1)
    graph = np.zeros_like(near)
    if k:
        at = np.argpartition(-near, k - 1, axis=1)[:, :k]
        np.put_along_axis(graph, at, 1, axis=1)
    return graph + graph.T


def halves(graph: np.ndarray, rng) -> np.ndarray:
    """Two halves of equal size with few edges between: split along the slowest wave of the graph, then swap
    pairs of rows that are better off on the other side."""
    n = len(graph)
    degree = np.maximum(graph.sum(axis=1), 1e-6)
    root = np.sqrt(degree)
    even = root / np.linalg.norm(root)
    wave = rng.normal(size=n).astype(np.float32)
    for _ in range(60):
        wave = 0.5 * (wave + (graph @ (wave / root)) / root)
        wave -= even * (even @ wave)
        wave /= np.linalg.norm(wave) + 1e-12
    side = np.zeros(n, dtype=bool)
    side[np.argsort(wave / root, kind="stable")[n // 2 :]] = True
    for _ in range(20):
        pull = graph @ np.where(side, 1.0, -1.0)
        gain = np.where(side, -pull, pull)
        a, b = (np.flatnonzero(s)[np.argsort(-gain[s], kind="stable")] for s in (side, ~side))
        m = max(1, min(len(a), len(b)) // 16)
        better = [(i, j) for i, j in zip(a[:m], b[:m]) if gain[i] + gain[j] > 2 * graph[i, j]]
        if not better:
            break
        for i, j in better[: max(1, len(better) // 2)]:
            side[i], side[j] = False, True
    return side


def balanced_parts(graph: np.ndarray, parts: int, seed: int = 5) -> np.ndarray:
    """``parts`` (a power of two) of equal size, by halving."""
    rng, out = np.random.default_rng(seed), np.zeros(len(graph), dtype=np.int64)
    groups = [np.arange(len(graph))]
    while len(groups) < parts:
        split = []
        for g in groups:
            side = halves(graph[np.ix_(g, g)], rng) if len(g) > 1 else np.zeros(len(g), dtype=bool)
            split += [g[~side], g[side]]
        groups = split
    for k, g in enumerate(groups):
        out[g] = k
    return out


class Router(NamedTuple):
    """A network of one hidden layer from a unit vector to log shares of the parts."""

    w: np.ndarray
    b: np.ndarray
    v: np.ndarray
    c: np.ndarray

    @classmethod
    def fit(cls, x: np.ndarray, parts: np.ndarray, count: int, hidden: int = 128, epochs: int = 60, seed: int = 9) -> Router:
        rng = np.random.default_rng(seed)
        p = [rng.normal(size=(x.shape[1], hidden)), np.zeros(hidden), rng.normal(size=(hidden, count)) / hidden**0.5, np.zeros(count)]
        m, s, t = [np.zeros_like(q) for q in p], [np.zeros_like(q) for q in p], 0
        for _ in range(epochs):
            for rows in np.array_split(rng.permutation(len(x)), max(1, len(x) // 128)):
                h = np.maximum(x[rows] @ p[0] + p[1], 0)
                z = h @ p[2] + p[3]
                e = np.exp(z - z.max(axis=1, keepdims=True))
                e /= e.sum(axis=1, keepdims=True)
                e[np.arange(len(rows)), parts[rows]] -= 1
                e /= len(rows)
                back = (e @ p[2].T) * (h > 0)
                t += 1
                for i, g in enumerate((x[rows].T @ back, back.sum(axis=0), h.T @ e, e.sum(axis=0))):
                    m[i] = 0.9 * m[i] + 0.1 * g
                    s[i] = 0.999 * s[i] + 0.001 * g * g
                    p[i] = p[i] - 0.003 * (m[i] / (1 - 0.9**t)) / (np.sqrt(s[i] / (1 - 0.999**t)) + 1e-8)
        return cls(*p)

    def scores(self, x: np.ndarray) -> np.ndarray:
        return np.maximum(x @ self.w + self.b, 0) @ self.v + self.c


def _log_shares(z: np.ndarray) -> np.ndarray:
    z = z - z.max(axis=1, keepdims=True)
    return z - np.log(np.exp(z).sum(axis=1, keepdims=True))


class Tree(NamedTuple):
    """Parts, and the cuts of those that are cut again. A leaf's number is its part times ``PARTS`` plus its place in it."""

    top: Router
    inner: dict[int, Router]

    def leaves(self) -> np.ndarray:
        each = [range(len(self.inner[p].c)) if p in self.inner else range(1) for p in range(len(self.top.c))]
        return np.array([p * PARTS + i for p, places in enumerate(each) for i in places], dtype=np.int64)

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Log shares of all leaves."""
        top = _log_shares(self.top.scores(x))
        return np.concatenate([top[:, [p]] + _log_shares(self.inner[p].scores(x)) if p in self.inner else top[:, [p]] for p in range(top.shape[1])], axis=1)

    def file(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row: of its most probable part the most probable."""
        part = self.top.scores(x).argmax(axis=1) if len(x) else np.zeros(0, dtype=np.int64)
        leaf = part * PARTS
        for p in np.unique(part):
            if p in self.inner:
                own = np.flatnonzero(part == p)
                leaf[own] += self.inner[p].scores(x[own]).argmax(axis=1)
        return leaf


def fit_router(rows: DataFrame, dim: int, count: int) -> Router:
    """Fit on the ``SAMPLE`` rows with the smallest hashes. Parts grow with the root of the rows."""
    some = rows.orderBy(F.xxhash64("_id", F.lit(1))).limit(SAMPLE).select("vector").collect()
    x = unit(np.array([r["vector"] for r in some], dtype=np.float64).reshape(len(some), dim))
    parts = 2 ** int(np.clip(np.ceil(np.log2(max(count, 1) ** 0.5 / 4)), 0, np.log2(PARTS)))
    parts = min(parts, 2 ** int(np.log2(max(len(x), 1))))
    return Router.fit(x, balanced_parts(neighbour_graph(x, NEIGHBOURS), parts), parts)


def fit_inner(filed: DataFrame) -> dict[int, Router]:
    """A network for each part (``part``, numbered as leaves) of more than ``LEAF`` rows, each fitted in a task on about ``INNER`` rows of it, chosen
    by hash. There are ``PARTS`` of them at most, so what the driver holds is bounded by the length of a vector."""
    sizes = filed.groupBy("part").count().filter(F.col("count") > LEAF)
    drawn = F.pmod(F.xxhash64("_id", F.lit(6)), F.lit(1 << 30)) < F.lit(float(INNER << 30)) / F.col("count")
    some = filed.join(F.broadcast(sizes), "part").filter(drawn).select("part", "count", "_id", "vector")

    def fit(batch):
        part, count = batch.column("part")[0].as_py(), batch.column("count")[0].as_py()
        x = unit(matrix(batch.column("vector")))
        cuts = min(2 ** int(np.ceil(np.log2(count / LEAF))), PARTS, 2 ** int(np.log2(len(x))))
        router = Router.fit(x, balanced_parts(neighbour_graph(x, NEIGHBOURS), cuts), cuts, hidden=64)
        return {"part": [part], **{n: [np.asarray(a, dtype=np.float32).tobytes()] for n, a in router._asdict().items()}}

    found = map_groups(some, ["part"], ["_id"], fit, "part long, w binary, b binary, v binary, c binary").collect()
    out = {}
    for r in found:
        w, b, v, c = (np.frombuffer(r[n], dtype=np.float32).astype(np.float64) for n in "wbvc")
        out[r["part"] // PARTS] = Router(w.reshape(-1, len(b)), b, v.reshape(len(b), -1), c)
    return out


def _nearest(ids, scores, keep):
    order = np.lexsort((ids, -scores))[:keep]
    return ids[order], scores[order]


def _opened(filed: DataFrame, queries: DataFrame, tree: Tree, k: int) -> int:
    """Parts to open: enough for ``RECALL`` of the true neighbours of audited queries, found among all rows."""
    some = queries.orderBy(F.xxhash64("_id", F.lit(2))).limit(AUDIT).select("_id", "vector").collect()
    leaves = tree.leaves()
    if not some or len(leaves) == 1:
        return len(leaves)
    ids, x = np.array([r["_id"] for r in some]), unit(np.array([r["vector"] for r in some], dtype=np.float64))

    def near(batches):
        for batch in batches:
            if not len(batch):
                continue
            rows, part = batch.column("_id").to_numpy(), batch.column("part").to_numpy()
            scores = x @ unit(matrix(batch.column("vector"))).T
            scores[ids[:, None] == rows[None, :]] = -2
            at = np.argpartition(-scores, min(k, len(rows)) - 1, axis=1)[:, :k]
            q = np.repeat(np.arange(len(ids)), at.shape[1])
            at = at.ravel()
            good = scores[q, at] > -2
            columns = (ids[q[good]], rows[at[good]], scores[q[good], at[good]], part[at[good]])
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["q", "id", "score", "part"])

    ranked = filed.mapInArrow(near, "q long, id long, score double, part long").withColumn(
        "rank", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "id"))
    )
    order = leaves[np.argsort(-tree.scores(x), axis=1, kind="stable")]
    place = {int(q): {int(p): i for i, p in enumerate(row)} for q, row in zip(ids, order)}
    depths = sorted(place[r["q"]][r["part"]] for r in ranked.filter(F.col("rank") <= k).collect())
    return depths[max(0, int(np.ceil(RECALL * len(depths))) - 1)] + 1 if depths else len(leaves)


def search_vectors(df: DataFrame, is_query, k: int = 5, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The ``k`` nearest rows by cosine that are found for each row for which the condition ``is_query`` holds, other
    than itself: ``query_id``, ``rank`` (from 1), ``key``, ``score``; all if there are fewer. Ties go to the smaller key.

    Vectors that are null, empty, all zero, or hold a null or a value that is not finite take no part, nor do rows
    with a null key; only vectors of one length are compared. Rows of one key do not find each other. Equal rows
    are found each. Jobs run when this is called: they fit the index, and measure its recall against all rows.
    """
    kind = dict(df.dtypes)[key]
    rows = df.select(
        F.col(key).cast("long").alias("_id"), F.transform(F.col(vector), lambda x: x.cast("double")).alias("vector"), is_query.alias("_query")
    ).filter(has_direction(F.col("vector")) & F.col("_id").isNotNull())
    out = None
    lengths = rows.groupBy(F.size("vector").alias("dim")).agg(F.count("*").alias("n"), F.max("_query").alias("asked")).orderBy("dim")
    for dim, count in ((r["dim"], r["n"]) for r in lengths.collect() if r["asked"]):
        found = _search(rows.filter(F.size("vector") == dim), dim, count, k)
        out = found if out is None else out.unionByName(found)
    if out is None:
        out = df.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    return out.select(F.col("query_id").cast(kind), "rank", F.col("vec_id").cast(kind).alias(key), "score")


def _search(rows: DataFrame, dim: int, count: int, k: int) -> DataFrame:
    def filing(tree):
        def file(batches):
            for batch in batches:
                x = unit(matrix(batch.column("vector"))) if len(batch) else np.zeros((0, dim))
                yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in ("_id", "vector", "_query")), pa.array(tree.file(x), pa.int64())], names=["_id", "vector", "_query", "part"])

        return file

    kind = "_id long, vector array<double>, _query boolean, part long"
    tree = Tree(fit_router(rows, dim, count), {})
    filed = materialize(rows.mapInArrow(filing(tree), kind), "filed")
    if count > PARTS * LEAF:
        tree = Tree(tree.top, fit_inner(filed))
        filed = materialize(filed.mapInArrow(filing(tree), kind), "filed")
    queries = filed.filter("_query").select("_id", "vector")
    leaves, opened = tree.leaves(), _opened(filed, queries, tree, k)

    def route(batches):
        for whole in batches:
            for at in range(0, len(whole), 256):  # a row has a score for each of up to PARTS * PARTS leaves
                batch = whole.slice(at, 256)
                order = leaves[np.argsort(-tree.scores(unit(matrix(batch.column("vector")))), axis=1, kind="stable")[:, :opened]]
                yield batch.append_column("parts", pa.array(list(order), pa.list_(pa.int64())))

    sent = queries.mapInArrow(route, "_id long, vector array<double>, parts array<long>").select("_id", "vector", F.explode("parts").alias("part"))
    # A part is compared in blocks: some of its rows with some of its queries.
    loads = filed.groupBy("part").agg(F.ceil(F.count("*") / ROWS).cast("int").alias("chunks"))
    asked = sent.groupBy("part").agg(F.ceil(F.count("*") / QUERIES).cast("int").alias("packs"))
    blocks = materialize(loads.join(asked, "part"), "blocks")
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    some = lambda n, salt: F.pmod(F.xxhash64("_id", F.lit(salt)), F.col(n)).cast("int")
    left = filed.join(blocks, "part").select("part", some("chunks", 3).alias("chunk"), spread("packs").alias("pack"), F.lit(False).alias("asks"), "_id", "vector")
    right = sent.join(blocks, "part").select("part", spread("chunks").alias("chunk"), some("packs", 4).alias("pack"), F.lit(True).alias("asks"), "_id", "vector")

    def rerank(batch):
        asks, ids, x = np.asarray(batch.column("asks")), batch.column("_id").to_numpy(), matrix(batch.column("vector"))
        rows, r = ids[~asks], x[~asks]
        if not len(rows) or not asks.any():
            return None
        queries, asked, columns = ids[asks], x[asks], [[], [], []]
        scores = unit(asked) @ unit(r).T
        scores[queries[:, None] == rows[None, :]] = -2
        for i, q in enumerate(queries):
            own = scores[i]
            last = np.partition(own, len(own) - min(k, len(own)))[len(own) - min(k, len(own))]
            at = np.flatnonzero((own >= last - 1e-9) & (own > -2))
            exact = cosines(np.broadcast_to(asked[i], (len(at), x.shape[1])), r[at])
            for column, values in zip(columns, (np.full(min(k, len(at)), q), *_nearest(rows[at], exact, k))):
                column.append(values)
        return dict(zip(("query_id", "vec_id", "score"), map(np.concatenate, columns)))

    found = map_groups(left.unionByName(right), ["part", "chunk", "pack"], ["asks", "_id"], rerank, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
