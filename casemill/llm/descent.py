"""Near-duplicate vectors by NN-descent."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from casemill.llm.common import has_direction, map_groups, materialize
from casemill.llm.graphs import components
from casemill.llm.vectors import cosines, matrix, unit

#: Length of a list, of others of the own group and of other groups; rows of a block; rounds of a pass and passes at most.
LIST, BLOCK, ROUNDS, PASSES = 8, 64, 6, 4
#: Audited vectors, the links that they must have between them, and the share of these to be found.
AUDIT, EVIDENCE, RECALL = 256, 30, 0.99
#: How likely a pair at the limit may share no table of one pass; rows of a block where all of a component, or of a space, meet.
MISS, MEMBERS, ALL = 0.01, 256, 1024
SLACK = 1e-6
_MET = "u long, v long, near double, new boolean, inside boolean, tie boolean"


def _links(a: np.ndarray, b: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Products of all rows of ``a`` and ``b``, and which of them are links; what the product leaves open the cosine settles."""
    near = a @ b.T
    links = near >= least
    unsure = np.argwhere(np.abs(near - least) < SLACK)
    if len(unsure):
        i, j = unsure.T
        links[i, j] = cosines(a[i], b[j]) >= least
    return near, links


def _reached(links: np.ndarray) -> np.ndarray:
    """For each row of a symmetric matrix of links the first row that it reaches."""
    first = np.arange(len(links))
    if not links.any():
        return first
    while True:
        then = np.minimum(first, np.where(links, first, len(links)).min(axis=1))
        then = then[then]
        if (then == first).all():
            return first
        first = then


def _meet(ids: np.ndarray, group: np.ndarray, x: np.ndarray, least: float, floors=None, fresh=None) -> dict:
    """All of a block compared: for each row the ``LIST`` nearest others of its own group and of other groups, those that
    beat its ``floors`` (by kind) and are not both old; and ties, which join groups as all links of the block do."""
    near, links = _links(x, x, least)
    others = ids[:, None] != ids[None, :]
    first = _reached(links & others)
    tied = np.flatnonzero(group[first] != group)
    inside = group[:, None] == group[None, :]
    u, v, is_inside = [tied], [first[tied]], [np.zeros(len(tied), dtype=bool)]
    keep = min(LIST, len(ids))
    for kind in (False, True):
        fit = others & (inside == kind)
        if floors is not None:
            fit &= near > floors[kind][:, None]
        if fresh is not None:
            fit &= fresh[:, None] | fresh[None, :]
        if not fit.any():
            continue
        at = np.argpartition(np.where(fit, -near, 2), keep - 1, axis=1)[:, :keep].ravel()
        rows = np.repeat(np.arange(len(ids)), keep)
        good = fit[rows, at]
        u.append(rows[good]), v.append(at[good]), is_inside.append(np.full(int(good.sum()), kind))
    u, v = np.concatenate(u), np.concatenate(v)
    tie = np.arange(len(u)) < len(tied)
    return {"u": ids[u], "v": ids[v], "near": near[u, v], "new": np.ones(len(u), dtype=bool), "inside": np.concatenate(is_inside), "tie": tie}


def _lists(edges: DataFrame) -> DataFrame:
    """The ``LIST`` nearest of each node, in its own group and in others, each neighbour once."""
    once = edges.groupBy("u", "v", "inside").agg(F.max("near").alias("near"), F.min("new").alias("new"))
    ranked = once.withColumn("_rank", F.row_number().over(Window.partitionBy("u", "inside").orderBy(F.desc("near"), "v")))
    return ranked.filter(F.col("_rank") <= LIST).drop("_rank")


def _tables(bits: int, least: float) -> int:
    """Tables in which a pair at the limit lies on one side of all planes once, but for a share of ``MISS``."""
    same = (1 - np.arccos(np.clip(least, -1, 1)) / np.pi) ** bits
    return int(np.ceil(np.log(MISS) / np.log1p(-same))) if same < 1 - MISS else 1


def _first_meetings(nodes: DataFrame, dim: int, count: int, least: float, turn: int) -> DataFrame:
    """What blocks of nodes hold whose vectors lie on the same sides of random planes, others for each ``turn``."""
    bits = int(np.clip(np.ceil(np.log2(max(count, 1) / (BLOCK // 2))), 0, 40))
    tables = _tables(bits, least)
    planes = np.random.default_rng(11 + turn).normal(size=(tables, bits, dim))

    def coded(batches):
        import pyarrow as pa

        for batch in batches:
            x = matrix(batch.column("vector")) if len(batch) else np.zeros((0, dim))
            for t in range(tables):
                sides = (x @ planes[t].T > 0).astype(np.int64)
                code = (sides << np.arange(bits)).sum(axis=1) + (t << 41)
                yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in ("space", "node", "group", "vector")), pa.array(code)], names=["space", "node", "group", "vector", "code"])

    rows = nodes.select("space", "node", "group", "vector").mapInArrow(coded, "space long, node long, group long, vector array<double>, code long")
    blocks = rows.groupBy("space", "code").agg(F.ceil(F.count("*") / BLOCK).alias("blocks")).filter("blocks > 1")
    dealt = rows.join(blocks, ["space", "code"], "left").withColumn("block", F.pmod(F.xxhash64("node", "code", F.lit(turn)), F.coalesce("blocks", F.lit(1))))

    def near(batch):
        if len(batch) > 1:
            return _meet(batch.column("node").to_numpy(), batch.column("group").to_numpy(), matrix(batch.column("vector")), least)

    return map_groups(dealt.select("space", "code", "block", "node", "group", "vector"), ["space", "code", "block"], ["node"], near, _MET)


def _joined(lists: DataFrame, nodes: DataFrame, least: float) -> DataFrame:
    """Neighbours of neighbours: around each node its list and the nodes that list it, in blocks; those nearer than the
    last of a list are new for it."""
    floor = {k: F.when(F.count_if(c) >= LIST, F.min(F.when(c, F.col("near")))).otherwise(-1.5) for k, c in (("near_in", F.col("inside")), ("near_out", ~F.col("inside")))}
    ends = lists.groupBy("u").agg(*(f.alias(k) for k, f in floor.items()))
    both = lists.select(F.col("u").alias("hub"), F.col("v").alias("node"), "new").unionByName(lists.select(F.col("v").alias("hub"), F.col("u").alias("node"), "new"))
    around = both.groupBy("hub", "node").agg(F.max("new").alias("new"))
    # A hub that very many list is dealt out over blocks; its own list's members meet in some of them.
    crowd = around.groupBy("hub").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"), F.max("new").alias("any")).filter("any")
    dealt = around.join(crowd, "hub").withColumn("block", F.pmod(F.xxhash64("node", "hub"), F.col("blocks")))
    full = dealt.join(nodes.select("node", "group", "vector"), "node").join(ends, F.col("node") == F.col("u"), "left")
    full = full.select("hub", "block", "node", "group", "new", "vector", *(F.coalesce(k, F.lit(-1.5)).alias(k) for k in floor))

    def near(batch):
        if len(batch) > 1:
            ids, group, x = batch.column("node").to_numpy(), batch.column("group").to_numpy(), matrix(batch.column("vector"))
            floors = batch.column("near_out").to_numpy(), batch.column("near_in").to_numpy()
            return _meet(ids, group, x, least, floors, np.asarray(batch.column("new")))  # two old ones have met before

    return map_groups(full, ["hub", "block"], ["node"], near, _MET)


def _audit(nodes: DataFrame, lists: DataFrame, least: float) -> tuple[int, int, DataFrame]:
    """``AUDIT`` nodes compared with all, half of them ends of near edges: how many links they have, all counted, how
    many of these lie within groups, and ties for the others."""
    some = nodes.select("node", "space", "group", "vector").orderBy(F.xxhash64("node", F.lit(3)))
    ends = lists.filter(F.col("near") >= least - 0.05).select(F.col("u").alias("node")).distinct()
    picked = {r["node"]: r for df in (some.join(ends, "node", "left_semi").orderBy(F.xxhash64("node", F.lit(5))), some) for r in df.limit(AUDIT // 2).collect()}
    ids, spaces, groups = (np.array([r[c] for r in picked.values()], dtype=np.int64) for c in ("node", "space", "group"))
    x = np.array([r["vector"] for r in picked.values()])

    def count(batches):
        import pyarrow as pa

        for batch in batches:
            if len(batch) and len(ids):
                node, group = batch.column("node").to_numpy(), batch.column("group").to_numpy()
                links = _links(x, matrix(batch.column("vector")), least)[1]
                links &= (spaces[:, None] == batch.column("space").to_numpy()) & (ids[:, None] != node)
                missed = links & (groups[:, None] != group)
                u, v = [], []
                for i in np.flatnonzero(missed.any(axis=1)):
                    at = np.flatnonzero(missed[i])
                    at = at[np.unique(group[at], return_index=True)[1]]  # one for each group
                    u.append(np.full(len(at), ids[i])), v.append(node[at])
                u, v = (np.concatenate([np.zeros(0, dtype=np.int64), *c]) for c in (u, v))
                sums = np.zeros((2, len(u) + 1), dtype=np.int64)
                sums[:, 0] = links.sum(), links.sum() - missed.sum()
                yield pa.RecordBatch.from_arrays(
                    [pa.array([None, *u.tolist()], pa.int64()), pa.array([None, *v.tolist()], pa.int64()), pa.array(sums[0]), pa.array(sums[1])], names=["u", "v", "n", "held"]
                )

    seen = materialize(nodes.select("node", "space", "group", "vector").mapInArrow(count, "u long, v long, n long, held long"), "audit")
    true, held = seen.agg(F.sum("n"), F.sum("held")).first()
    return true or 0, held or 0, seen.filter("u IS NOT NULL").select("u", "v")


def _whole(members: DataFrame, least: float, size: int, ties: bool = False) -> DataFrame:
    """Lists without an end, as sums: how many vectors (``links``) each node links with among those of its ``label``, all
    compared in pairs of blocks of ``size``. With ``ties`` also, in ``to``, the first node of a pair of blocks that it reaches."""
    sizes = members.groupBy("label").agg(F.ceil(F.count("*") / size).cast("int").alias("blocks"))
    placed = members.join(sizes, "label").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    dealt = placed.select("label", "node", "vector", "copies", "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    dealt = dealt.select(
        "label", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"), "node", "vector", "copies", "block"
    )

    def count(batch):
        ids, v, copies = batch.column("node").to_numpy(), matrix(batch.column("vector")), batch.column("copies").to_numpy()
        block, x, y = batch.column("block").to_numpy(), batch.column("x")[0].as_py(), batch.column("y")[0].as_py()
        own, other = np.flatnonzero(block == x), np.flatnonzero(block == y)
        links = _links(v[own], v[other], least)[1] & (ids[own][:, None] != ids[other][None, :])
        sums = np.zeros(len(ids), dtype=np.int64)
        sums[own] += links @ copies[other]
        if x != y:
            sums[other] += links.T @ copies[own]
        to = ids
        if ties and links.any():
            all_ = np.zeros((len(ids), len(ids)), dtype=bool)
            all_[np.ix_(own, other)] = links
            to = ids[_reached(all_ | all_.T)]
        return {"node": ids, "links": sums, "to": to}

    return map_groups(dealt, ["label", "x", "y"], ["node"], count, "node long, links long, to long")


def _summed(counted: DataFrame) -> DataFrame:
    return counted.groupBy("node").agg(F.sum("links").alias("links"))


def link_vectors(df: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", least: float = 0.98) -> DataFrame:
    """Link vectors of one label (not null) and one length whose cosine is ``least`` or more.

    One row for each row: ``key``, ``n_links`` (other rows linked), ``component_id`` (the smallest key reachable by
    links, the own included), ``kept`` (``key`` is that). Equal vectors stand as one with their number. Vectors
    that are null, empty, all zero, or hold a null or a value that is not finite link with nothing, as do
    rows without a label. Null keys count as rows and are nobody's smallest key. Jobs run when this is called.

    Lists of ``LIST`` neighbours are refined by joins of neighbours of neighbours until hardly any change. All links of
    what meets in a join tie groups together, whether a list has place for them or not. Then a pass with other planes
    begins, in which each node also has a list of its nearest outside its group, so a link that is left
    out of one group to another has a place however many are within; passes end when one ties nothing. Links are counted in whole
    components. An audit compares nodes with all rows and counts all their links: if it sees fewer than ``EVIDENCE``, or
    less than ``RECALL`` of them in one component, all vectors of each space are compared in pairs of blocks.
    """
    kind, number = dict(df.dtypes)[key], F.transform(F.col(vector), lambda x: x.cast("double"))
    rows = df.select(F.col(key).cast("long").alias("_id"), F.col(label).alias("_label"), number.alias("vector"))
    good = has_direction(F.col("vector")) & F.col("_label").isNotNull()
    rows = rows.withColumn("node", F.when(good, F.xxhash64("_label", "vector"))).withColumn("space", F.xxhash64("_label", F.size("vector")))
    nodes = rows.filter("node IS NOT NULL").groupBy("node").agg(
        F.first("space").alias("space"), F.first("vector").alias("vector"), F.count("*").alias("copies"), F.min("_id").alias("least")
    )
    nodes = _normed(nodes)
    spaces = nodes.groupBy(F.size("vector").alias("dim"), "space").count().groupBy("dim").agg(F.max("count").alias("most")).orderBy("dim").collect()
    labels = totals = None
    for dim, most in ((r["dim"], r["most"]) for r in spaces):
        own = nodes.filter(F.size("vector") == dim)
        labels_, totals_ = _descend(own, dim, most, least)
        labels, totals = (labels_, totals_) if labels is None else (labels.unionByName(labels_), totals.unionByName(totals_))
    if labels is None:
        out = rows.withColumn("links", F.lit(0)).withColumn("component", F.col("_id"))
    else:
        grouped = nodes.select("node", "copies", "least").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
        smallest = grouped.groupBy("label").agg(F.min("least").alias("component"))
        named = grouped.join(smallest, "label").join(totals, "node", "left")
        named = named.select("node", "component", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"))
        out = rows.join(named, "node", "left").withColumn("component", F.when(F.col("node").isNull(), F.col("_id")).otherwise(F.col("component")))
    return out.select(
        F.col("_id").cast(kind).alias(key),
        F.coalesce("links", F.lit(0)).cast("long").alias("n_links"),
        F.col("component").cast(kind).alias("component_id"),
        F.col("_id").eqNullSafe(F.col("component")).alias("kept"),
    )


def _normed(nodes: DataFrame) -> DataFrame:
    """Vectors as unit vectors."""

    def work(batches):
        import pyarrow as pa

        for batch in batches:
            vectors = [unit(np.array([v]))[0] for v in batch.column("vector").to_pylist()]
            yield batch.set_column(batch.schema.get_field_index("vector"), "vector", pa.array(vectors, pa.list_(pa.float64())))

    fields = ", ".join(f"{n} {t}" for n, t in nodes.dtypes)
    return materialize(nodes.mapInArrow(work, fields), "nodes")


def _grouped(nodes: DataFrame, labels: DataFrame) -> DataFrame:
    found = nodes.drop("group").join(labels, "node", "left").withColumn("group", F.coalesce("label", "node")).drop("label")
    return materialize(found, "groups")


def _pass(nodes: DataFrame, lists: DataFrame | None, dim: int, most: int, least: float, turn: int) -> tuple[DataFrame, DataFrame]:
    """Lists from tables of planes and from ``lists``, refined until hardly any change; and the ties of all that met."""
    met = materialize(_first_meetings(nodes, dim, most, least, turn), "met")
    found, ties = met.filter("NOT tie").drop("tie"), met.filter("tie").select("u", "v")
    if lists is not None:
        at_u, at_v = (nodes.select(F.col("node").alias(n), F.col("group").alias(f"{n}_group")) for n in "uv")
        again = lists.drop("inside").join(at_u, "u").join(at_v, "v").withColumn("inside", F.col("u_group") == F.col("v_group"))
        found = found.unionByName(again.select("u", "v", "near", F.lit(True).alias("new"), "inside"))
    lists = materialize(_lists(found), "lists")
    for _ in range(ROUNDS):
        met = materialize(_joined(lists, nodes, least), "met")
        ties = ties.unionByName(met.filter("tie").select("u", "v"))
        old = lists.withColumn("new", F.lit(False))
        lists = materialize(_lists(old.unionByName(met.filter("NOT tie").drop("tie"))), "lists")
        changed, total = lists.agg(F.sum(F.col("new").cast("long")), F.count("*")).first()
        if (changed or 0) <= 0.02 * (total or 0):
            break
    return lists, materialize(ties.distinct(), "ties")


def _descend(nodes: DataFrame, dim: int, most: int, least: float) -> tuple[DataFrame, DataFrame]:
    """Components of nodes of one length, as ``node`` and ``label``, and how many vectors each node links with."""
    nodes, lists, ties, labels, good = nodes.withColumn("group", F.col("node")), None, None, None, False
    for turn in range(PASSES):
        lists, new = _pass(nodes, lists, dim, most, least, turn)
        grown = not new.isEmpty()
        if grown:
            ties = new if ties is None else ties.unionByName(new)
            labels = components(ties.select(F.col("u").alias("a"), F.col("v").alias("b")))
            nodes = _grouped(nodes, labels)
        true, held, missed = _audit(nodes, lists, least)
        good = true >= EVIDENCE and held >= RECALL * true
        if held < true:
            ties = missed if ties is None else ties.unionByName(missed)
            labels = components(ties.select(F.col("u").alias("a"), F.col("v").alias("b")))
            nodes = _grouped(nodes, labels)
        if not grown and held == true:
            break
    if good:
        return labels, _summed(_whole(labels.join(nodes, "node"), least, MEMBERS))
    met = materialize(_whole(nodes.withColumn("label", F.col("space")), least, ALL, ties=True), "sums")
    return components(met.select(F.col("node").alias("a"), F.col("to").alias("b"))), _summed(met)
