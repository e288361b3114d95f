"""Near duplicates by circulant MinHash, banding, and comparison of whole sets.

Two permutations make all coordinates of a signature: the first scatters the shingles, the second,
shifted round by one more place for each coordinate, orders them. Documents with the same values in a
band are candidates. Equal sets stand as one. Candidates that hang together form a cluster; clusters are
compared whole, large ones in blocks and then across blocks, where whoever is not in the largest group asks.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casemill.llm.common import let_go, map_chunks, map_groups, materialize, store, text_bytes
from casemill.llm.graphs import components
from casemill.llm.repeats import LAST, numbered, packed, text_hash
from casemill.llm.windows import mix, word_symbols

#: Documents of one block, and their shingles; and how likely two linked ones may miss each other in all bands.
BLOCK, SHINGLES, MISS = 1000, 2_000_000, 1e-6
_U = np.uint64


def shingles(text: bytes, size: int) -> np.ndarray:
    """Sorted distinct hashes of the runs of ``size`` words in lower case (A to Z); of fewer words, of all of them."""
    words = word_symbols(text.lower())
    if not len(words):
        return words
    n = max(len(words) - size + 1, 1)
    acc = np.full(n, _U(min(len(words), size)))
    with np.errstate(over="ignore"):
        for k in range(min(size, len(words))):
            acc = mix(acc * _U(0x9E3779B97F4A7C15) + words[k : k + n])
    return np.unique(acc)


def banding(least: float, miss: float = MISS) -> tuple[int, int]:
    """Bands and rows of each: a pair of similarity ``least`` shares no band with probability ``miss`` at most."""
    rows = 5 if least >= 0.85 else 4
    return math.ceil(math.log(miss) / math.log(1 - least**rows)), rows


def _mix32(x):
    x = (x ^ (x >> np.uint32(16))) * np.uint32(0x7FEB352D)
    x = (x ^ (x >> np.uint32(15))) * np.uint32(0x846CA68B)
    return x ^ (x >> np.uint32(16))


def signatures(sets: list[np.ndarray], size: int) -> np.ndarray:
    """Circulant MinHash of non-empty sets: a row of ``size`` coordinates for each."""
    starts = np.cumsum([0] + [len(s) for s in sets[:-1]])
    scattered = (mix(np.concatenate(sets)) >> _U(32)).astype(np.uint32)
    out = np.empty((len(sets), size), dtype=np.uint32)
    for k in range(size):
        out[:, k] = np.minimum.reduceat(_mix32(scattered + np.uint32(k)), starts)
    return out


def keep_one(df: DataFrame, key: str = "doc_id", text: str = "text", size: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``df`` with one document of each group of near duplicates: the first in the order of keys. Of rows
    with one key and one text that has words, one stays. Documents without words stay, all of them."""
    best = near_duplicates(df, key, text, size, percent).filter("stands")
    order = F.coalesce(F.col(key).cast("long"), F.lit(LAST))
    best = best.select(order.alias("_order"), F.col("text_hash").alias("_hash")).distinct()
    rows = df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row"), order.alias("_order"), text_hash(F.col(text)).alias("_hash"))
    # Rows without words are nobody's duplicates, whatever key and text they share.
    words = F.coalesce(F.col(f"row.`{text}`").rlike(r"[^\t-\r ]"), F.lit(False))
    one = rows.filter(words).join(best, ["_order", "_hash"], "left_semi").dropDuplicates(["_order", "_hash"])
    return one.unionByName(rows.filter(~words)).select("row.*")


def _sketches(docs: DataFrame, size: int, bands: int, rows: int) -> DataFrame:
    docs = docs.withColumn("text_hash", text_hash(F.col("_text")))

    def make():
        def work(batch):
            sets = [shingles(t, size) for t in text_bytes(batch.column("_text"))]
            full = [i for i, s in enumerate(sets) if len(s)]
            prints, keys = np.zeros((len(sets), 2), dtype=np.int64), [[] for _ in sets]
            for part in (full[i : i + 64] for i in range(0, len(full), 64)):  # small enough for the caches
                signed = signatures([sets[i] for i in part], bands * rows).astype(np.uint64).reshape(len(part), bands, rows)
                acc = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), signed.shape[:2]).copy()
                for r in range(rows):
                    acc = mix(acc * _U(0x9E3779B97F4A7C15) + signed[:, :, r])
                for i, row in zip(part, acc.view(np.int64).tolist()):
                    keys[i] = row
                    prints[i] = [mix(sets[i]).sum().view(np.int64), mix(sets[i] ^ _U(0xD1B54A32D192ED03)).sum().view(np.int64)]
            return {
                "_key": batch.column("_key"),
                "_doc": batch.column("_doc"),
                "_copy": batch.column("_copy"),
                "n_shingles": [len(s) for s in sets],
                "p": prints[:, 0],
                "q": prints[:, 1],
                "bands": keys,
                "text_hash": batch.column("text_hash"),
            }

        return work

    kind = dict(docs.dtypes)["_key"]
    return map_chunks(docs, "_text", make, f"_key {kind}, _doc long, _copy int, n_shingles long, p long, q long, bands array<long>, text_hash long")


def linked(a: int, b: int, common, percent: int):
    """Is the intersection ``percent`` of the union, or more?"""
    return 100 * common >= percent * (a + b - common)


def group_sets(sets: list[np.ndarray], percent: int) -> list[int]:
    """For each set the first one that it reaches by links; all pairs count, but are not looked at once all hang together."""
    parent = list(range(len(sets)))

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    sizes = np.array([len(s) for s in sets])
    starts = np.cumsum(sizes) - sizes
    names = np.unique(np.concatenate(sets), return_inverse=True)[1]
    mark, left = np.zeros(int(names.max()) + 1, dtype=np.int32), len(sets)
    for i in range(len(sets) - 1):
        if left == 1:
            break
        own = names[starts[i] : starts[i] + sizes[i]]
        mark[own] = 1
        common = np.add.reduceat(mark[names[starts[i + 1] :]], starts[i + 1 :] - starts[i + 1])
        mark[own] = 0
        for j in (np.flatnonzero(linked(sizes[i], sizes[i + 1 :], common, percent)) + i + 1).tolist():
            a, b = sorted((root(i), root(j)))
            if a != b:
                parent[b], left = a, left - 1
    return [root(i) for i in range(len(sets))]


def _blocks(most_shingles: int | None = None):
    """Blocks for the documents of a group: so many that each holds few documents and few shingles, or one long document."""
    shingles_each = SHINGLES if most_shingles is None else most_shingles
    return F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("n_shingles") / shingles_each))


def _in_blocks(members: DataFrame, size: int, percent: int) -> DataFrame:
    """Links ``a``, ``b`` within blocks of (``cluster``, ``block``, ``node``, ``_data``): from each node to the first it reaches."""

    def run(batches):
        let_go()
        unpress = zstandard.ZstdDecompressor()
        at, nodes, sets = None, [], []

        def flush():
            if len(nodes) > 1:
                heads = group_sets(sets, percent)
                pairs = [(nodes[h], n) for h, n in zip(heads, nodes) if nodes[h] != n]
                a, b = zip(*pairs) if pairs else ((), ())
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

        for batch in batches:
            for cluster, block, node, data in zip(*(batch.column(n).to_pylist() for n in ("cluster", "block", "node", "_data"))):
                if (cluster, block) != at:
                    yield from flush()
                    at, nodes, sets = (cluster, block), [], []
                nodes.append(node)
                sets.append(shingles(unpress.decompress(data), size))
        yield from flush()

    dealt = members.repartition("cluster", "block").sortWithinPartitions("cluster", "block", "node")
    return dealt.mapInArrow(run, "a long, b long")


def _against(dealt: DataFrame, size: int, percent: int) -> DataFrame:
    """Links between the queries and the other members of (``cluster``, ``block``, ``pack``): of each query to one member
    of each group that it links with."""

    def compare(batch):
        unpress = zstandard.ZstdDecompressor()
        asks, nodes, groups = (batch.column(n).to_pylist() for n in ("asks", "node", "group"))
        sets = [shingles(unpress.decompress(d), size) for d in batch.column("_data").to_pylist()]
        rows, queries = [i for i, x in enumerate(asks) if not x], [i for i, x in enumerate(asks) if x]
        if not rows or not queries:
            return None
        sizes = np.array([len(sets[i]) for i in rows])
        starts = np.cumsum(sizes) - sizes
        stream = np.concatenate([sets[i] for i in rows])
        known, names = np.unique(stream, return_inverse=True)
        mark, out = np.zeros(len(known), dtype=np.int32), ([], [])
        for q in queries:
            at = np.searchsorted(known, sets[q])
            at[at == len(known)] = 0
            at = at[known[at] == sets[q]]
            mark[at] = 1
            common = np.add.reduceat(mark[names], starts)
            mark[at] = 0
            met = {groups[q]}
            for j in np.flatnonzero(linked(len(sets[q]), sizes, common, percent)).tolist():
                if groups[rows[j]] not in met:
                    met.add(groups[rows[j]])
                    out[0].append(nodes[q])
                    out[1].append(nodes[rows[j]])
        return {"a": out[0], "b": out[1]}

    return map_groups(dealt, ["cluster", "block", "pack"], ["asks", "node"], compare, "a long, b long")


def _across(texts: DataFrame, links: DataFrame, size: int, percent: int) -> DataFrame:
    """Links of large clusters with those that lie across blocks.

    First one member of each group that hangs together, and has others, asks all blocks of its
    cluster; so what the blocks have cut apart grows together. Then every document that is still outside its
    cluster's largest group asks them. A pair of a bucket whose ends do not hang together by then has one
    that asks, and is compared; no pair is a row.
    """
    for leaders in (True, False):
        labels = components(links)
        members = texts.join(labels, "node", "left").withColumn("group", F.coalesce("label", "node")).drop("label")
        sizes = materialize(members.groupBy("cluster", "group").agg(F.count("*").alias("n"), F.min("node").alias("leader")), "groups")
        if leaders:
            asking = sizes.filter("n > 1").select(F.col("leader").alias("node"))
        else:
            largest = sizes.groupBy("cluster").agg(F.max(F.struct("n", "group")).alias("most")).select("cluster", F.col("most.group").alias("largest"))
            asking = members.join(largest, "cluster").filter("group <> largest").select("node")
        blocks = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)).alias("block")
        queries = members.join(asking, "node", "left_semi").select("node", "cluster", "group", "n_shingles", "_data", blocks)
        packs = queries.groupBy("cluster", "block").agg(_blocks().cast("int").alias("packs"))
        pack = F.pmod(F.xxhash64("node"), F.col("packs")).cast("int").alias("pack")
        every = F.explode(F.sequence(F.lit(0), F.col("packs") - 1)).alias("pack")
        asks = queries.join(packs, ["cluster", "block"]).select("cluster", "block", pack, F.lit(True).alias("asks"), "node", "group", "_data")
        rows = members.join(packs, ["cluster", "block"]).select("cluster", "block", every, F.lit(False).alias("asks"), "node", "group", "_data")
        links = materialize(links.unionByName(_against(rows.unionByName(asks), size, percent)), "links")
    return links


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", size: int = 5, percent: int = 80) -> DataFrame:
    """Group documents by links: their sets of shingles of ``size`` words share ``percent`` of their union or more.

    One row for each row: ``key``, ``n_shingles``, ``component_id`` (the smallest key reachable by links, the own
    included), ``kept`` (``key`` is that), ``stands`` (it is the group's first document; of one key, that with the
    smallest hash) and ``text_hash``. Words are runs of bytes other than 9 to 13 and 32, A to Z in
    lower case. Fewer words than ``size`` are one shingle. A null or empty text, or one without words, has an empty
    set and links with nothing. A null key counts as the largest; repeated keys are documents each, with
    one component. Links are confirmed on whole sets; the bands miss a pair at the limit with probability
    ``MISS``. Jobs run when this is called.
    """
    bands, rows = banding(percent / 100)
    docs = numbered(df, key, text)
    sketches = store(_sketches(docs, size, bands, rows), "sketches").withColumn(
        "_node", F.when(F.col("_copy") == 0, F.col("_doc")).otherwise(F.xxhash64("_doc", "_copy"))
    )
    full = sketches.filter("n_shingles > 0")
    # Equal sets stand as one: their first document.
    reps = full.groupBy("p", "q", "n_shingles").agg(F.min(F.struct("_doc", "_copy", "_node", "bands")).alias("first"))
    reps = materialize(reps.select("p", "q", "n_shingles", "first._doc", "first._copy", F.col("first._node").alias("node"), "first.bands"), "sets")
    keyed = reps.select("node", F.explode("bands").alias("band"))
    hubs = keyed.groupBy("band").agg(F.min("node").alias("hub"), F.count("*").alias("n")).filter("n > 1").select("band", "hub")
    near = keyed.join(hubs, "band").filter("node <> hub")
    clusters = components(near.select(F.col("hub").alias("a"), F.col("node").alias("b"))).withColumnRenamed("label", "cluster")
    clusters = clusters.join(reps.select("node", "n_shingles"), "node")
    counts = clusters.groupBy("cluster").agg(_blocks().alias("blocks"))
    placed = materialize(clusters.join(counts, "cluster").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks"))), "clusters")
    texts = packed(docs.select("_doc", "_copy", "_text")).join(
        placed.join(reps.select("node", "_doc", "_copy"), "node"), ["_doc", "_copy"]
    )
    texts = store(texts.dropDuplicates(["node"]).select("node", "cluster", "block", "blocks", "n_shingles", "_data"), "members")
    links = materialize(_in_blocks(texts, size, percent), "links")
    large = texts.filter("blocks > 1")
    if not large.isEmpty():
        links = _across(large, links, size, percent)
    labels = components(links)
    grouped = reps.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    smallest = grouped.groupBy("label").agg(F.min(F.struct("_doc", "_copy")).alias("head"))
    named = grouped.join(smallest, "label").select("p", "q", "n_shingles", "head")
    out = sketches.join(named, ["p", "q", "n_shingles"], "left").withColumn("component", F.coalesce("head._doc", "_doc"))
    first = F.col("head").isNull() | ((F.col("_doc") == F.col("head._doc")) & (F.col("_copy") == F.col("head._copy")))
    kind = dict(df.dtypes)[key]
    component = F.when(F.col("component") != LAST, F.col("component")).cast(kind)
    return out.select(
        F.col("_key").alias(key), "n_shingles", component.alias("component_id"), (F.col("_doc") == F.col("component")).alias("kept"), first.alias("stands"), "text_hash"
    )
