"""N-gram Jaccard join: MinHash bands find candidates, full shingle sets verify them.

Plan. (1) One pass makes each document's shingle set key and MinHash signature. (2) Documents of
equal sets form a class, led by the smallest doc_id; only leaders go on. (3) Leaders shuffle on band
hashes. (4) In a few rounds each leader is verified against one member of a band that isn't yet in its
component; the links so found give components, which settles most bands. (5) In bands that still hold
several components, all full sets are compared, block against block, and a link is kept for each two
components that a block links. (6) Components of all links. (7) For n_links, all members of each
component are compared, block against block, and each block gives its members' numbers of links.
No band and no component is emitted as all its pairs, or gathered whole in a task.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import blocks, components, cut, shingle_sets

#: Shingles of a comparison block (2 MB); a task holds two blocks at a time.
BLOCK_SHINGLES = 1 << 18
#: Rounds in which each leader is verified against one member of another component of its bands.
PROBES = 2
#: Sets that may be broadcast as hot ones (at most 160 kB of keys): those that more than 1 in HOT_SETS documents have.
HOT_SETS = 4096
#: Up to so many document ids (8 MB) are broadcast; more are joined by a shuffle.
BROADCAST_IDS = 1_000_000


def choose_bands(threshold: float, recall: float, most_hashes: int = 150) -> tuple[int, int]:
    """(bands, rows): the most rows a band, and so the fewest false candidates, that reach the recall at the threshold."""
    best = (1, 1)
    for rows in range(1, most_hashes + 1):
        p = threshold**rows
        bands = 1 if p >= 1 else max(1, math.ceil(math.log(1 - recall) / math.log1p(-p)))
        if bands * rows <= most_hashes:
            best = (bands, rows)
    return best


def _multipliers(n: int) -> np.ndarray:
    return np.random.default_rng(77).integers(1, 1 << 31, n, dtype=np.uint32) * np.uint32(2) + np.uint32(1)


def signature(shingles: np.ndarray, multipliers: np.ndarray) -> np.ndarray:
    """MinHash values: for each multiplier, the least product with the shingles' upper 32 bits."""
    h = (shingles >> np.uint64(32)).astype(np.uint32)
    low = np.full(len(multipliers), 0xFFFFFFFF, np.uint32)
    for a in range(0, len(h), 256):
        np.minimum(low, np.multiply.outer(h[a : a + 256], multipliers).min(axis=0), out=low)
    return low


def sketches(docs: DataFrame, k: int, bands: int, rows: int) -> DataFrame:
    """(doc_id, key, n, keys): the set's digest and size and the hashes of the signature's bands; null for texts without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mult = _multipliers(bands * rows)
        salt = (np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))[:, None]
        for batch in batches:
            ids = batch.column(0)
            for lo, hi, data, offsets in blocks(batch.column(1)):
                key, size, band = [], [], []
                for s in shingle_sets(data, offsets, k):
                    if not len(s):
                        key.append(None), size.append(None), band.append(None)
                        continue
                    m = signature(s, mult)
                    b = (m.reshape(bands, rows).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)) ^ salt
                    x = np.zeros(bands, np.uint64)
                    for j in range(rows):
                        x = (x ^ b[:, j]) * np.uint64(0xFF51AFD7ED558CCD)
                        x ^= x >> np.uint64(32)
                    key.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                    size.append(len(s))
                    band.append(x.view(np.int64))
                yield pa.RecordBatch.from_arrays([ids[lo:hi], pa.array(key, pa.binary()), pa.array(size, pa.int32()), pa.array(band, pa.list_(pa.int64()))], names=["doc_id", "key", "n", "keys"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, key binary, n int, keys array<long>")


def _sets(docs: DataFrame, k: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in blocks(batch.column(1)):
                yield pa.RecordBatch.from_arrays([batch.column(0)[lo:hi], pa.array([s.tobytes() for s in shingle_sets(data, offsets, k)], pa.binary())], names=["node", "shingles"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string")).mapInArrow(run, "node long, shingles binary")


def _verified(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """Those of the pairs (a, b) whose full shingle sets reach the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            for i, (x, y) in enumerate(zip(batch.column(2), batch.column(3), strict=True)):
                s, t = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                if min(len(s), len(t)) >= threshold * max(len(s), len(t)):
                    both = len(np.intersect1d(s, t, assume_unique=True))
                    keep[i] = both >= threshold * (len(s) + len(t) - both) - 1e-9
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep))

    a = sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa"))
    b = sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb"))
    return pairs.join(a, "a").join(b, "b").select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long")


def _similar(left: list[np.ndarray], right: list[np.ndarray], threshold: float) -> np.ndarray:
    """Which of left and right reach the threshold: exact intersections, as products of 0/1 matrices, some shingles at a time."""
    sizes = np.array([len(s) for s in left + right])
    owner = np.repeat(np.arange(len(sizes)), sizes)
    _, column, times = np.unique(np.concatenate(left + right), return_inverse=True, return_counts=True)
    shared = times[column] > 1
    owner, column = owner[shared], (np.cumsum(times > 1) - 1)[column[shared]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    both = np.zeros((len(left), len(right)), np.float32)
    width = 4096
    for c in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        x, y = np.searchsorted(column, (c, c + width))
        m = np.zeros((len(sizes), width), np.float32)
        m[owner[x:y], column[x:y] - c] = 1
        both += m[: len(left)] @ m[len(left) :].T
    return both >= threshold * (sizes[: len(left), None] + sizes[None, len(left) :] - both) - 1e-3


def _links_between(members: DataFrame, threshold: float) -> DataFrame:
    """Verified links (a, b) between members of different components, one at least for each two components that a (band, cell) group links.

    members: (band, cell, side, node, comp, shingles), clustered and sorted by (band, cell, side). A group
    is one block (side 0) or two blocks (0 against 1), each of about BLOCK_SHINGLES shingles.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, group = None, []

        def found() -> pa.RecordBatch | None:
            comp = np.array([g[2] for g in group])
            if not len(comp) or (comp == comp[0]).all():
                return None
            side = np.array([g[0] for g in group])
            node = np.array([g[1] for g in group])
            sets = [np.frombuffer(g[3], np.uint64) for g in group]
            left, right = np.flatnonzero(side == 0), np.flatnonzero(side == side.max())
            good = _similar([sets[i] for i in left], [sets[i] for i in right], threshold) & (comp[left][:, None] != comp[right][None, :])
            i, j = np.nonzero(good)
            if not len(i):
                return None
            x, y = comp[left[i]], comp[right[j]]
            _, one = np.unique(np.stack([np.minimum(x, y), np.maximum(x, y)]), axis=1, return_index=True)
            return pa.RecordBatch.from_arrays([pa.array(node[left[i[one]]]), pa.array(node[right[j[one]]])], names=["a", "b"])

        for batch in batches:
            band, cell, side, node, comp = (batch.column(i).to_pylist() for i in range(5))
            for i in range(batch.num_rows):
                if (band[i], cell[i]) != at:
                    if (r := found()) is not None:
                        yield r
                    at, group = (band[i], cell[i]), []
                group.append((side[i], node[i], comp[i], batch.column(5)[i].as_py()))
        if (r := found()) is not None:
            yield r

    return members.select("band", "cell", "side", "node", "comp", "shingles").mapInArrow(run, "a long, b long")


def _degrees(sets: list[list[np.ndarray]], threshold: float) -> list[np.ndarray]:
    """How many others each set reaches the threshold with: of one block among themselves, or of two across."""
    good = _similar(sets[0], sets[-1], threshold)
    if len(sets) == 1:
        np.fill_diagonal(good, False)
    return [good.sum(axis=1), good.sum(axis=0)][: len(sets)]


def _link_counts(label: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """(node, n_links): the members of the node's component that reach the threshold with it.

    label: (node, root). Both members of a component of two have one link. A component of one block is
    compared in one task; of a larger one each block is packed to a row, and each two blocks are compared.
    """
    sized = cut(label.join(sets.select("node", F.octet_length("shingles").alias("size")), "node"))
    whole = sized.groupBy("root").agg(F.count("*").alias("members"), F.ceil(F.sum("size") / F.lit(8.0 * BLOCK_SHINGLES)).alias("n"))
    placed = cut(sized.join(whole, "root").select("node", "root", "members", "n"))
    two = placed.where("members = 2").select("node", F.lit(1).cast("long").alias("n_links"))
    members = placed.where("members > 2").join(sets, "node")

    def within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, nodes, group = None, [], []

        def counted() -> pa.RecordBatch:
            n = _degrees([group], threshold)[0] if group else []
            return pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(n, pa.int64())], names=["node", "n_links"])

        for batch in batches:
            for root, node, shingles in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                if root != at:
                    yield counted()
                    at, nodes, group = root, [], []
                nodes.append(node)
                group.append(np.frombuffer(shingles.as_py(), np.uint64))
        yield counted()

    def pack(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        data = pa.compress(b"".join(rows["shingles"]), codec="zstd", asbytes=True)
        return pd.DataFrame({"root": [key[0]], "n": [key[1]], "chunk": [key[2]], "nodes": [rows["node"].tolist()], "sizes": [[len(x) // 8 for x in rows["shingles"]]], "data": [data]})

    def across(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        parts = []
        for sizes, data in zip(rows["sizes"], rows["data"], strict=True):
            flat = np.frombuffer(pa.decompress(data, int(sum(sizes)) * 8, codec="zstd", asbytes=True), np.uint64)
            parts.append(np.split(flat, np.cumsum(sizes)[:-1]))
        return pd.DataFrame({"node": np.concatenate([np.asarray(x) for x in rows["nodes"]]), "n_links": np.concatenate(_degrees(parts, threshold))})

    small = members.where("n = 1").select("root", "node", "shingles").repartition("root").sortWithinPartitions("root").mapInArrow(within, "node long, n_links long")
    chunk = F.pmod(F.xxhash64("node", F.lit(6)), F.col("n"))
    packed = cut(members.where("n > 1").select("root", "n", chunk.alias("chunk"), "node", "shingles").groupBy("root", "n", "chunk").applyInPandas(pack, "root long, n long, chunk long, nodes array<long>, sizes array<int>, data binary"))
    met = packed.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1))).select("root", F.least("chunk", "other").alias("x"), F.greatest("chunk", "other").alias("y"), "nodes", "sizes", "data")
    large = met.groupBy("root", "x", "y").applyInPandas(across, "node long, n_links long")
    return two.union(small).union(large).groupBy("node").agg(F.sum("n_links").alias("n_links"))


def join_near_duplicates(docs: DataFrame, k: int = 5, threshold: float = 0.8, recall: float = 0.999, count_links: bool = True) -> DataFrame:
    """One row per document: its near-duplicate class and the verified links of its text.

    Returns (doc_id, class_id, leader_id, n_copies, n_links). Two documents are linked if the Jaccard
    similarity of their sets of k-word shingles is at least the threshold; class_id is the smallest
    doc_id of the connected component. leader_id is the smallest doc_id with the same shingle set,
    n_copies the number of documents that have that set, and n_links the number of leaders of other sets
    that the leader is linked with, all members of a class being compared; null without count_links.
    No two documents that the bands bring together and that are similar end in different classes.

    A text of fewer than k words, but not none, is one shingle. Null and empty texts, and texts without
    words, are each a class of their own (n_copies 1, n_links 0). Rows that repeat a doc_id count as one
    document: they share their links, and each row is returned. A null doc_id is returned with null
    class_id. Other columns are not read. An empty table gives an empty result.
    """
    bands, rows = choose_bands(threshold, recall)
    every = cut(sketches(docs, k, bands, rows))
    good = every.where("doc_id is not null and key is not null")
    classes = cut(good.groupBy("key").agg(F.min("doc_id").alias("leader_id"), F.count("*").alias("n_copies")))
    # sets of so many documents that HOT_SETS at most are: their classes are broadcast, and no key of theirs is shuffled
    most = good.count() // HOT_SETS
    hot = F.broadcast(classes.where(F.col("n_copies") > most))
    rest = good.join(hot.select("key"), "key", "left_anti").join(classes, "key")
    whole = cut(good.join(hot, "key").union(rest).select("doc_id", "leader_id", "n_copies", "n", F.when(F.col("doc_id") == F.col("leader_id"), F.col("keys")).alias("keys")))
    leaders = whole.where("keys is not null")

    banded = leaders.select(F.col("doc_id").alias("node"), "n", F.explode("keys").alias("band"))
    shared = banded.groupBy("band").agg(F.min("node").alias("hub"), F.max("node").alias("top"), F.sum("n").alias("size")).where("hub < top")
    met = cut(banded.join(shared.select("band", "size"), "band").select("band", "node", "size"))

    wanted = cut(met.select("node").distinct())
    if wanted.count() <= BROADCAST_IDS:
        wanted = F.broadcast(wanted)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(wanted.withColumnRenamed("node", "doc_id"), "doc_id", "left_semi")
    sets = cut(_sets(texts, k))

    links, label = None, None
    marked = met.withColumn("comp", F.col("node"))
    for probe in range(PROBES):
        draw = F.col("node") if probe == 0 else F.xxhash64("node", F.lit(probe))
        tried = marked.groupBy("band").agg(F.min_by(F.struct("node", "comp"), draw).alias("p"), F.min("comp").alias("x"), F.max("comp").alias("y")).where("x < y").select("band", F.col("p.node").alias("b"), F.col("p.comp").alias("hub_comp"))
        pairs = marked.join(tried, "band").where("comp <> hub_comp").groupBy("node").agg(F.min_by("b", F.xxhash64("band")).alias("b")).withColumnRenamed("node", "a")
        more = cut(_verified(pairs, sets, threshold))
        links = more if links is None else links.union(more)
        label = components(links)
        marked = cut(met.join(label, "node", "left").select("band", "node", "size", F.coalesce("root", "node").alias("comp")))
    open_bands = marked.groupBy("band").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).where("x < y").select("band")
    n = F.ceil(F.col("size") / BLOCK_SHINGLES).cast("int")
    chunk = F.pmod(F.xxhash64("node", F.lit(5)), n.cast("long")).cast("int")
    parts = (
        marked.join(open_bands, "band")
        .withColumn("chunk", chunk)
        .withColumn("other", F.explode(F.sequence(F.lit(0), n - 1)))
        .select("band", "node", "comp", F.concat_ws("-", F.least("chunk", "other"), F.greatest("chunk", "other")).alias("cell"), (F.col("chunk") > F.col("other")).cast("int").alias("side"))
        .join(sets, "node")
    )
    second = _links_between(parts.repartition("band", "cell").sortWithinPartitions("band", "cell", "side"), threshold)
    links = links.union(second)
    links = cut(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    label = components(links)
    degree = _link_counts(label, sets, threshold) if count_links else label.select("node", F.lit(None).cast("long").alias("n_links"))
    of_leader = label.join(degree, "node", "left").withColumnRenamed("node", "leader_id")
    alone = every.where("doc_id is null or key is null").select("doc_id", F.col("doc_id").alias("class_id"), F.col("doc_id").alias("leader_id"), F.lit(1).cast("long").alias("n_copies"), F.lit(0).cast("long").alias("n_links"))
    copies = whole.select("doc_id", "leader_id", "n_copies")
    hot = F.broadcast(classes.where(F.col("n_copies") > most).select("leader_id"))
    linked = copies.join(hot, "leader_id", "left_semi").join(F.broadcast(of_leader.join(hot, "leader_id", "left_semi")), "leader_id", "left").union(copies.join(hot, "leader_id", "left_anti").join(of_leader, "leader_id", "left"))
    return (
        linked.select("doc_id", F.coalesce("root", "leader_id").alias("class_id"), "leader_id", "n_copies", (F.coalesce("n_links", F.lit(0).cast("long")) if count_links else F.col("n_links")).alias("n_links"))
        .union(alone)
    )


def keep_one_of_each(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs whose document is the smallest doc_id of its class; rows with null doc_id stay."""
    drop = join_near_duplicates(docs, count_links=False, **options).where("doc_id <> class_id").select("doc_id").distinct()
    return docs.join(drop, "doc_id", "left_anti").select(*docs.columns)
