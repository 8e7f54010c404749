"""Exact top-k inner products by a dual-tree search of cover trees.

Equal vectors are merged first. Vectors go to the cell of their nearest pivot, cells are cut into blocks
of bounded size, and each block of candidates and each block of queries becomes a cover tree. A bounded
sample of the candidates gives every query a first bound on its kth score; against it query blocks drop
whole cells, and within the pairs of blocks that remain, pairs of tree nodes: no inner product of a
query within radius rq of q and a candidate within rc of c exceeds q.c + |q| rc + |c| rq + rq rc.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import cut

#: Vectors of a candidate block and of a query block, and points up to which a node isn't split.
BLOCK, QUERY_BLOCK, LEAF = 1024, 512, 32
#: Candidates drawn for first bounds (2 MB at 64 components), and cells at most.
SAMPLE, CELLS = 4096, 64


class CoverTree:
    """Points in node order. Node i holds points[start[i]:end[i]], all within radius[i] of center[i].

    A node's children are centres more than half its radius apart that cover its points within that half;
    its own centre is the first of them. Nodes of few points, or of points so far apart that most would be
    centres, stay leaves.
    """

    def __init__(self, points: np.ndarray, keys: list, leaf: int = LEAF):
        order = np.arange(len(points))
        x = points.astype(np.float64)
        start, end, center, radius, child, n_child = [], [], [], [], [], []

        def add(a: int, b: int, c: np.ndarray, r: float) -> int:
            for to, v in zip((start, end, center, radius, child, n_child), (a, b, c, r, 0, 0), strict=True):
                to.append(v)
            return len(start) - 1

        mean = x.mean(axis=0)
        root = x[np.argmin(((x - mean) ** 2).sum(axis=1))]
        todo = [add(0, len(x), root, float(np.sqrt(((x - root) ** 2).sum(axis=1).max())))]
        while todo:
            i = todo.pop()
            a, b = start[i], end[i]
            if b - a <= leaf or radius[i] == 0:
                continue
            groups = self._cover(x[order[a:b]], center[i], radius[i] / 2)
            if groups is None:
                continue
            near, owner = groups
            rows = order[a:b]
            child[i], n_child[i] = len(start), len(near)
            sizes = np.bincount(owner, minlength=len(near))
            order[a:b] = rows[np.argsort(owner, kind="stable")]
            for k, n in enumerate(sizes):
                own = x[order[a : a + n]]
                j = add(a, a + int(n), near[k], float(np.sqrt(((own - near[k]) ** 2).sum(axis=1).max())))
                todo.append(j)
                a += int(n)
        self.points, self.keys = points[order], [keys[i] for i in order]
        self.start, self.end, self.radius = np.array(start), np.array(end), np.array(radius)
        self.center = np.array(center).reshape(len(start), points.shape[1])
        self.child, self.n_child = np.array(child), np.array(n_child)
        self.norm = np.sqrt((self.center**2).sum(axis=1))

    @staticmethod
    def _cover(x: np.ndarray, center: np.ndarray, r: float) -> tuple[list, np.ndarray] | None:
        """Centres more than r apart, farthest first, and the number of each point's centre."""
        far = np.sqrt(((x - center) ** 2).sum(axis=1))
        centers, owner = [center], np.zeros(len(x), np.int64)
        while far.max() > r:
            if len(centers) > len(x) // 4:
                return None
            c = x[np.argmax(far)]
            d = np.sqrt(((x - c) ** 2).sum(axis=1))
            closer = d < far
            owner[closer], far[closer] = len(centers), d[closer]
            centers.append(c)
        return centers, owner

    def bounds(self, other: CoverTree, i: int, nodes: np.ndarray) -> np.ndarray:
        """The most that an inner product of a point of node i and one of other's nodes may be."""
        r, q = self.radius[i], self.norm[i]
        most = other.center[nodes] @ self.center[i] + q * other.radius[nodes] + other.norm[nodes] * r + r * other.radius[nodes]
        return most + 1e-9 * (1 + np.abs(most))


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer inner products: in doubles where every sum stays below 2**53, else in 64-bit integers."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    if most < 2**53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T


class DualSearch:
    """best holds each query's k highest scores so far; hits what may be among them: (query, candidate, score)."""

    def __init__(self, queries: CoverTree, candidates: CoverTree, floor: np.ndarray, k: int):
        self.q, self.c, self.k = queries, candidates, k
        self.best = np.full((len(queries.points), k), np.iinfo(np.int64).min, np.int64)
        self.best[:, 0] = floor  # best[:, 0] is the least: a score below it can't be among the k highest
        self.floor = floor
        self.hits: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self._visit(0, np.array([0]))

    def _kth(self, a: int, b: int) -> np.ndarray:
        return np.maximum(self.best[a:b].min(axis=1), self.floor[a:b])

    def _visit(self, i: int, nodes: np.ndarray) -> None:
        q, c = self.q, self.c
        a, b = q.start[i], q.end[i]
        while True:
            most = q.bounds(c, i, nodes)
            good = most >= self._kth(a, b).min()
            nodes, most = nodes[good], most[good]
            if not len(nodes):
                return
            inner = c.n_child[nodes] > 0
            if not inner.any():
                break
            nodes = np.concatenate([nodes[~inner], *(np.arange(c.child[n], c.child[n] + c.n_child[n]) for n in nodes[inner])])
        if q.n_child[i]:
            for j in range(q.child[i], q.child[i] + q.n_child[i]):
                self._visit(j, nodes)
            return
        nodes = nodes[np.argsort(-most, kind="stable")]
        at = 0
        while at < len(nodes):
            size = np.cumsum(c.end[nodes[at:]] - c.start[nodes[at:]])
            to = at + max(1, int(np.searchsorted(size, 512, "right")))
            some = nodes[at:to]
            some = some[q.bounds(c, i, some) >= self._kth(a, b).min()]
            if len(some):
                self._score(a, b, np.concatenate([np.arange(c.start[n], c.end[n]) for n in some]))
            at = to

    def _score(self, a: int, b: int, rows: np.ndarray) -> None:
        s = _products(self.q.points[a:b], self.c.points[rows])
        both = np.concatenate((np.where(self.best[a:b] > np.iinfo(np.int64).min, self.best[a:b], np.iinfo(np.int64).min), s), axis=1)
        self.best[a:b] = np.partition(both, both.shape[1] - self.k, axis=1)[:, -self.k :]
        i, j = np.nonzero(s >= self._kth(a, b)[:, None])
        self.hits.append((i + a, rows[j], s[i, j]))

    def found(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if not self.hits:
            z = np.zeros(0, np.int64)
            return z, z, z
        i, j, s = (np.concatenate(x) for x in zip(*self.hits, strict=True))
        good = s >= self._kth(0, len(self.best))[i]
        return i[good], j[good], s[good]


def merged(vectors: DataFrame, id_column: str, vector_column: str, scale: float, keep: int) -> DataFrame:
    """(vec, ids): each distinct integer vector, its 64-bit components as bytes, and its ``keep`` smallest distinct ids.

    Partitions merge what they hold before the exchange, and hot vectors are merged in two steps.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own: dict[bytes, list[int]] = {}
            for key, v in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if key is None or not v.is_valid or v.values.null_count:
                    continue
                x = np.floor(scale * v.values.to_numpy(zero_copy_only=False).astype(np.float64))
                if np.isfinite(x).all():
                    own.setdefault(x.astype("<i8").tobytes(), []).append(key)
            yield pa.RecordBatch.from_arrays([pa.array(list(own), pa.binary()), pa.array([sorted(set(i))[:keep] for i in own.values()], pa.list_(pa.int64()))], names=["vec", "ids"])

    def smallest(df: DataFrame, *by: str) -> DataFrame:
        return df.groupBy(*by).agg(F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))), 1, keep).alias("ids"))

    rows = vectors.select(F.col(id_column).cast("long"), F.col(vector_column).cast("array<double>")).mapInArrow(run, "vec binary, ids array<long>")
    rows = rows.withColumn("salt", F.pmod(F.xxhash64(F.col("ids")[0]), F.lit(64)))
    return smallest(smallest(rows, "vec", "salt"), "vec")


def _as_points(vecs: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(vecs), "<i8").reshape(len(vecs), -1) if vecs and vecs[0] else np.zeros((len(vecs), 0), np.int64)


def _dealt(vecs: DataFrame, pivots: list[bytes]) -> DataFrame:
    """vecs with the number of the nearest pivot of as many components, and the distance to it."""
    by_size: dict[int, list[int]] = {}
    for i, p in enumerate(pivots):
        by_size.setdefault(len(p), []).append(i)
    points = {n: _as_points([pivots[i] for i in at]).astype(np.float64) for n, at in by_size.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vec = batch.column(0).to_pylist()
            cell, far = np.zeros(len(vec), np.int32), np.zeros(len(vec))
            size = np.array([len(v) for v in vec])
            for n, at in by_size.items():
                rows = np.flatnonzero(size == n)
                for a in range(0, len(rows), 1000):
                    some = rows[a : a + 1000]
                    x = _as_points([vec[i] for i in some]).astype(np.float64)
                    d = np.stack([((x - p) ** 2).sum(axis=1) for p in points[n]], axis=1)
                    cell[some], far[some] = np.array(at)[d.argmin(axis=1)], np.sqrt(d.min(axis=1))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), pa.array(far)], names=[*batch.schema.names, "cell", "far"])

    kinds = ", ".join(f"{n} {t}" for n, t in vecs.dtypes)
    return vecs.mapInArrow(run, f"{kinds}, cell int, far double")


def _trees(dealt: DataFrame, counts: dict[int, int], size: int) -> DataFrame:
    """(cell, sub, tree) of each block: a cell's vectors dealt by a hash to blocks of about ``size``."""
    blocks = F.create_map(*(F.lit(int(x)) for c, n in counts.items() for x in (c, -(-n // size)))) if counts else F.create_map(F.lit(0), F.lit(1))

    def build(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("vec", kind="stable")
        tree = CoverTree(_as_points(rows["vec"].tolist()), [tuple(i) for i in rows["ids"]])
        return pd.DataFrame({"cell": [key[0]], "sub": [key[1]], "tree": [pickle.dumps(tree, 5)]})

    sub = F.pmod(F.xxhash64("vec", F.lit(9)), F.element_at(blocks, F.col("cell")).cast("long")).cast("int")
    return dealt.select("cell", sub.alias("sub"), "vec", "ids").groupBy("cell", "sub").applyInPandas(build, "cell int, sub int, tree binary")


def top_k(vectors: DataFrame, query_filter: str, k: int = 20, scale: float = 64.0, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k highest integer inner products with other rows, exactly.

    Components are floor(scale * x). Queries are the rows for which the SQL condition query_filter holds;
    candidates are all rows but the query's own. Ties go to the smaller id; a query with fewer candidates
    gets all. Null vectors and those that hold null or non-finite components take no part, nor do rows
    with a null id. Vectors of different lengths aren't compared. Rows that repeat an id are one query if
    their vectors are equal, and never each other's candidates. Other columns are not read.
    """
    spark = vectors.sparkSession
    known = cut(merged(vectors, id_column, vector_column, scale, k + 1))
    asked = cut(merged(vectors.where(query_filter), id_column, vector_column, scale, 1).select("vec", F.col("ids")[0].alias("rep")))
    n = known.count()
    draw = F.shiftrightunsigned(F.xxhash64("vec", F.lit(4)), 11) / F.lit(float(1 << 53))
    drawn = sorted(r[0] for r in known.where(draw < min(1.0, SAMPLE / max(1, n))).select("vec").collect())
    one_each = [r[0] for r in known.groupBy(F.length("vec")).agg(F.min("vec").alias("v")).select("v").collect()]  # a row for each length
    wanted = max(1, min(CELLS, -(-n // BLOCK)))
    pivots = list(dict.fromkeys([*one_each, *drawn[:: max(1, len(drawn) // wanted)][:wanted]]))

    dealt = cut(_dealt(known, pivots))
    cells = {r["cell"]: (r["n"], r["far"]) for r in dealt.groupBy("cell").agg(F.count("*").alias("n"), F.max("far").alias("far")).collect()}  # at most CELLS and a row for each length
    candidates = _trees(dealt, {c: v[0] for c, v in cells.items()}, BLOCK)
    q_dealt = cut(_dealt(asked.select("vec", F.array("rep").alias("ids")), pivots))
    q_counts = {r["cell"]: r["count"] for r in q_dealt.groupBy("cell").count().collect()}
    queries = _trees(q_dealt, q_counts, QUERY_BLOCK)
    seeds = spark.sparkContext.broadcast({m: _as_points([v for v in drawn if len(v) == m]) for m in {len(v) for v in drawn}})
    low = np.iinfo(np.int64).min

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each candidate block that a query block can't rule out, with the queries' first bounds."""
        for batch in batches:
            for raw in batch.column(2).to_pylist():
                tree = pickle.loads(raw)
                width = tree.points.shape[1]
                floor = np.full(len(tree.points), low)
                own = seeds.value.get(8 * width, np.zeros((0, width), np.int64))
                if len(own) > k:
                    floor = np.partition(_products(tree.points, own), len(own) - k - 1, axis=1)[:, -k - 1]
                payload = pickle.dumps((tree, floor), 5)
                cell, sub = [], []
                for c, (count, far) in cells.items():
                    if len(pivots[c]) != 8 * width:
                        continue
                    p = np.frombuffer(pivots[c], "<i8").astype(np.float64)
                    norm = float(np.sqrt((p**2).sum()))
                    most = float(tree.center[0] @ p) + tree.norm[0] * far + norm * tree.radius[0] + far * tree.radius[0]
                    if most + 1e-9 * (1 + abs(most)) >= floor.min():
                        blocks = -(-count // BLOCK)
                        cell += [c] * blocks
                        sub += range(blocks)
                for a in range(0, len(cell), 64):
                    m = len(cell[a : a + 64])
                    yield pa.RecordBatch.from_arrays([pa.array(cell[a : a + 64], pa.int32()), pa.array(sub[a : a + 64], pa.int32()), pa.array([payload] * m, pa.binary())], names=["cell", "sub", "asks"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell, sub = batch.column(0), batch.column(1)
            for r in range(batch.num_rows):
                asks, floor = pickle.loads(batch.column(2)[r].as_py())
                tree = pickle.loads(batch.column(3)[r].as_py())
                i, j, s = DualSearch(asks, tree, floor, k + 1).found()
                order = np.argsort(i, kind="stable")
                i, j, s = i[order], j[order], s[order]
                reps, tops = [], []
                for a, b in zip(*(x.tolist() for x in _runs(i)), strict=True):
                    reps.append(asks.keys[i[a]][0])
                    tops.append(sorted({(-int(v), y) for x, v in zip(j[a:b], s[a:b], strict=True) for y in tree.keys[x]})[: k + 1])
                pairs = pa.array([[{"less": v, "id": y} for v, y in t] for t in tops], pa.list_(pa.struct([("less", pa.int64()), ("id", pa.int64())])))
                yield pa.RecordBatch.from_arrays([pa.array(reps, pa.int64()), pa.array([cell[r].as_py()] * len(reps), pa.int32()), pa.array([sub[r].as_py() % 64] * len(reps), pa.int32()), pairs], names=["rep", "cell", "part", "top"])

    spread_rows = queries.mapInArrow(spread, "cell int, sub int, asks binary")
    found = spread_rows.join(candidates, ["cell", "sub"]).select("cell", "sub", "asks", "tree").mapInArrow(search, "rep long, cell int, part int, top array<struct<less: long, id: long>>")

    def best(df: DataFrame, *by: str) -> DataFrame:
        return df.groupBy(*by).agg(F.slice(F.array_sort(F.flatten(F.collect_list("top"))), 1, k + 1).alias("top"))

    tops = best(best(found, "rep", "cell", "part"), "rep")
    each = _query_rows(vectors.where(query_filter), id_column, vector_column, scale)
    named = each.join(asked, "vec").select("query_id", "rep").distinct().join(tops, "rep")
    own = F.slice(F.filter("top", lambda x: x["id"] != F.col("query_id")), 1, k)
    return named.select("query_id", F.posexplode(own).alias("at", "hit")).select("query_id", (F.col("at") + 1).alias("rank"), F.col("hit.id").alias("vec_id"), (-F.col("hit.less")).alias("score"))


def _runs(i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    cuts = np.flatnonzero(np.diff(i, prepend=-1))
    return cuts, np.append(cuts[1:], len(i))


def _query_rows(vectors: DataFrame, id_column: str, vector_column: str, scale: float) -> DataFrame:
    """(query_id, vec) of every row that takes part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, vecs = [], []
            for key, v in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if key is None or not v.is_valid or v.values.null_count:
                    continue
                x = np.floor(scale * v.values.to_numpy(zero_copy_only=False).astype(np.float64))
                if np.isfinite(x).all():
                    ids.append(key)
                    vecs.append(x.astype("<i8").tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(vecs, pa.binary())], names=["query_id", "vec"])

    return vectors.select(F.col(id_column).cast("long"), F.col(vector_column).cast("array<double>")).mapInArrow(run, "query_id long, vec binary")
