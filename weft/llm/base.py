"""Helpers that the operators share: byte views of Arrow text, word hashes, checkpoints, components.

Text is read in blocks of about ``BLOCK`` bytes straight from Arrow's buffers, so that a task's
memory depends on the block (or on one longest text), never on the partition.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from weft.sources.shared import cut, fresh_dir  # noqa: F401

#: Fixed value: a word is a run of characters outside these ASCII ranges, after lower-casing A-Z.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BLOCK = 1 << 20

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_IN_WORD = np.zeros(256, dtype=bool)
_IN_WORD[48:58] = _IN_WORD[97:123] = _IN_WORD[128:] = True

_BASE = 0x9E3779B97F4A7C15
_UNBASE = pow(_BASE, -1, 1 << 64)
_BYTE_VALUE = np.random.default_rng(20240501).integers(1, 1 << 63, 256, dtype=np.uint64)
_powers: list[np.ndarray] = []


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(n, BLOCK + 1)
        tables = []
        for base in (_BASE, _UNBASE):
            t = np.full(size, base, dtype=np.uint64)
            t[0] = 1
            tables.append(np.multiply.accumulate(t))
        _powers[:] = tables
    return _powers[0], _powers[1]


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string or binary column and the offsets of its rows; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, at, data = column.buffers()
    offsets = np.frombuffer(at, np.int64 if wide else np.int32, len(column) + 1, column.offset * (8 if wide else 4)).astype(np.int64) if at else np.zeros(1, np.int64)
    return (np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)), offsets


def blocks(column: pa.Array, size: int = BLOCK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets from 0) of consecutive rows of about size bytes."""
    data, offsets = utf8(column)
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + size, "right")) - 1)
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


class Words:
    """The words of a block: row, start and end byte, and a 64-bit hash of each lower-cased word."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        folded = _FOLD[data]
        inside = _IN_WORD[folded]
        n = len(data)
        before, after = np.zeros(n, bool), np.zeros(n, bool)
        before[1:], after[:-1] = inside[:-1], inside[1:]
        edges = offsets[(offsets > 0) & (offsets < n)]
        before[edges] = False
        after[edges - 1] = False
        self.start = np.flatnonzero(inside & ~before)
        self.end = np.flatnonzero(inside & ~after) + 1
        self.row = np.searchsorted(offsets, self.start, "right") - 1
        up, down = power_tables(n + 1)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTE_VALUE[folded] * up[:n], out=sums[1:])
        self.hash = mix((sums[self.end] - sums[self.start]) * down[self.start])
        self.rows = len(offsets) - 1
        self.count = np.bincount(self.row, minlength=self.rows)
        self.first = np.concatenate(([0], np.cumsum(self.count)))


_STEP = [pow(0xD6E8FEB86659FD93, k, 1 << 64) for k in range(64)]


def window_hashes(w: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of every k consecutive words of a row; a row of fewer words, but not none, is one window."""
    n = len(w.hash)
    rows, hashes = [], []
    if n >= k:
        h = np.zeros(n - k + 1, np.uint64)
        for j in range(k):
            h += w.hash[j : n - k + 1 + j] * np.uint64(_STEP[j])
        whole = w.row[: n - k + 1] == w.row[k - 1 :]
        rows.append(w.row[: n - k + 1][whole])
        hashes.append(mix(h[whole]))
    short = np.flatnonzero((w.count > 0) & (w.count < k))
    if len(short):
        h = np.zeros(len(short), np.uint64)
        for j in range(k - 1):
            has = w.count[short] > j
            h[has] += w.hash[w.first[short[has]] + j] * np.uint64(_STEP[j])
        rows.append(short)
        hashes.append(mix(h + w.count[short].astype(np.uint64) * np.uint64(_STEP[40])))
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    row, h = np.concatenate(rows), np.concatenate(hashes)
    order = np.argsort(row, kind="stable")
    return row[order], h[order]


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int = 5) -> list[np.ndarray]:
    """The sorted distinct k-word shingle hashes of each row of a block."""
    row, h = window_hashes(Words(data, offsets), k)
    cuts = np.searchsorted(row, np.arange(len(offsets)))
    return [np.unique(h[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def with_fields(df: DataFrame, added: str) -> StructType:
    """df's schema with the fields of a DDL string added."""
    return StructType([*df.schema.fields, *StructType.fromDDL(added).fields])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _digest(edges: DataFrame) -> tuple:
    r = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return r[0], r[1]


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root) of every node of the undirected edges (a, b); root is the component's smallest node.

    Alternating large-star and small-star rounds (Kiveris et al., 2014): every round is two grouped
    minima and two joins, whose hot keys are pre-aggregated or split; nothing comes to the driver but
    a row count and a checksum.
    """
    e = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    was = _digest(e)
    for _ in range(most_rounds if was[0] else 0):
        both = e.union(e.select("b", "a"))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").union(low.select("a", F.col("m").alias("b")))
        e = cut(small.distinct())
        now = _digest(e)
        if now == was:
            break
        was = now
    else:
        if was[0]:
            raise RuntimeError("components did not settle")
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).union(e.select("b", "b").distinct())
