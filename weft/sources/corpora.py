"""Deterministic corpora and noise, generated in the tasks that use them."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

CHUNK = 65536


def splitmix64(seed: int, first: int, n: int) -> np.ndarray:
    """Values first, first + 1, ... of the generator with this seed: each follows from its place alone."""
    s = np.uint64(seed) + (np.arange(first + 1, first + n + 1, dtype=np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
    s = (s ^ (s >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    s = (s ^ (s >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return s ^ (s >> np.uint64(31))


def _structured(k: int) -> bytes:
    """Chunk k: a MiB of the alphabet, one of zeros, one of seven symbols, one of a multiplicative hash, and again."""
    i = np.arange(CHUNK, dtype=np.uint32)
    zone = k * CHUNK // (1 << 20) % 4
    return (97 + i % 26, 0 * i, i % 7, (i * np.uint32(2654435761)) >> np.uint32(8))[zone].astype(np.uint8).tobytes()


def _versioned(version: int, j: int, base: bytes) -> bytes:
    """Chunk j of a version: (4 + 12 v)(1 + j mod 3) bytes of the original changed, at places that follow from v and j."""
    if not version:
        return base
    x = np.frombuffer(base, np.uint8).copy()
    r = splitmix64(version * 1_000_003 + j, 0, (4 + 12 * version) * (1 + j % 3))
    x[(r % np.uint64(CHUNK)).astype(np.int64)] ^= ((r >> np.uint64(32)) % np.uint64(255) + np.uint64(1)).astype(np.uint8)
    return x.tobytes()


def _chunk(kind: str, version: int, idx: int, chunks: int, seed: int) -> bytes:
    if kind == "structured":
        return _structured(idx)
    noise = lambda j: splitmix64(seed, j * (CHUNK // 8), CHUNK // 8).astype("<u8").tobytes()
    if kind == "urandom":
        return noise(idx)
    source = idx if kind == "versioned" else idx * pow(3 + 2 * min(version, 15), -1, chunks) % chunks
    return _versioned(version, source, noise(source))


def corpus(spark: SparkSession, kind: str, mib: int, versions: int = 1, seed: int = 42) -> DataFrame:
    """(version, idx, off, bytes) of the corpora structured, urandom, versioned and shuffled, in chunks of 64 KiB.

    versioned changes more of the original's bytes from version to version; shuffled moves version v's
    chunk j to j times an odd stride, so that history at a place is of no use.
    """
    chunks = mib * (1 << 20) // CHUNK

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for a in range(0, len(pdf), 64):
                some = pdf[a : a + 64]
                yield pd.DataFrame({"version": some["version"], "idx": some["idx"], "off": some["idx"] * CHUNK, "bytes": [_chunk(kind, int(v), int(i), chunks, seed) for v, i in zip(some["version"], some["idx"], strict=True)]})

    n = chunks * versions
    rows = spark.range(0, n, 1, max(1, min(n, 64))).select((F.col("id") / chunks).cast("long").alias("version"), (F.col("id") % chunks).alias("idx"))
    return rows.mapInPandas(run, "version long, idx long, off long, bytes binary")


def noise_range(seed: int, coordinate: int, offset: int, length: int) -> bytes:
    """A range of the stream of (seed, coordinate): SHA-256 of both and the block's number, 32 bytes a block, from any place."""
    first = offset // 32
    blocks = range(first, -(-(offset + length) // 32))
    data = b"".join(hashlib.sha256(f"{seed}:{coordinate}:{b}".encode()).digest() for b in blocks)
    return data[offset - 32 * first : offset - 32 * first + length]


@F.pandas_udf(BinaryType())
def noise(seed: pd.Series, coordinate: pd.Series, offset: pd.Series, length: pd.Series) -> pd.Series:
    return pd.Series([noise_range(*map(int, x)) for x in zip(seed, coordinate, offset, length, strict=True)])
