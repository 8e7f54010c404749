"""Functions of byte strings that Catalyst has no loop for, as Arrow-batched UDFs over numpy."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StringType, StructType


def _counts(data: bytes | None) -> np.ndarray:
    return np.bincount(np.frombuffer(data or b"", np.uint8), minlength=256)


def entropy_of(counts: np.ndarray) -> float:
    p = counts[counts > 0] / max(1, counts.sum())
    return float(-(p * np.log2(p)).sum()) if len(p) else 0.0


@F.pandas_udf(ArrayType(IntegerType()))
def byte_histogram(data: pd.Series) -> pd.Series:
    return data.map(lambda d: _counts(d).astype(np.int32))


@F.pandas_udf(DoubleType())
def byte_entropy(data: pd.Series) -> pd.Series:
    """Bits a byte; 0 for no bytes."""
    return data.map(lambda d: entropy_of(_counts(d)))


@F.pandas_udf(IntegerType())
def distinct_bytes(data: pd.Series) -> pd.Series:
    return data.map(lambda d: int((_counts(d) > 0).sum())).astype("int32")


def sampled_entropy(probe: int = 4096):
    """The least entropy of three samples of up to ``probe`` bytes, taken at strides that differ by one; 0 for no bytes."""

    def one(d: bytes | None) -> float:
        if not d:
            return 0.0
        x = np.frombuffer(d, np.uint8)
        n = min(probe, len(x))
        step = max(1, len(x) // n)
        return min(entropy_of(np.bincount(x[:: step + k][:n], minlength=256)) for k in range(3))

    @F.pandas_udf(DoubleType())
    def udf(data: pd.Series) -> pd.Series:
        return data.map(one)

    return udf


@F.pandas_udf(StructType().add("positions", IntegerType()).add("runs", IntegerType()).add("hist_change", DoubleType()))
def difference(a: pd.Series, b: pd.Series) -> pd.DataFrame:
    """Positions and runs in which two equally long strings differ, and half their histograms' L1 distance a byte; else null counts and 1."""
    rows = []
    for x, y in zip(a, b, strict=True):
        if x is None or y is None or len(x) != len(y):
            rows.append((None, None, 1.0))
            continue
        u, v = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
        d = u != v
        change = np.abs(_counts(x) - _counts(y)).sum() / (2 * len(x)) if len(x) else 0.0
        rows.append((int(d.sum()), int((np.diff(d.astype(np.int8), prepend=0) == 1).sum()), float(change)))
    return pd.DataFrame(rows, columns=["positions", "runs", "hist_change"]).astype({"positions": "Int32", "runs": "Int32"})


@F.pandas_udf(StructType().add("printable", IntegerType()).add("distinct", IntegerType()))
def byte_sketch(data: pd.Series) -> pd.DataFrame:
    """Of the first 4096 bytes: the share of printable ones and of distinct values, each from 0 to 20."""
    rows = []
    for d in data:
        x = np.frombuffer((d or b"")[:4096], np.uint8)
        x = x[:: max(1, len(x) // 2048)]
        ok = ((x >= 32) & (x < 127)) | np.isin(x, (9, 10, 13))
        rows.append((int(20 * ok.mean()) if len(x) else 0, int(len(np.unique(x)) / 256 * 20)))
    return pd.DataFrame(rows, columns=["printable", "distinct"]).astype("int32")


def _crc32c_table() -> list[int]:
    table = []
    for i in range(256):
        for _ in range(8):
            i = (i >> 1) ^ (0x82F63B78 if i & 1 else 0)  # the reversed Castagnoli polynomial
        table.append(i)
    return table


_TABLE = _crc32c_table()


def crc32c_of(data: bytes, start: int = 0) -> int:
    c = start ^ 0xFFFFFFFF
    for b in data:
        c = (c >> 8) ^ _TABLE[(c ^ b) & 255]
    return c ^ 0xFFFFFFFF


@F.pandas_udf(LongType())
def crc32c(data: pd.Series) -> pd.Series:
    return data.map(lambda d: None if d is None else crc32c_of(d)).astype("Int64")


@F.pandas_udf(StringType())
def fnv1a_hex(data: pd.Series) -> pd.Series:
    """64-bit FNV-1a."""

    def one(d: bytes | None) -> str | None:
        if d is None:
            return None
        h = 0xCBF29CE484222325
        for b in d:
            h = (h ^ b) * 0x100000001B3 % (1 << 64)
        return f"{h:016x}"

    return data.map(one)


def subset_rank(positions: list[int]) -> int:
    """The rank of ascending positions among all sets of as many, in colexicographic order."""
    return sum(math.comb(p, i + 1) for i, p in enumerate(positions))


def subset_unrank(rank: int, k: int) -> list[int]:
    out = []
    for i in range(k, 0, -1):
        p = i - 1
        step = 1
        while math.comb(p + step, i) <= rank:
            p, step = p + step, step * 2
        while step:
            if math.comb(p + step, i) <= rank:
                p += step
            step //= 2
        out.append(p)
        rank -= math.comb(p, i)
    return out[::-1]


def arrangements(counts: list[int]) -> int:
    """How many strings have these numbers of each symbol."""
    n, out = 0, 1
    for c in counts:
        n += c
        out *= math.comb(n, c)
    return out


def fits_128_bits(n: int) -> bool:
    return 0 <= n < 1 << 128
