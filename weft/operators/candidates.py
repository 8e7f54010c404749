"""Representations of chunks: small exact encoders propose candidates, and the cheapest that gives back the bytes is kept.

Chunks are deduplicated before any encoder runs. Each encoder is a short function of a chunk; proposals
are made and checked a few MB at a time in an Arrow-batched function, and scored and chosen in Catalyst.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, BooleanType, IntegerType, StringType, StructType

from weft.functions.bytes import arrangements, fits_128_bits, subset_rank, subset_unrank
from weft.functions.values import MAX_FANOUT, MAX_INLINE, MAX_PALETTE, MAX_PERIOD, dependent_reads, encoded_size, persisted_bytes, policies, read_cycles, reference_depth, total_cost, write_cycles
from weft.sources.shared import cut

#: Candidates in the order in which ties are broken.
ORDER = ("zero", "fill", "inline", "periodic", "sparse", "palette", "base_residual", "raw")
_PROPOSAL = StructType().add("family", StringType()).add("extra", IntegerType()).add("stored", IntegerType()).add("payload", BinaryType()).add("valid", BooleanType())
#: Bytes of chunks and payloads that a task gives out at once.
BLOCK = 4 << 20


def _period(x: np.ndarray) -> int | None:
    """The smallest period from 2 on, at most MAX_PERIOD and half the length."""
    n = len(x)
    for p in range(2, min(MAX_PERIOD, n // 2) + 1):
        if x[p] == x[0] and np.array_equal(x[p:], x[:-p]):
            return p
    return None


def propose(data: bytes, base: bytes | None) -> list[tuple[str, int, int, bytes]]:
    """(family, bytes the descriptor carries, bytes of stored objects, payload) of each encoder that accepts the chunk."""
    n, x = len(data), np.frombuffer(data, np.uint8)
    out = []
    kinds, counts = np.unique(x, return_counts=True)
    if n and not x.any():
        out.append(("zero", 0, 0, b""))
    if len(kinds) == 1:
        out.append(("fill", 0, 0, data[:1]))
    if 0 < n <= MAX_INLINE:
        out.append(("inline", n, 0, data))
    if n >= 4 and (p := _period(x)):
        tail = n % p
        out.append(("periodic", p + tail, 0, struct.pack("<I", p) + data[:p]))
    places = np.flatnonzero(x)
    k = len(places)
    if 0 < k <= n // 4 and k <= MAX_FANOUT and fits_128_bits(rank := subset_rank(places.tolist()) if k <= 64 else 1 << 128):
        out.append(("sparse", k, 0, struct.pack("<I", k) + rank.to_bytes(16, "little") + x[places].tobytes()))
    if 2 <= len(kinds) <= MAX_PALETTE and n <= 64 and fits_128_bits(arrangements(counts.tolist())):
        out.append(("palette", 5 * len(kinds), 0, struct.pack("<B", len(kinds)) + kinds.tobytes() + counts.astype("<u4").tobytes() + _multiset_rank(x.tolist()).to_bytes(16, "little")))
    if base is not None and len(base) == n:
        d = np.flatnonzero(x != np.frombuffer(base, np.uint8))
        if len(d) <= MAX_FANOUT:
            edits = b"".join(struct.pack("<IB", i, int(x[i]) ^ base[i]) for i in d.tolist())
            out.append(("base_residual", len(edits) + 5, 0, edits))
    out.append(("raw", 0, n, data))
    return out


def _multiset_rank(symbols: list[int]) -> int:
    """The place of the sequence among all arrangements of its symbols, in ascending order."""
    left = {s: symbols.count(s) for s in sorted(set(symbols))}
    rank = 0
    for s in symbols:
        for smaller in left:
            if smaller < s and left[smaller]:
                left[smaller] -= 1
                rank += arrangements(list(left.values()))
                left[smaller] += 1
        left[s] -= 1
    return rank


def _multiset_unrank(rank: int, symbols: list[int], counts: list[int]) -> bytes:
    left = dict(zip(symbols, counts, strict=True))
    out = []
    for _ in range(sum(counts)):
        for s in symbols:
            if left[s]:
                left[s] -= 1
                n = arrangements(list(left.values()))
                if rank < n:
                    out.append(s)
                    break
                rank -= n
                left[s] += 1
    return bytes(out)


def restore(family: str, n: int, payload: bytes, base: bytes | None) -> bytes:
    """The chunk's bytes."""
    if family == "zero":
        return bytes(n)
    if family == "fill":
        return payload * n
    if family in ("inline", "raw"):
        return payload
    if family == "periodic":
        (p,) = struct.unpack_from("<I", payload)
        return (payload[4:] * (n // p + 1))[:n]
    if family == "sparse":
        (k,) = struct.unpack_from("<I", payload)
        out = bytearray(n)
        for at, value in zip(subset_unrank(int.from_bytes(payload[4:20], "little"), k), payload[20:], strict=True):
            out[at] = value
        return bytes(out)
    if family == "palette":
        m = payload[0]
        return _multiset_unrank(int.from_bytes(payload[-16:], "little"), list(payload[1 : 1 + m]), np.frombuffer(payload, "<u4", m, 1 + m).tolist())
    if family == "base_residual":
        out = bytearray(base)
        for at, value in struct.iter_unpack("<IB", payload):
            out[at] ^= value
        return bytes(out)
    raise ValueError(family)


def _proposed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows (..., bytes, base) of each batch once for each proposal, with the proposal; about BLOCK bytes at a time."""
    for batch in batches:
        data, base = batch.column("bytes"), batch.column("base")
        at, found, size = [], [], 0
        for i in range(batch.num_rows):
            d, b = data[i].as_py(), base[i].as_py()
            for c in propose(d, b):
                at.append(i)
                found.append((*c, restore(c[0], len(d), c[3], b) == d))
                size += len(d) + len(c[3])
            if size >= BLOCK or i == batch.num_rows - 1:
                columns = zip(zip(*found, strict=True), (pa.string(), pa.int32(), pa.int32(), pa.binary(), pa.bool_()), strict=True)
                yield pa.RecordBatch.from_arrays([*batch.take(pa.array(at)).columns, *(pa.array(c, kind) for c, kind in columns)], names=[*batch.schema.names, *_PROPOSAL.names])
                at, found, size = [], [], 0


def candidates(chunks: DataFrame) -> DataFrame:
    """A row for each proposal for each chunk (key columns, bytes, base): family, costs, ordinal and valid.

    valid says that the proposal gives the chunk back byte for byte; it is checked where the proposal is made. The universal
    negative control, deterministic noise, is never a proposal: no chunk of real data equals it.
    """
    each = chunks.mapInArrow(_proposed, StructType([*chunks.schema.fields, *_PROPOSAL.fields]))
    n = F.octet_length("bytes").cast("long")
    place = F.array_position(F.array(*map(F.lit, ORDER)), F.col("family")).cast("int")
    return each.select(
        *chunks.columns,
        place.alias("ordinal"),
        "family",
        "payload",
        encoded_size(F.col("family"), F.col("extra")).alias("descriptor_bytes"),
        F.col("stored").cast("long").alias("payload_bytes"),
        read_cycles(F.col("family"), n).alias("read_cycles"),
        write_cycles(F.col("family"), n).alias("write_cycles"),
        dependent_reads(F.col("family")).alias("dependent_reads"),
        reference_depth(F.col("family")).alias("depth"),
        "valid",
    )


def with_costs(rows: DataFrame, mode: str = "balanced") -> DataFrame:
    """rows with persisted bytes and the policy's objective."""
    p = policies(rows.sparkSession).where(F.col("mode") == mode).drop("mode").first().asDict()
    costed = rows.withColumn("persisted", persisted_bytes(F.col("descriptor_bytes"), F.col("payload_bytes"))).withColumns({k: F.lit(v).cast("long") for k, v in p.items()})
    return costed.withColumn("objective", total_cost(F.col("persisted"), F.col("read_cycles"), F.col("write_cycles"), F.col("dependent_reads"), F.col("depth"))).drop(*p)


def cheapest(rows: DataFrame, keys: list[str], metric: str = "persisted") -> DataFrame:
    """Of each key's valid candidates the one of least metric, the first in order on ties."""
    rest = [c for c in rows.columns if c not in keys]
    best = rows.where("valid").groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(metric, "ordinal")).alias("w"))
    return best.select(*keys, *(F.col(f"w.{c}").alias(c) for c in rest))


def strictly_cheaper(new: DataFrame, incumbents: DataFrame, keys: list[str]) -> DataFrame:
    """Candidates that beat the incumbent of their key (persisted) and may replace just that one: with its descriptor, to be compared at commit."""
    old = incumbents.select(*keys, F.col("persisted").alias("old_persisted"), F.col("descriptor").alias("old_descriptor"))
    return new.join(old, keys).where("persisted < old_persisted")


def compare_and_swap(table: DataFrame, swaps: DataFrame, keys: list[str]) -> DataFrame:
    """table with descriptors replaced where they still are what the swap expects."""
    s = swaps.select(*keys, "old_descriptor", F.col("descriptor").alias("new_descriptor"))
    return table.join(s, keys, "left").withColumn("descriptor", F.when(F.col("descriptor") == F.col("old_descriptor"), F.col("new_descriptor")).otherwise(F.col("descriptor"))).drop("old_descriptor", "new_descriptor")


def marginal_bytes(rows: DataFrame, references: DataFrame, stored: DataFrame) -> DataFrame:
    """(cand, marginal): descriptor bytes and those of the candidate's objects (cand, obj, size) that aren't stored (obj) yet."""
    new = references.join(stored.select("obj").distinct(), "obj", "left_anti").groupBy("cand").agg(F.sum("size").alias("new_bytes"))
    return rows.join(new, "cand", "left").select("cand", (F.col("descriptor_bytes") + F.coalesce("new_bytes", F.lit(0))).alias("marginal"))


def plan_channels(trust: DataFrame, key: str, budget: Column) -> DataFrame:
    """Channels (key, ordinal, channel, trust) in descending trust, ties in order, up to the budget."""
    from pyspark.sql import Window as W

    place = F.row_number().over(W.partitionBy(key).orderBy(F.desc("trust"), "ordinal"))
    return trust.withColumn("place", place).where(F.col("place") <= budget)


def choose_anchors(savings: DataFrame, group: str, picks: int = 4, most: int = 12) -> DataFrame:
    """(group, pick, anchor, gain): greedy cover of each group's savings (anchor, member, saving) by a few anchors.

    Each group's ``most`` anchors of largest total saving compete; ties go to the smaller anchor. A round
    takes the anchor that adds most to the best saving of each member so far. Rounds are few and fixed,
    each a grouped sum over all groups at once, and each is written, so that none is computed again for the next.
    """
    from pyspark.sql import Window as W

    totals = savings.groupBy(group, "anchor").agg(F.sum("saving").alias("total"))
    rivals = totals.withColumn("r", F.row_number().over(W.partitionBy(group).orderBy(F.desc("total"), "anchor"))).where(F.col("r") <= most).select(group, "anchor")
    open_ = cut(savings.join(rivals, [group, "anchor"]).withColumn("had", F.lit(0).cast("long")))
    chosen = None
    for k in range(picks):
        gains = open_.groupBy(group, "anchor").agg(F.sum(F.greatest(F.col("saving") - F.col("had"), F.lit(0))).alias("gain"))
        best = cut(gains.where("gain > 0").groupBy(group).agg(F.max_by(F.struct("anchor", "gain"), F.struct("gain", (-F.col("anchor")).alias("low"))).alias("b")).select(group, F.lit(k + 1).alias("pick"), F.col("b.anchor").alias("anchor"), F.col("b.gain").cast("long").alias("gain")))
        chosen = best if chosen is None else chosen.union(best)
        if k == picks - 1:
            break
        taken = open_.join(best.select(group, "anchor"), [group, "anchor"]).select(group, "member", F.col("saving").alias("now"))
        open_ = cut(open_.join(taken, [group, "member"], "left").withColumn("had", F.greatest("had", F.coalesce("now", F.lit(0)))).drop("now"))
    return chosen

