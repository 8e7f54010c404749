"""Best-fit packing of documents into sequences, under several capacities at once.

Tokenised lengths, not tokens, are shuffled. Pieces are numbered in a checkpoint and dealt by a hash of
that number, which no two rows share, to groups of about GROUP pieces; each group is packed on its own,
and what its badly filled sequences hold is dealt anew to fewer groups. So each task sees a group of
about that size whatever the input holds, and the sequences that stay badly filled are those of the
last, small round.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import cut
from .tokens import encoder, text_groups

#: Pieces of a group, by round.
GROUP = (1024, 256, 256)
#: A sequence is good if its tokens fill this share, or if another capacity is used up to this share.
GOOD = 0.995
#: Production limits and weights: pieces of a sequence, and what tokens, pieces and attention weigh in the choice of a bin.
MAX_DOCS = 64
WEIGHTS = (1.0, 0.3, 0.3)
#: Bits of sequence_id that number a group's bins, and those that number the groups of a round.
BIN_BITS, GROUP_BITS = 20, 38


def tokenized_pieces(docs: DataFrame, tokenizer_path: str, end_id: int, capacity: int) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): each document's ids and end id, cut after every ``capacity`` ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            for at, texts in text_groups(batch.column(1).to_pylist()):
                rows, pieces, starts, lengths, sums = [], [], [], [], []
                for i, ids in enumerate(encoder(tokenizer_path).encode(texts)):
                    ids += end
                    for k, b in enumerate(range(0, len(ids), 4 * capacity)):
                        part = ids[b : b + 4 * capacity]
                        rows.append(at + i)
                        pieces.append(k)
                        starts.append(b // 4)
                        lengths.append(len(part) // 4)
                        sums.append(zlib.crc32(part))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(pieces, pa.int32()), pa.array(starts, pa.int64()), pa.array(lengths, pa.int64()), pa.array(sums, pa.int64())],
                    names=["doc_id", "piece", "start", "length", "ids_crc32"],
                )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def best_fit(items: np.ndarray, capacities: np.ndarray, weights: np.ndarray, choose: str) -> np.ndarray:
    """The bin of each item: vector best-fit, largest items first.

    items and capacities are amounts in each dimension. An item goes to the bin, of those that have room
    in every dimension, with the largest weighted dot product of the item and what is left there
    (choose "dot"), or with the smallest weighted norm of what then remains ("norm"); to a new bin
    if none has room. Amounts count as shares of the capacities; ties go to the oldest bin.
    An item beyond a capacity gets a bin of its own.
    """
    share = items / capacities
    order = np.lexsort((np.arange(len(items)), -(share * weights).sum(axis=1)))
    left = np.empty((len(items), items.shape[1]))
    bins = np.empty(len(items), np.int64)
    n = 0
    live = np.zeros(len(items), bool)
    smallest = items.min(axis=0) if len(items) else capacities
    for i in order:
        index = np.flatnonzero(live[:n])
        room = index[(left[index] >= items[i]).all(axis=1)]
        if len(room):
            rest = left[room] / capacities
            score = -(rest * share[i] * weights).sum(axis=1) if choose == "dot" else (((rest - share[i]) ** 2) * weights).sum(axis=1)
            b = room[np.argmin(score)]
        else:
            b, n = n, n + 1
            left[b] = capacities
        left[b] -= items[i]
        live[b] = bool((left[b] >= smallest).all())
        bins[i] = b
    return bins


def pack(pieces: DataFrame, max_tokens: int, max_docs: int | None = None, max_attention: int | None = None, weights: tuple[float, float, float] = WEIGHTS) -> DataFrame:
    """pieces with sequence_id and offset.

    A sequence holds at most max_tokens tokens, max_docs pieces (max_tokens by default) and an attention
    cost, the sum of the pieces' squared lengths, of max_attention (the square of max_tokens by default,
    which one whole piece uses up). weights say what a bin's residual tokens, pieces and attention count in
    its choice. If one choice of best_fit needs more sequences than the sums of a group do, the other
    is tried too, and the one with fewer sequences is taken. Rows are packed one by one: null and repeated doc_ids
    are dealt like any others. An empty table gives an empty result; the offsets of a sequence run from 0
    without gaps in the order doc_id (nulls last), piece.
    """
    capacities = np.array([max_tokens, max_docs or max_tokens, max_attention or max_tokens**2], float)
    weight = np.array(weights)
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values([*names, "__row"], kind="stable").reset_index(drop=True)
        n = rows["length"].to_numpy(float)
        items = np.stack([n, np.ones(len(n)), n * n], axis=1)
        fewest = np.ceil((items.sum(axis=0) / capacities).max())
        bins = best_fit(items, capacities, weight, "norm")
        if bins.max() + 1 > fewest:
            bins = min(bins, best_fit(items, capacities, weight, "dot"), key=lambda b: b.max())
        if bins.max() >> BIN_BITS or key[0] >> GROUP_BITS:
            raise ValueError("more sequences in a group, or groups, than sequence_id can number")
        used = np.stack([np.bincount(bins, items[:, d]) for d in range(3)], axis=1) / capacities
        rows["sequence_id"] = (np.int64(key[1]) << (BIN_BITS + GROUP_BITS)) + (np.int64(key[0]) << BIN_BITS) + bins
        rows["good"] = (used.max(axis=1) >= GOOD)[bins]
        rows = rows.sort_values("sequence_id", kind="stable")
        rows["offset"] = rows.groupby("sequence_id")["length"].cumsum() - rows["length"]
        return rows[[*names, "sequence_id", "offset", "good", "__row"]]

    out = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long, good boolean, __row long"
    done, rest = None, cut(pieces.select(*names)).withColumn("__row", F.monotonically_increasing_id())
    for k, size in enumerate(GROUP):
        groups = max(1, -(-rest.count() // size))
        dealt = rest.withColumn("__group", F.pmod(F.xxhash64("__row", F.lit(k)), F.lit(groups)))
        packed = cut(dealt.groupBy("__group", F.lit(k).alias("__round")).applyInPandas(run, out))
        last = k == len(GROUP) - 1 or groups == 1
        part = (packed if last else packed.where("good")).drop("good", "__row")
        done = part if done is None else done.union(part)
        if last:
            break
        rest = packed.where("not good").select(*names, "__row")
    return done


def pack_documents(docs: DataFrame, tokenizer_path: str, end_id: int = 0, max_tokens: int = 2048, max_docs: int = MAX_DOCS, **limits) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of every piece of every document.

    A document is its text's ids and the end id; null text counts as empty, so every document has a
    piece. Only documents of more than max_tokens ids are cut. Rows with a null or repeated doc_id are
    packed like any others. Other columns are not read.
    """
    return pack(tokenized_pieces(docs, tokenizer_path, end_id, max_tokens), max_tokens, max_docs, **limits)
