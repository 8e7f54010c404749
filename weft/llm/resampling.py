"""Quality by importance resampling: hashed n-gram models of target and raw text, sampled by Gumbel top-k.

A text's weight is the log ratio of its probability under two bag-of-n-grams models over hashed word
unigrams and bigrams, as of a text of LENGTH n-grams: one of the target documents, one of all documents.
Adding Gumbel noise to the weights and keeping the k largest draws k documents without replacement in
proportion to their ratios. Texts are read twice, to count and to score; all that follows reads scores.

Where the target's documents are some of all documents (``member`` marks them), a text is weighed by what the
others say: its own n-grams are left out of both models, so that a rare n-gram doesn't tell who was labelled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import Words, blocks, cut, mix, with_fields

#: Buckets of hashed n-grams, and the n-grams that a weight stands for.
BUCKETS, LENGTH = 1 << 17, 100
#: With members: the n-grams that a weight stands for, and how many n-grams, shared as in the raw model, are added to a bucket.
MEMBER_LENGTH, MEMBER_PRIOR = 400, 5.0
#: Up to so many document ids (8 MB) are broadcast; more are joined by a shuffle.
BROADCAST_IDS = 1_000_000
_PAIR = np.uint64(0xD6E8FEB86659FD93)


def _buckets(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of each unigram and each bigram of a block's rows."""
    two = w.row[1:] == w.row[:-1]
    pair = mix(w.hash[:-1][two] * _PAIR + w.hash[1:][two])
    row = np.concatenate((w.row, w.row[1:][two]))
    return row, (np.concatenate((w.hash, pair)) % np.uint64(BUCKETS)).astype(np.int64)


def ngram_counts(docs: DataFrame) -> np.ndarray:
    """How often each bucket occurs in all texts. Tasks add up what they read; one row a bucket comes to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for _, _, data, offsets in blocks(batch.column(0)):
                total += np.bincount(_buckets(Words(data, offsets))[1], minlength=BUCKETS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["bucket", "n"])

    rows = docs.select(F.col("text").cast("string")).mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(BUCKETS)
    for r in rows:
        out[r["bucket"]] = r["n"]
    return out


def member_counts(docs: DataFrame, member: str) -> tuple[np.ndarray, np.ndarray]:
    """How often each bucket occurs in the texts that ``member`` marks, and in all texts, in one pass; one row a bucket comes to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, BUCKETS), np.int64)
        for batch in batches:
            inside = _flags(batch.column(1))
            for lo, _, data, offsets in blocks(batch.column(0)):
                row, bucket = _buckets(Words(data, offsets))
                total[0] += np.bincount(bucket[inside[lo + row]], minlength=BUCKETS)
                total[1] += np.bincount(bucket, minlength=BUCKETS)
        at = np.flatnonzero(total[1])
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[0][at]), pa.array(total[1][at])], names=["bucket", "target", "n"])

    counted = docs.select(F.col("text").cast("string"), F.col(member).cast("boolean")).mapInArrow(run, "bucket int, target long, n long")
    out = np.zeros((2, BUCKETS))
    for r in counted.groupBy("bucket").agg(F.sum("target").alias("target"), F.sum("n").alias("n")).collect():
        out[:, r["bucket"]] = r["target"], r["n"]
    return out[0], out[1]


def _flags(column: pa.Array) -> np.ndarray:
    return column.fill_null(False).to_numpy(zero_copy_only=False).astype(bool)


def without_own(row: np.ndarray, bucket: np.ndarray, inside: np.ndarray, target: np.ndarray, raw: np.ndarray, prior: float = MEMBER_PRIOR) -> np.ndarray:
    """The mean log ratio of each of a block's rows, whose own n-grams are taken out of the counts; ``inside`` marks the target's rows.

    ``prior`` n-grams, shared between the models as all n-grams are, are added to each bucket, so that a rare one says little.
    """
    rows = len(inside)
    key, own = np.unique(row * BUCKETS + bucket, return_counts=True)
    at, b = key // BUCKETS, key % BUCKETS
    expected = (raw[b] - own) * (target.sum() / max(1.0, raw.sum()))
    ratio = np.log(target[b] - own * inside[at] + prior) - np.log(expected + prior)
    return np.bincount(at, own * ratio, rows) / np.maximum(1, np.bincount(row, minlength=rows))


def log_ratios(target: np.ndarray, raw: np.ndarray, smoothing: float = 1.0) -> np.ndarray:
    p, q = target + smoothing, raw + smoothing
    return np.log(p / p.sum()) - np.log(q / q.sum())


def _draw(*columns: Column | str) -> Column:
    """A whole number below 2**53 that follows from the columns."""
    return F.shiftrightunsigned(F.xxhash64(*columns), 11)


def score(docs: DataFrame, models: np.ndarray | tuple[np.ndarray, np.ndarray], seed: int, carry_text: bool = True, member: str | None = None) -> DataFrame:
    """docs with n_words, log_weight and gumbel_key; texts without words get null weights and keys.

    models: the log ratio of each bucket, or with ``member`` the counts of the target's and of all texts.
    """
    names = ["n_words", "log_weight", "gumbel_key"]
    kept = [c for c in docs.columns if c not in (*names, "kept", member) and (carry_text or c != "text")]
    shared = docs.sparkSession.sparkContext.broadcast(models)

    def weights(row: np.ndarray, bucket: np.ndarray, inside: np.ndarray) -> np.ndarray:
        if member:
            return MEMBER_LENGTH * without_own(row, bucket, inside, *shared.value)
        return LENGTH * np.bincount(row, shared.value[bucket], minlength=len(inside)) / np.maximum(1, np.bincount(row, minlength=len(inside)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            noise = batch.column(len(kept) + 1).to_numpy(zero_copy_only=False)
            inside = _flags(batch.column(len(kept) + 2))
            for lo, hi, data, offsets in blocks(batch.column(len(kept))):
                w = Words(data, offsets)
                row, bucket = _buckets(w)
                weight = weights(row, bucket, inside[lo:hi])
                key = weight + noise[lo:hi]
                none = w.count == 0
                yield pa.RecordBatch.from_arrays([*(batch.column(k)[lo:hi] for k in range(len(kept))), pa.array(w.count.astype(np.int64)), pa.array(weight, mask=none), pa.array(key, mask=none)], names=[*kept, *names])

    # the noise follows from the row, so that a task that runs again draws the same
    u = (_draw("doc_id", F.col("text").cast("string"), F.lit(seed)) + F.lit(0.5)) / F.lit(float(1 << 53))
    wide = docs.select(*kept, F.col("text").cast("string").alias("__text"), (-F.log(-F.log(u))).alias("__noise"), (F.col(member).cast("boolean") if member else F.lit(False)).alias("__member"))
    return wide.mapInArrow(run, with_fields(docs.select(*kept), "n_words long, log_weight double, gumbel_key double"))


def kth_largest(keys: DataFrame, k: int, bins: int = 4096) -> tuple[float, float] | None:
    """(low, high): the kth largest of the one column of keys is in [low, high), as narrow as counts in bins make it.

    A few counting passes, each of which brings ``bins`` rows at most to the driver, take the place of a global sort.
    """
    name = keys.columns[0]
    r = keys.agg(F.min(name), F.max(name), F.count(name)).first()
    if not r[2]:
        return None
    low, high, above = r[0], np.nextafter(r[1], np.inf), 0
    for _ in range(6):
        width = (high - low) / bins
        if width <= 0 or low + width == low:
            break
        bin_of = F.least(F.floor((F.col(name) - low) / width), F.lit(bins - 1))
        counts = dict(keys.where((F.col(name) >= low) & (F.col(name) < high)).groupBy(bin_of.alias("b")).count().collect())
        total = above
        for b in sorted(counts, reverse=True):
            if total + counts[b] >= k:
                low, high, above = low + b * width, low + (b + 1) * width if b < bins - 1 else high, total
                break
            total += counts[b]
        if counts.get(b, 0) <= 1:
            break
    return low, high


def resample(docs: DataFrame, target: DataFrame | None, share: float = 0.8, seed: int = 17, carry_text: bool = True, member: str | None = None) -> DataFrame:
    """docs with n_words, log_weight, gumbel_key and kept: a sample of ``share`` of the documents with words.

    kept marks exactly k = round(share * n) of the n documents whose text has words: those of largest
    gumbel_key, which follows from doc_id and text. Ties of keys, which equal rows have, go to those with the largest draw from their row's
    number. The raw model counts all of docs, the target model the texts of ``target`` or, if that is None, the rows
    that the boolean column ``member`` marks (null: not), which isn't carried along. Null texts and those
    without words have null weights and aren't kept. A null doc_id is drawn like any other. Other columns are
    carried along, text only with carry_text, and columns of the new names are replaced. The scored rows are
    written once to the shared folder. Empty tables give an empty result.
    """
    if (target is None) != (member is not None):
        raise ValueError("either a target or the column that marks its members")
    models = member_counts(docs, member) if member else log_ratios(ngram_counts(target), ngram_counts(docs))
    scored = cut(score(docs, models, seed, carry_text, member)).withColumn("__row", F.monotonically_increasing_id())
    keys = scored.where("gumbel_key is not null").select("gumbel_key", "__row", _draw("__row", F.lit(seed)).cast("double").alias("tie"))
    k = round(share * keys.count())
    if not k:
        return scored.drop("__row").withColumn("kept", F.lit(False))
    low, high = kth_largest(keys.select("gumbel_key"), k)
    near = keys.where((F.col("gumbel_key") >= low) & (F.col("gumbel_key") < high))  # one, or rows that tie
    r = k - keys.where(F.col("gumbel_key") >= high).count()
    t_low, t_high = kth_largest(near.select("tie"), r)
    last = near.where((F.col("tie") >= t_low) & (F.col("tie") < t_high)).orderBy(F.desc("tie"), "__row").limit(r - near.where(F.col("tie") >= t_high).count()).collect()  # one, or rows of one 53-bit draw
    at, tie = F.col("gumbel_key"), _draw("__row", F.lit(seed)).cast("double")
    within = (at >= low) & ((tie >= t_high) | F.col("__row").isin([x["__row"] for x in last]))
    return scored.withColumn("kept", F.coalesce((at >= high) | within, F.lit(False))).drop("__row")


def mark_target(docs: DataFrame, labels: DataFrame, member: str) -> DataFrame:
    """docs with the column ``member``: whether a label calls the document of good quality and not toxic. All such labels count."""
    good = labels.where("quality = 1 and toxic = 0 and doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id")).distinct().withColumn(member, F.lit(True))
    return docs.join(F.broadcast(good) if good.count() <= BROADCAST_IDS else good, "doc_id", "left").withColumn(member, F.coalesce(member, F.lit(False)))


def target_share(labels: DataFrame) -> float:
    """The share of the labelled documents that are of good quality and not toxic; 1 without labels."""
    good, every = labels.agg(F.count(F.expr("CASE WHEN quality = 1 AND toxic = 0 THEN 1 END")), F.count("*")).first()
    return good / every if every else 1.0
