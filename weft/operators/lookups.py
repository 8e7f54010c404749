"""Lookups by offset, range and version: as-of and interval joins on bucketed keys, overlays, pages."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weft.sources.shared import cut


def as_of(points: DataFrame, extents: DataFrame, key: str = "ino", at: str = "pos", start: str = "start", forward: bool = False, width: int = 1 << 20) -> DataFrame:
    """points with the extent row of the same key that begins last at or before the point (forward: first at or after it), as struct ``found``.

    Points and extents are unioned and a running last value fills the points in, within stretches of
    ``width``, so that a key of very many extents is spread over tasks; what a stretch takes over from
    those before it comes from one row a stretch. Among extents of one start the largest row counts.
    """
    fields = [c for c in extents.columns if c != key]
    sign = -1 if forward else 1  # forward is backward on negated places
    e = extents.select(F.col(key).alias("__k"), (sign * F.col(start)).cast("long").alias("__at"), F.lit(0).alias("__point"), F.struct(*fields).alias("__e"), *(F.lit(None).cast(t).alias(f"p_{c}") for c, t in points.dtypes))
    p = points.select(F.col(key).alias("__k"), (sign * F.col(at)).cast("long").alias("__at"), F.lit(1).alias("__point"), F.lit(None).cast(e.schema["__e"].dataType).alias("__e"), *(F.col(c).alias(f"p_{c}") for c in points.columns))
    both = e.union(p).withColumn("__b", F.floor(F.col("__at") / width))
    within = W.partitionBy("__k", "__b").orderBy("__at", "__point", "__e").rowsBetween(W.unboundedPreceding, 0)
    here = both.withColumn("__own", F.last("__e", ignorenulls=True).over(within)).where("__point = 1")
    stretch = both.groupBy("__k", "__b").agg(F.max(F.when(F.col("__point") == 0, F.struct("__at", "__e"))).alias("__last"))
    before = W.partitionBy("__k").orderBy("__b").rowsBetween(W.unboundedPreceding, -1)
    carried = stretch.select("__k", "__b", F.last("__last", ignorenulls=True).over(before).alias("__taken"))
    found = F.coalesce(F.col("__own"), F.col("__taken.__e")).alias("found")
    return here.join(carried, ["__k", "__b"]).select(*(F.col(f"p_{c}").alias(c) for c in points.columns), found)


def overlapping(windows: DataFrame, extents: DataFrame, width: int, key: str = "ino") -> DataFrame:
    """Pairs of a window [off, stop) and an extent [start, end) of the same key that overlap.

    Both sides go to the buckets of ``width`` that they touch and meet there by equality; a pair is kept
    in the first bucket that both touch, so it occurs once and needs no distinct.
    """
    buckets = lambda a, b: F.sequence(F.floor(F.col(a) / width), F.floor((F.col(b) - 1) / width))
    w = windows.where("off < stop").withColumn("__b", F.explode(buckets("off", "stop")))
    e = extents.where("start < end").withColumn("__b", F.explode(buckets("start", "end")))
    first = F.floor(F.greatest("off", "start") / width)
    return w.join(e, [key, "__b"]).where((F.col("start") < F.col("stop")) & (F.col("end") > F.col("off")) & (F.col("__b") == first)).drop("__b")


def conflicts(locks: DataFrame, width: int) -> DataFrame:
    """Pairs of range locks (ino, lock_id, owner, start, end inclusive, typ) that exclude each other: overlap, two owners, a writer among them."""
    a = locks.select("ino", F.col("start").alias("off"), (F.col("end") + 1).alias("stop"), F.col("lock_id").alias("a_id"), F.col("owner").alias("a_owner"), F.col("typ").alias("a_typ"))
    b = locks.select("ino", "start", (F.col("end") + 1).alias("end"), F.col("lock_id").alias("b_id"), F.col("owner").alias("b_owner"), F.col("typ").alias("b_typ"))
    return overlapping(a, b, width).where("a_id < b_id and a_owner <> b_owner and (a_typ = 'W' or b_typ = 'W')").select("ino", "a_id", "b_id")


def read_ranges(requests: DataFrame, extents: DataFrame, width: int) -> DataFrame:
    """requests (req, ino, off, stop, size) with the bytes read: clipped to the file's size, holes as zeros.

    extents: (ino, start, end, bytes). A request is one buffer by nature; requests spread over tasks.
    """
    clipped = requests.withColumn("stop", F.least("stop", "size")).select("req", "ino", "off", "stop")
    met = overlapping(clipped, extents.select("ino", "start", "end", "bytes"), width)
    parts = met.groupBy("req").agg(F.collect_list(F.struct("start", "bytes")).alias("parts"))

    @F.pandas_udf("binary")
    def fill(off: pd.Series, stop: pd.Series, parts: pd.Series) -> pd.Series:
        out = []
        for a, b, some in zip(off, stop, parts, strict=True):
            buffer = bytearray(max(0, b - a))
            for p in sorted(some if some is not None else [], key=lambda p: p["start"]):
                s, data = p["start"], p["bytes"]
                x, y = max(a, s), min(b, s + len(data))
                buffer[x - a : y - a] = data[x - s : y - s]
            out.append(bytes(buffer))
        return pd.Series(out)

    return clipped.join(parts, "req", "left").select("req", "ino", fill("off", "stop", "parts").alias("bytes"))


def overlay(committed: DataFrame, pending: DataFrame, keys: list[str], order: str = "seq", gone: str = "deleted") -> DataFrame:
    """committed with pending's rows over it: of each key the last by ``order`` counts, and is dropped if it says ``gone``.

    pending has committed's columns, order and gone. A grouped maximum, not a window: keys that change often are pre-aggregated.
    """
    rest = [c for c in committed.columns if c not in keys]
    both = committed.withColumn(order, F.lit(-1).cast("long")).withColumn(gone, F.lit(False)).unionByName(pending.select(*committed.columns, F.col(order).cast("long").alias(order), gone))
    last = both.groupBy(*keys).agg(F.max_by(F.struct(*rest, gone), F.col(order)).alias("last"))
    return last.where(~F.col(f"last.{gone}")).select(*keys, *(F.col(f"last.{c}").alias(c) for c in rest))


def page(rows: DataFrame, key: str, after, limit: int) -> DataFrame:
    """Up to ``limit`` rows after a key in key order, with has_more: a keyset page, one row more than asked is read."""
    some = rows.where(F.col(key) > F.lit(after)) if after is not None else rows
    top = some.orderBy(key).limit(limit + 1)
    w = W.orderBy(key)
    return top.withColumn("__n", F.row_number().over(w)).withColumn("has_more", F.max("__n").over(W.partitionBy()) > limit).where(F.col("__n") <= limit).drop("__n")


def neighbours(chunks: DataFrame, key: str, idx: str, value: str) -> DataFrame:
    """chunks with the value before and after in index order, as previous and following."""
    w = W.partitionBy(key).orderBy(idx)
    return chunks.withColumn("previous", F.lag(value).over(w)).withColumn("following", F.lead(value).over(w))


def latest(rows: DataFrame, keys: list[str], order: Column | str) -> DataFrame:
    """Of each key the row of the largest order."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("r")).select(*keys, *(F.col(f"r.{c}").alias(c) for c in rest))


def points(wanted: DataFrame, table: DataFrame, keys: list[str]) -> DataFrame:
    """wanted with the table's row of each key and found; keys that the table lacks are kept with nulls."""
    return wanted.join(table.withColumn("found", F.lit(True)), keys, "left").withColumn("found", F.coalesce("found", F.lit(False)))


def in_order(rows: DataFrame, keys: list[str]) -> DataFrame:
    """rows with place, from 1 in the order of unique keys: a range exchange, counts of its partitions (a row each), and places within them."""
    ordered = cut(rows.orderBy(*keys).withColumn("__part", F.spark_partition_id()))
    before, total = [], 0
    for part, n in sorted((r[0], r[1]) for r in ordered.groupBy("__part").count().collect()):
        before.append((part, total))
        total += n
    starts = F.broadcast(rows.sparkSession.createDataFrame(before, "__part int, __before long"))  # a row a partition
    place = F.row_number().over(W.partitionBy("__part").orderBy(*keys))
    return ordered.join(starts, "__part").withColumn("place", (F.col("__before") + place).cast("int")).drop("__part", "__before")
