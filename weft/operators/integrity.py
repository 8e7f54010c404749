"""Checks: each gives findings (category, severity, key, detail), empty if the data are sound."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weft.functions import values
from weft.operators import accounting, closure


def _finding(rows: DataFrame, category: str, severity: str, key: Column, detail: Column) -> DataFrame:
    return rows.select(F.lit(category).alias("category"), F.lit(severity).alias("severity"), key.cast("string").alias("key"), detail.cast("string").alias("detail"))


def overlaps(extents: DataFrame) -> DataFrame:
    """Extents (ino, start, len) that begin before the furthest end of those before them."""
    before = W.partitionBy("ino").orderBy("start", "len").rowsBetween(W.unboundedPreceding, -1)
    return extents.withColumn("furthest", F.max(F.col("start") + F.col("len")).over(before)).where("start < furthest")


def beyond_end(extents: DataFrame, inodes: DataFrame) -> DataFrame:
    """Extents that end beyond their file's size."""
    return extents.join(inodes.select("ino", "size"), "ino").where("start + len > size")


def repeated_sequence(log: DataFrame, seq: str = "seq") -> DataFrame:
    return log.groupBy(seq).count().where("count > 1")


def missing(references: DataFrame, targets: DataFrame, ref: str, target: str) -> DataFrame:
    """References to what isn't there."""
    return references.where(F.col(ref).isNotNull()).join(targets.select(F.col(target).alias(ref)).distinct(), ref, "left_anti")


def wrong_links(inodes: DataFrame, dirents: DataFrame) -> DataFrame:
    """Inodes (ino, nlink) whose directory entries (ino) are more or fewer than nlink."""
    n = dirents.groupBy("ino").agg(F.count("*").alias("entries"))
    return inodes.join(n, "ino", "left").withColumn("entries", F.coalesce("entries", F.lit(0))).where("entries <> nlink").select("ino", "nlink", "entries")


def bad_inodes(inodes: DataFrame) -> DataFrame:
    """Inodes without links, directories of fewer than two, and symlinks whose size isn't their target's."""
    bad = (F.col("nlink") == 0) | ((F.col("data_kind") == "directory") & (F.col("nlink") < 2)) | ((F.col("data_kind") == "symlink") & (F.col("size") != F.octet_length("symlink_target")))
    return inodes.where(bad)


def out_of_order(entries: DataFrame, key: str, by: str) -> DataFrame:
    """Keys that aren't above the key stored before them in their node."""
    return entries.withColumn("before", F.lag(key).over(W.partitionBy(by).orderBy("pos"))).where(F.col(key) <= F.col("before"))


def unexplained(files: DataFrame, records: DataFrame, segment: str, size: str) -> DataFrame:
    """Bytes of each segment's file that no record category explains; all 0 in a sound store."""
    s = records.groupBy(segment).agg(F.sum(size).cast("long").alias("explained"))
    return files.join(s, segment, "left").withColumn("unexplained", F.col("file_bytes") - F.coalesce("explained", F.lit(0)))


def newest_root(roots: DataFrame) -> DataFrame:
    """Of the valid root slots (generation, root_id, valid) the newest."""
    return roots.where("valid").agg(F.max("generation").alias("generation"), F.max_by("root_id", "generation").alias("root_id"))


def report(findings: list[DataFrame]) -> DataFrame:
    """Findings by category and severity; a leak only warns."""
    return reduce(DataFrame.unionByName, findings).groupBy("category", "severity").agg(F.count("*").alias("findings"))


def check_store(inodes: DataFrame, dirents: DataFrame, extents: DataFrame, objects: DataFrame, log: DataFrame) -> DataFrame:
    """All findings of one pass; objects: (obj), extents: (ino, start, len, obj), log: (seq)."""
    used = extents.select("obj")
    return reduce(
        DataFrame.unionByName,
        [
            _finding(overlaps(extents), "extent-overlap", "error", F.col("ino"), F.col("start")),
            _finding(beyond_end(extents, inodes), "extent-past-end", "error", F.col("ino"), F.col("start")),
            _finding(missing(extents, objects, "obj", "obj"), "missing-object", "error", F.col("ino"), F.col("obj")),
            _finding(missing(dirents, inodes, "ino", "ino"), "missing-inode", "error", F.col("ino"), F.lit(None)),
            _finding(wrong_links(inodes, dirents), "link-count", "error", F.col("ino"), F.col("entries")),
            _finding(repeated_sequence(log), "repeated-sequence", "error", F.col("seq"), F.col("count")),
            _finding(missing(objects, used, "obj", "obj"), "unreachable", "warning", F.col("obj"), F.lit(None)),
        ],
    )


def check_metadata(roots: DataFrame, snapshots: DataFrame, nodes: DataFrame, entries: DataFrame, inodes: DataFrame, extents: DataFrame, index: DataFrame, references: DataFrame) -> DataFrame:
    """Findings beside check_store's: root slots (generation, valid), snapshots (name, root) without their root among the
    nodes (node), directory entries (parent, name, ino, kind), inodes, extents (ino, start, cid) against the chunk index
    (ino, start, cid), chains of references (src, dst) that are too deep or run in a circle. A spare slot that isn't valid only warns."""
    too_deep = closure.chain_depth(references).where("not accepted")
    return reduce(
        DataFrame.unionByName,
        [
            _finding(roots.where("not valid"), "root-slot", "warning", F.col("generation"), F.lit(None)),
            _finding(missing(snapshots, nodes, "root", "node"), "snapshot-root", "error", F.col("name"), F.col("root")),
            _finding(accounting.invalid_entries(entries, inodes, values.valid_name(F.col("name"))), "directory-entry", "error", F.col("parent"), F.col("finding")),
            _finding(bad_inodes(inodes), "inode", "error", F.col("ino"), F.col("nlink")),
            _finding(accounting.index_mismatches(extents, index, ["ino", "start"]), "chunk-index", "error", F.col("ino"), F.col("finding")),
            _finding(too_deep, "reference-depth", "error", F.col("node"), F.col("depth")),
        ],
    )
