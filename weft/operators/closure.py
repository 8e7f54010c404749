"""Closures over edge tables: reachability, chain depth, path resolution, garbage.

Rounds of joins, each cut by a checkpoint in the shared folder, so that lineage doesn't grow and a lost
executor costs one round; only a count comes back to the driver.
"""

from __future__ import annotations

from functools import reduce
from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.functions.values import MAX_DEPTH
from weft.sources.shared import cut


def reachable(roots: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, depth): what roots (node) reach over edges (src, dst), all kinds of them, with the shortest distance.

    A round for each level, however many there are; each writes only what it found (and each 16th all that was
    found so far, as one table), and cycles end where nothing new is found.
    """
    levels = [cut(roots.select("node").distinct().withColumn("depth", F.lit(0)))]
    steps = edges.select(F.col("src").alias("node"), "dst").distinct()
    for depth in count(1):
        found = reduce(DataFrame.union, levels)
        if len(levels) > 16:
            older = cut(reduce(DataFrame.union, levels[:-1]))
            levels = [older, levels[-1]]
            found = reduce(DataFrame.union, levels)
        new = levels[-1].join(steps, "node").select(F.col("dst").alias("node")).distinct().join(found, "node", "left_anti")
        front = cut(new.withColumn("depth", F.lit(depth)))
        if front.isEmpty():
            return found
        levels.append(front)


def chain_depth(edges: DataFrame, most: int = MAX_DEPTH) -> DataFrame:
    """(node, depth, accepted): the longest chain of references from each node, bounded; longer ones and cycles are not accepted.

    most + 1 rounds decide: a chain that still goes on then is too long, whether it ends or not.
    """
    ends = edges.select(F.col("src").alias("node"), F.col("dst").alias("at")).distinct()
    depth = cut(ends.select("node").distinct().withColumn("depth", F.lit(1)).union(edges.select(F.col("dst").alias("node"), F.lit(0))).groupBy("node").agg(F.max("depth").alias("depth")))
    walk = ends
    for k in range(2, most + 2):
        walk = cut(walk.join(edges.select(F.col("src").alias("at"), F.col("dst").alias("to")), "at").select("node", F.col("to").alias("at")).distinct())
        depth = cut(depth.union(walk.select("node", F.lit(k)).distinct()).groupBy("node").agg(F.max("depth").alias("depth")))
    return depth.select("node", F.least("depth", F.lit(most + 1)).alias("depth"), (F.col("depth") <= most).alias("accepted"))


def resolve_paths(paths: DataFrame, dirents: DataFrame, root: int, parts_a_cut: int = 16) -> DataFrame:
    """paths (path) with ino: each component is looked up among its directory's entries (parent, name, ino); null if one is missing.

    Empty components and ``.`` count for nothing; ``..`` isn't resolved. Paths may be of any length: each
    component is a join, and after each parts_a_cut of them the rows are written, so that plans stay short.
    """
    parts = F.filter(F.split("path", "/"), lambda p: (p != "") & (p != "."))
    at = paths.select("path", parts.alias("parts"), F.lit(root).cast("long").alias("at"))
    longest = at.agg(F.max(F.size("parts"))).first()[0] or 0
    entries = dirents.select(F.col("parent").alias("at"), F.col("name").alias("part"), F.col("ino").cast("long").alias("next"))
    for k in range(longest):
        more = F.size("parts") > k
        step = at.withColumn("part", F.when(more, F.get("parts", F.lit(k)))).join(entries, ["at", "part"], "left")
        at = step.select("path", "parts", F.when(more, F.col("next")).otherwise(F.col("at")).alias("at"))
        if k % parts_a_cut == parts_a_cut - 1:
            at = cut(at)
    return at.select("path", F.when(~F.exists("parts", lambda p: p == ".."), F.col("at")).alias("ino"))


def parents(dirents: DataFrame) -> DataFrame:
    """(ino, parent): the smallest directory that names each inode."""
    return dirents.groupBy("ino").agg(F.min("parent").alias("parent"))


def unreachable(objects: DataFrame, live: DataFrame, key: str, tag: str, size: str) -> DataFrame:
    """Objects and bytes by tag that nothing live refers to."""
    return objects.join(live.select(key).distinct(), key, "left_anti").groupBy(tag).agg(F.count("*").alias("objects"), F.sum(size).cast("long").alias("bytes"))


def victims(ratios: DataFrame, below: float = 0.6) -> DataFrame:
    """Segments to collect: those of which less than this share lives."""
    return ratios.where(F.col("ratio") < below)


def survivors(records: DataFrame, live: DataFrame, chosen: DataFrame, key: str, segment: str) -> DataFrame:
    """Live records of the chosen segments, to be copied on before these are deleted."""
    return records.join(chosen.select(segment), segment, "left_semi").join(live.select(key).distinct(), key, "left_semi")


def physical_report(records: DataFrame, index: DataFrame, live: DataFrame) -> DataFrame:
    """Bytes by category: every record (cid, segment, offset, tag, size) is live, a superseded copy, unreachable, or padding."""
    i = index.select("cid", F.col("segment").alias("i_segment"), F.col("offset").alias("i_offset"))
    marked = records.join(i, "cid", "left").join(live.select("cid").distinct().withColumn("is_live", F.lit(True)), "cid", "left")
    canonical = (F.col("segment") == F.col("i_segment")) & (F.col("offset") == F.col("i_offset"))
    category = F.when(F.col("tag") == "pad", "padding").when(~F.coalesce(canonical, F.lit(False)), "superseded").when(F.col("is_live"), F.concat(F.lit("live-"), F.col("tag"))).otherwise(F.concat(F.lit("dead-"), F.col("tag")))
    return marked.groupBy(category.alias("category")).agg(F.count("*").alias("records"), F.sum("size").cast("long").alias("bytes"))
