"""The mutation log and what it does to inodes and names."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weft.sources.shared import cut


def pending(log: DataFrame, applied: int) -> DataFrame:
    """Records after the applied sequence; what comes late, at or below it, is ignored."""
    return log.where(F.col("seq") > applied)


def strict(log: DataFrame) -> DataFrame:
    """The log, or an error at the first repeated sequence."""
    twice = log.groupBy("seq").agg(F.count("*").alias("times"), F.first(F.struct(*[c for c in log.columns if c != "seq"])).alias("r"))
    ok = F.when(F.col("times") == 1, F.col("seq")).otherwise(F.raise_error(F.concat(F.lit("repeated sequence "), F.col("seq").cast("string"))))
    return twice.withColumn("seq", ok).select("seq", "r.*")


def replay(inodes: DataFrame, log: DataFrame, applied: int = -1) -> DataFrame:
    """inodes (ino, size, nlink) after the log (seq, op, ino, size): create, setattr, write, link, unlink.

    create makes an empty file of one link; setattr sets a size that isn't null; write grows a file to at
    least its end (size); link and unlink change nlink, and at 0 the inode goes. Order matters for sizes
    only after the last setattr or create, so a grouped maximum finds that, and sums and maxima do the rest.
    """
    new = pending(log, applied)
    old = inodes.select(F.lit(-1).cast("long").alias("seq"), F.lit("base").alias("op"), "ino", F.col("size").cast("long").alias("size"), F.col("nlink").cast("long").alias("nlink"))
    steps = old.unionByName(new.select("seq", "op", "ino", F.col("size").cast("long").alias("size"), F.lit(None).cast("long").alias("nlink")))
    sets = (F.col("op") == "base") | (F.col("op") == "create") | ((F.col("op") == "setattr") & F.col("size").isNotNull())
    anchor = steps.groupBy("ino").agg(F.max(F.when(sets, F.col("seq"))).alias("at"), F.max_by(F.when(F.col("op") == "create", 0).otherwise(F.col("size")), F.when(sets, F.col("seq"))).alias("base_size"))
    grown = steps.join(anchor, "ino").groupBy("ino").agg(
        F.first("base_size").alias("base_size"),
        F.max(F.when((F.col("op") == "write") & (F.col("seq") > F.coalesce("at", F.lit(-2))), F.col("size"))).alias("written"),
        F.sum(F.when(F.col("op") == "base", F.col("nlink")).when(F.col("op").isin("create", "link"), 1).when(F.col("op") == "unlink", -1).otherwise(0)).cast("long").alias("nlink"),
        F.max("seq").alias("last_seq"),
    )
    return grown.select("ino", F.greatest(F.coalesce("base_size", F.lit(0)), F.coalesce("written", F.lit(0))).alias("size"), "nlink", "last_seq").where("nlink > 0")


def replay_names(dirents: DataFrame, log: DataFrame, applied: int = -1) -> DataFrame:
    """dirents (parent, name, ino) after creates, links, unlinks and renames (seq, op, ino, parent, name, dst_parent, dst_name).

    Each record sets or clears one name, a rename clears one and sets another; the last record of a name counts.
    """
    new = pending(log, applied)
    at = "struct<ino: long, seq: long, step: int>"
    sets = new.where("op in ('create', 'link')").select("parent", "name", F.col("ino").cast("long").alias("ino"), "seq", F.lit(1).alias("step"))
    clears = new.where("op in ('unlink', 'rename')").select("parent", "name", F.lit(None).cast("long").alias("ino"), "seq", F.lit(0).alias("step"))
    moves = new.where("op = 'rename'").select(F.col("dst_parent").alias("parent"), F.col("dst_name").alias("name"), F.col("ino").cast("long").alias("ino"), "seq", F.lit(1).alias("step"))
    old = dirents.select("parent", "name", F.col("ino").cast("long").alias("ino"), F.lit(-1).cast("long").alias("seq"), F.lit(0).alias("step"))
    last = old.union(sets).union(clears).union(moves).groupBy("parent", "name").agg(F.max_by(F.struct("ino", "seq", "step").cast(at), F.struct("seq", "step")).alias("r"))
    return last.select("parent", "name", F.col("r.ino").alias("ino")).where("ino is not null")


def truncate(extents: DataFrame, cuts: DataFrame) -> DataFrame:
    """extents (ino, start, len) of files cut (ino, size): those beyond go, one across the end is shortened; growing adds a hole, so nothing."""
    met = extents.join(cuts.select("ino", F.col("size").alias("__size")), "ino", "left")
    n = F.when(F.col("__size").isNull(), F.col("len")).otherwise(F.least(F.col("len"), F.col("__size") - F.col("start")))
    return met.withColumn("len", n).where("len > 0").select(*extents.columns)


def punch(extents: DataFrame, holes: DataFrame) -> DataFrame:
    """extents (ino, start, len) without what lies in a hole (ino, off, stop), one hole a file at most: what remains before and after it."""
    met = extents.join(holes, "ino", "left")
    end = F.col("start") + F.col("len")
    parts = F.array(F.struct(F.col("start").alias("a"), F.least(end, F.coalesce("off", end)).alias("b")), F.struct(F.greatest(F.col("start"), F.coalesce("stop", end)).alias("a"), end.alias("b")))
    rest = [c for c in extents.columns if c not in ("start", "len")]
    return met.select(*rest, F.explode(parts).alias("p")).select(*rest, F.col("p.a").alias("start"), (F.col("p.b") - F.col("p.a")).alias("len")).where("len > 0").select(*extents.columns)


def copy_range(extents: DataFrame, copies: DataFrame) -> DataFrame:
    """Extents of files that get a range (src, off, stop, dst, to) of another: clipped to the range and moved; data are shared, not rewritten."""
    met = extents.join(copies, extents["ino"] == copies["src"]).where((F.col("start") < F.col("stop")) & (F.col("start") + F.col("len") > F.col("off")))
    a, b = F.greatest("start", "off"), F.least(F.col("start") + F.col("len"), F.col("stop"))
    return met.select(F.col("dst").alias("ino"), (a - F.col("off") + F.col("to")).alias("start"), (b - a).alias("len"))


def allocate(inodes: DataFrame, names: DataFrame, order: str) -> DataFrame:
    """names with the inode numbers that follow the largest in use, in order; the count of names in each range partition comes first, so no task gets all."""
    base = inodes.agg(F.coalesce(F.max("ino"), F.lit(0)).alias("base"))
    ranged = cut(names.repartitionByRange(F.col(order)).withColumn("part", F.spark_partition_id()))
    own = ranged.withColumn("n", F.row_number().over(W.partitionBy("part").orderBy(order)))
    before = ranged.groupBy("part").count().withColumn("skip", F.coalesce(F.sum("count").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("count")
    return own.join(before, "part").join(F.broadcast(base)).withColumn("ino", F.col("base") + F.col("skip") + F.col("n")).drop("part", "n", "skip", "base")


def has_room(used: int, new: int, capacity: int, share: float = 0.92) -> bool:
    """Whether a write may begin: what it leads to stays within this share of the capacity."""
    return used + new <= share * capacity


def attributes(log: DataFrame) -> DataFrame:
    """(ino, name, value) after a log (ino, name, seq, value) of settings: the last of each name, none where it was removed (null)."""
    return log.groupBy("ino", "name").agg(F.max_by("value", "seq").alias("value")).where("value is not null")
