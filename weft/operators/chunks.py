"""Chunking, content ids and deduplication of blobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weft.functions.values import content_id
from weft.sources.shared import cut


def chunk(blobs: DataFrame, size: int, data: str = "bytes") -> DataFrame:
    """A row for each ``size`` bytes of each blob, the last shorter: idx, off, len, cid and bytes. Empty and null blobs have none."""
    n = F.ceil(F.octet_length(data) / size).cast("int")
    rows = blobs.where(F.octet_length(data) > 0).withColumn("idx", F.explode(F.sequence(F.lit(0), n - 1)))
    cut = rows.withColumn("off", F.col("idx").cast("long") * size).withColumn("bytes", F.substring(F.col(data), F.col("idx") * size + 1, F.lit(size)))
    return cut.withColumn("len", F.octet_length("bytes")).withColumn("cid", content_id(F.col("bytes")))


def distinct_blobs(blobs: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """Blobs to add: one row for each content id that ``existing`` (blob_id) lacks."""
    new = blobs.withColumn("blob_id", content_id(F.col("bytes"))).dropDuplicates(["blob_id"])
    return new if existing is None else new.join(existing.select("blob_id"), "blob_id", "left_anti")


def verified(blobs: DataFrame) -> DataFrame:
    """Blobs whose bytes still have their id; any other row ends the query with an error."""
    return blobs.withColumn("bytes", F.when(content_id(F.col("bytes")) == F.col("blob_id"), F.col("bytes")).otherwise(F.raise_error(F.concat(F.lit("corrupt blob "), F.col("blob_id")))))


def byte_range(data: Column, offset: Column, length: Column) -> Column:
    """The bytes from offset on, clipped to the end; none from the end on."""
    return F.substring(data, (offset + 1).cast("int"), length.cast("int"))


def dedup_report(chunks: DataFrame, *by: str) -> DataFrame:
    """Chunks and bytes, all and unique within each group, and the bytes that sharing saves."""
    one = chunks.groupBy(*by, "cid").agg(F.count("*").alias("n"), F.max("len").cast("long").alias("len"))
    return one.groupBy(*by).agg(
        F.sum("n").alias("chunks"), F.count("*").alias("unique_chunks"), F.sum(F.col("n") * F.col("len")).alias("logical_bytes"), F.sum("len").alias("unique_bytes"), F.sum((F.col("n") - 1) * F.col("len")).alias("dedup_saved")
    )


def shared_saving(objects: DataFrame, obj: str, size: str) -> DataFrame:
    """One row: objects that several references share, and the bytes that this saves."""
    one = objects.groupBy(obj).agg(F.count("*").alias("n"), F.max(size).cast("long").alias("size")).where("n >= 2")
    return one.agg(F.count("*").alias("shared_objects"), F.coalesce(F.sum((F.col("n") - 1) * F.col("size")), F.lit(0)).alias("saved_bytes"))


def pack(blobs: DataFrame, name: str, data: str) -> DataFrame:
    """name, place and size of each blob's record in a pack: records in name order, each of a 4-byte name length, the name, an 8-byte length and the bytes.

    Places are prefix sums in two steps, of partitions in name order and within them, so no task gets all
    rows. Names and sizes are written to the shared folder with their partition's number first: both steps
    must see the same partitions.
    """
    size = (F.lit(12) + F.octet_length(F.col(name)) + F.octet_length(F.col(data))).cast("long")
    ranged = cut(blobs.select(F.col(name).alias("name"), size.alias("size")).repartitionByRange(F.col("name")).withColumn("part", F.spark_partition_id()))
    before = W.partitionBy("part").orderBy("name").rowsBetween(W.unboundedPreceding, -1)
    own = ranged.withColumn("own", F.coalesce(F.sum("size").over(before), F.lit(0)))
    parts = ranged.groupBy("part").agg(F.sum("size").alias("total"))
    starts = parts.select("part", F.coalesce(F.sum("total").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("base"))  # a row for each partition
    return own.join(starts, "part").select("name", (F.col("base") + F.col("own")).alias("place"), "size")
