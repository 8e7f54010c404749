"""Tables in versions: Parquet directories and a pointer that is moved only when a version is whole."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.operators.chunks import byte_range, distinct_blobs, verified


class VersionedTable:
    """publish writes a new version; read gives the newest, or one by number or snapshot name.

    The pointer is a small text dataset a version, written by Spark, so any file system that Spark reads
    will do. A version without one was never published and is never read.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str):
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema

    def _pointers(self) -> list[dict]:
        sc = self.spark.sparkContext
        hadoop = sc._jvm.org.apache.hadoop.fs.Path(f"{self.path}/pointers")
        fs = hadoop.getFileSystem(sc._jsc.hadoopConfiguration())
        if not fs.exists(hadoop):
            return []
        rows = self.spark.read.text(f"{self.path}/pointers/*").collect()  # a line for each version
        return sorted((json.loads(r[0]) for r in rows), key=lambda p: p["version"])

    def meta(self) -> dict:
        found = self._pointers()
        return found[-1] if found else {}

    def versions(self) -> list[int]:
        return [p["version"] for p in self._pointers()]

    def publish(self, rows: DataFrame, **meta) -> int:
        """Write rows as the newest version; what the version before says of itself goes on unless meta says otherwise."""
        return self._point([self._write(rows)], **meta)

    def append(self, rows: DataFrame, **meta) -> int:
        """A version of the newest one's files and of rows, which alone are written."""
        return self._point([*self.meta().get("data", []), self._write(rows)], **meta)

    def _write(self, rows: DataFrame) -> str:
        data = f"{self.path}/data/{uuid.uuid4().hex}"
        rows.write.parquet(data)
        return data

    def _point(self, data: list[str], **meta) -> int:
        """Point to files by the next number; if another writer has taken it since, that is an error."""
        before = {k: v for k, v in self.meta().items() if k not in ("snapshot", "deleted")}
        version = before.get("version", 0) + 1
        line = json.dumps(before | meta | {"version": version, "data": data})
        self.spark.createDataFrame([(line,)], "value string").coalesce(1).write.mode("errorifexists").text(f"{self.path}/pointers/v{version:08d}")
        return version

    def _named(self, name: str) -> dict:
        found = [p for p in self._pointers() if p.get("snapshot") == name]
        if not found or any(p.get("deleted") == name and p["version"] > found[-1]["version"] for p in self._pointers()):
            raise KeyError(name)
        return found[-1]

    def read(self, version: int | None = None, snapshot: str | None = None) -> DataFrame:
        found = self._pointers() if snapshot is None else [self._named(snapshot)]
        if version is not None:
            found = [p for p in found if p["version"] == version]
            if not found:
                raise KeyError(version)
        if not found:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*found[-1]["data"])

    def snapshot(self, name: str) -> int:
        """Point to the newest version's files once more, under a name; nothing is copied."""
        return self._point(self.meta().get("data") or [self._write(self.read())], snapshot=name)

    def snapshots(self) -> list[tuple[str, int]]:
        """Name and version of the snapshots that aren't deleted."""
        last = {p["snapshot"]: p["version"] for p in self._pointers() if "snapshot" in p}
        gone = {p["deleted"]: p["version"] for p in self._pointers() if "deleted" in p}
        return [(n, v) for n, v in last.items() if gone.get(n, 0) < v]

    def delete_snapshot(self, name: str) -> int:
        """Give the name up; the newest version stays as it is."""
        self._named(name)
        return self._point(self.meta()["data"], deleted=name)

    def restore(self, name: str) -> int:
        """Point to a snapshot's files as the newest version; the snapshot stays."""
        return self._point(self._named(name)["data"])


class BlobTable:
    """Blobs by content id: put, get, ranges and existence over a versioned table."""

    def __init__(self, spark: SparkSession, path: str):
        self.table = VersionedTable(spark, path, "blob_id string, bytes binary")

    def put(self, blobs: DataFrame) -> DataFrame:
        """Store what isn't there yet, and give every blob's id; a blob put twice is stored once."""
        old = self.table.read()
        self.table.append(distinct_blobs(blobs.select("bytes"), old).select("blob_id", "bytes"))
        return blobs.withColumn("blob_id", F.sha2("bytes", 256))

    def get(self, ids: DataFrame) -> DataFrame:
        return verified(self.table.read().join(ids.select("blob_id").distinct(), "blob_id", "left_semi"))

    def ranges(self, requests: DataFrame) -> DataFrame:
        """requests (blob_id, off, len) with the bytes, clipped to the blob's end."""
        return requests.join(self.table.read(), "blob_id").withColumn("bytes", byte_range(F.col("bytes"), F.col("off"), F.col("len")))

    def contains(self, ids: DataFrame) -> DataFrame:
        have = self.table.read().select("blob_id").withColumn("found", F.lit(True))
        return ids.join(have, "blob_id", "left").withColumn("found", F.coalesce("found", F.lit(False)))
