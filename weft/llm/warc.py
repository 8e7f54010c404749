"""WARC archives: a deterministic sharded writer and a reader.

Records are ordered by page_id and dealt to shards by boundaries that follow from the data alone, each
task writes one shard, rolls its files by compressed size, and every file gets its last name only after
the manifest that lists it is in the shared folder. The same pages give the same files, byte for byte.
"""

from __future__ import annotations

import base64
import hashlib
import io
import json
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import files
from .base import cut

#: Text of a shard and compressed bytes after which a shard goes on in its next file.
SHARD_BYTES = 256 << 20
FILE_BYTES = 128 << 20
#: page_ids drawn for each shard to set its boundaries, and for all shards (8 MB) as far as each still gets FEWEST.
DRAWN, DRAWN_IN_ALL, FEWEST = 64, 1 << 20, 4
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_uri(page_id: int | None, digest: str, again: int = 0) -> str:
    """A record's name; rows that repeat a page_id and its payload are told apart by their order."""
    return f"urn:page:{'' if page_id is None else page_id}:{digest}" + f":{again}" * (again > 0)


def record_bytes(kind: str, name: str, url: str | None, date: str, digest: str, size: int, payload: bytes, refers_to: str | None) -> bytes:
    """One record; a revisit has no block, and names the response's record, its digest and its payload's size."""
    url = (url or "").replace("\r", " ").replace("\n", " ")
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % size
    block = http + payload if kind == "response" else http
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <{name}>",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {url}",
        "Content-Type: application/http; msgtype=response",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"WARC-Block-Digest: sha1:{sha1_base32(block)}",
    ]
    if kind == "revisit":
        head += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: <{refers_to}>"]
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def gzip_member(data: bytes) -> bytes:
    c = zlib.compressobj(6, zlib.DEFLATED, 31)  # no name and no time in the header
    return c.compress(data) + c.flush()


def read_records(raw) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record of a gzip-member-per-record archive, reading a little at a time."""
    unzip, held = zlib.decompressobj(31), io.BytesIO()
    data = raw.read(1 << 20)
    while data:
        held.write(unzip.decompress(data))
        if unzip.eof:
            member = held.getvalue()
            head, _, rest = member.partition(b"\r\n\r\n")
            lines = head.decode().split("\r\n")
            headers = dict(x.split(": ", 1) for x in lines[1:])
            yield headers, rest[: int(headers["Content-Length"])]
            data, unzip, held = unzip.unused_data, zlib.decompressobj(31), io.BytesIO()
            if data:
                continue
        data = raw.read(1 << 20)


def _boundaries(pages: DataFrame, shards: int) -> list[int]:
    """Ascending page_ids that cut the pages into about equal shards: quantiles of a sample drawn by a hash of page_id."""
    n = pages.where("page_id is not null").count()
    share = min(1.0, min(DRAWN * shards, max(FEWEST * shards, DRAWN_IN_ALL)) / max(1, n))
    draw = F.shiftrightunsigned(F.xxhash64("page_id", F.lit(3)), 11) / F.lit(float(1 << 53))
    drawn = sorted(r[0] for r in pages.where("page_id is not null").where(draw < share).select("page_id").collect())
    return sorted({drawn[len(drawn) * k // shards] for k in range(1, shards)}) if drawn else []


def revisits(pages: DataFrame) -> DataFrame:
    """(page_id, sha1, response_id) of the rows whose payload another, larger page_id has too."""
    narrow = pages.select("page_id", F.sha1(F.coalesce("html", F.lit("")).cast("binary")).alias("sha1"))
    first = narrow.groupBy("sha1").agg(F.max("page_id").alias("response_id"), F.min("page_id").alias("low")).where("low < response_id").select("sha1", "response_id")
    return narrow.join(first, "sha1").where("page_id < response_id").select("page_id", "sha1", "response_id").distinct()


def write_warc(pages: DataFrame, out_dir: str, least_payload: int = 0, date: str = "2024-01-01T00:00:00Z", file_bytes: int = FILE_BYTES, shard_bytes: int = SHARD_BYTES) -> list[dict]:
    """Write a record for each page and return the manifest's rows.

    The payload is the html in UTF-8, empty if null. Of pages with equal payloads of at least
    least_payload bytes the largest page_id becomes the response and the others revisit it. Rows that
    repeat a page_id are each a record, ordered by html; of those that share the response's page_id and
    payload the first is the response. Rows with a null page_id come first and revisit only one another.
    Null urls are written as empty ones; other columns are not read. No pages give no files.

    The html is shuffled once: what a page revisits goes into the same exchange as rows of its own.
    """
    spark = pages.sparkSession
    files.make_dir(out_dir)
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    total = pages.agg(F.sum(F.octet_length("html"))).first()[0] or 0
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // shard_bytes))
    bounds = _boundaries(pages, shards)
    links = revisits(pages.where(F.coalesce(F.octet_length("html"), F.lit(0)) >= least_payload))
    both = pages.select("page_id", F.lit(1).alias("kind"), "url", "html", F.lit(None).cast("string").alias("sha1"), F.lit(None).cast("long").alias("response_id")).union(
        links.select("page_id", F.lit(0), F.lit(None).cast("string"), F.lit(None).cast("string"), "sha1", "response_id")
    )
    edges = np.array(bounds, np.int64)

    @F.pandas_udf("int")
    def shard(page_id: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(edges, page_id.to_numpy(np.int64), "right")).astype("int32")

    lowest = F.lit(-(1 << 63))
    dealt = both.repartitionById(len(bounds) + 1, shard(F.coalesce("page_id", lowest))).sortWithinPartitions("page_id", "kind", "html")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        done, out, uri, size, n = [], None, "", 0, 0
        page, targets, seen = object(), {}, {}

        def close() -> None:
            out.close()
            done.append((part, len(done), uri, size, n))

        for batch in batches:
            for page_id, kind, url, html, sha1, response_id in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if page_id != page:
                    page, targets, seen = page_id, {}, {}
                if kind == 0:
                    targets[sha1] = response_id
                    continue
                payload = (html or "").encode()
                raw = hashlib.sha1(payload)
                digest, of = base64.b32encode(raw.digest()).decode(), targets.get(raw.hexdigest())
                again = seen.get(digest, 0)
                seen[digest] = again + 1
                revisit = of is not None or (again > 0 and len(payload) >= least_payload)
                to = record_uri(of if of is not None else page_id, digest) if revisit else None
                data = gzip_member(record_bytes("revisit" if revisit else "response", record_uri(page_id, digest, again), url, date, digest, len(payload), payload, to))
                if out is not None and size + len(data) > file_bytes:
                    close()
                    out = None
                if out is None:
                    uri, size, n = files.join(out_dir, "_temporary", f"{part:06d}-{uuid.uuid4().hex}"), 0, 0
                    out = files.writer(uri)
                out.write(data)
                size, n = size + len(data), n + 1
        if out is not None:
            close()
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64())
        columns = list(zip(*done, strict=True)) if done else [()] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["shard", "roll", "temporary", "bytes", "records"])

    written = cut(dealt.mapInArrow(run, "shard long, roll long, temporary string, bytes long, records long"))
    manifest = [{"file": f"pages-{r['shard']:06d}-{r['roll']:04d}.warc.gz", "temporary": r["temporary"], "bytes": r["bytes"], "records": r["records"]} for r in written.orderBy("shard", "roll").collect()]
    files.write_text(files.join(out_dir, "manifest.json"), json.dumps({"files": manifest}))
    files.move_all(spark, [(m["temporary"], files.join(out_dir, m["file"])) for m in manifest])
    files.remove_dir(files.join(out_dir, "_temporary"))  # what lost attempts left
    files.write_text(files.join(out_dir, "_SUCCESS"), "")
    return manifest


def read_warc(spark: SparkSession, out_dir: str) -> DataFrame:
    """(page_id, url, payload_bytes, payload_digest, record_type, refers_to) of each record that the manifest's files hold.

    Both figures are those of the full payload, which a revisit's record names. A response's payload and
    every block are checked against their digests.
    """
    names = [m["file"] for m in json.loads(files.read_text(files.join(out_dir, "manifest.json")))["files"]]

    def page_of(uri: str) -> int | None:
        known = uri.strip("<>").split(":")[2]
        return int(known) if known else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64())
        for batch in batches:
            for name in batch.column(0).to_pylist():
                with files.reader(files.join(out_dir, name)) as raw:
                    rows = []
                    for h, block in read_records(raw):
                        http, _, payload = block.partition(b"\r\n\r\n")
                        size = int(http.rsplit(b"Content-Length: ", 1)[1].split(b"\r\n")[0])
                        digest = h["WARC-Payload-Digest"].removeprefix("sha1:")
                        if h["WARC-Block-Digest"] != f"sha1:{sha1_base32(block)}" or (h["WARC-Type"] == "response" and (len(payload) != size or sha1_base32(payload) != digest)):
                            raise ValueError(f"{name}: {h['WARC-Record-ID']} doesn't match its digests")
                        rows.append((page_of(h["WARC-Record-ID"]), h["WARC-Target-URI"], size, digest, h["WARC-Type"], page_of(h["WARC-Refers-To"]) if "WARC-Refers-To" in h else None))
                        if len(rows) == 1000:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=fields)
                            rows = []
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=fields)

    fields = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    listed = spark.createDataFrame([(n,) for n in names], "file string").repartition(max(1, len(names)))
    return listed.mapInArrow(run, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long")
