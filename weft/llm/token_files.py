"""Token ids in fixed-width bit-packed files with block offsets.

A file is: a 16-byte header (magic, version, bits an id, ids a block), the blocks, then the blocks' byte
offsets, the documents' ids and first positions, and last the byte where these tables begin, the number
of ids and the number of documents, which a stream knows only at its end. Each block holds the same number of ids (the last may hold fewer),
each id in the fewest bits that the vocabulary needs, lowest bit first; a block begins on a byte, so any
id is found by one seek and one vectorised unpacking.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import files
from .base import cut
from .tokens import encoder, text_groups

_HEAD = struct.Struct("<4sHHI4x")
BLOCK_IDS = 8192
#: Ids after which a task begins its next file (512 MB at 16 bits).
FILE_IDS = 1 << 28
#: Bytes of text of a range partition.
PARTITION_BYTES = 64 << 20


def bits_for(vocabulary: int) -> int:
    return max(1, int(vocabulary - 1).bit_length())


def pack_bits(ids: np.ndarray, bits: int) -> bytes:
    if len(ids) and int(ids.max()) >> bits:
        raise ValueError(f"id {ids.max()} doesn't fit in {bits} bits")
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    flags = (ids.astype(np.uint32)[:, None] >> np.arange(bits, dtype=np.uint32)) & 1
    return np.packbits(flags.astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpack_bits(data: bytes, bits: int, n: int) -> np.ndarray:
    if bits in (8, 16, 32):
        return np.frombuffer(data, f"<u{bits // 8}", n).astype("<u4")
    flags = np.unpackbits(np.frombuffer(data, np.uint8), count=n * bits, bitorder="little").reshape(n, bits)
    return (flags.astype(np.uint32) << np.arange(bits, dtype=np.uint32)).sum(axis=1, dtype=np.uint32).astype("<u4")


class TokenFileWriter:
    """Appends documents; holds at most one block and the tables."""

    def __init__(self, uri: str, bits: int, block_ids: int = BLOCK_IDS):
        self.uri, self.bits, self.block_ids = uri, bits, block_ids
        self.out = files.writer(uri)
        self.pending = np.zeros(0, "<u4")
        self.offsets, self.docs, self.starts, self.n = [], [], [], 0
        self.place = _HEAD.size
        self.out.write(_HEAD.pack(b"WTK2", 2, bits, block_ids))

    def _block(self, ids: np.ndarray) -> None:
        data = pack_bits(ids, self.bits)
        self.offsets.append(self.place)
        self.out.write(data)
        self.place += len(data)

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append(doc_id)
        self.starts.append(self.n)
        self.n += len(ids)
        self.pending = np.concatenate((self.pending, ids))
        whole = len(self.pending) // self.block_ids * self.block_ids
        for a in range(0, whole, self.block_ids):
            self._block(self.pending[a : a + self.block_ids])
        self.pending = self.pending[whole:].copy() if whole else self.pending

    def close(self) -> None:
        if len(self.pending):
            self._block(self.pending)
        known = np.array([d is not None for d in self.docs], np.uint8)
        for table in (np.array(self.offsets, "<u8"), np.array([d or 0 for d in self.docs], "<i8"), known, np.array([*self.starts, self.n], "<u8")):
            self.out.write(table.tobytes())
        self.out.write(struct.pack("<QQQ", self.place, self.n, len(self.docs)))
        self.out.close()


class TokenFileReader:
    """ids(a, b) reads any stretch by seeking to its blocks; doc_ids and starts are the tables."""

    def __init__(self, uri: str):
        self.file = files.reader(uri)
        magic, _, self.bits, self.block_ids = _HEAD.unpack(self.file.read(_HEAD.size))
        if magic != b"WTK2":
            raise ValueError(f"no token file: {uri}")
        size = self.file.size()
        self.file.seek(size - 24)
        self.tables, self.n, docs = struct.unpack("<QQQ", self.file.read(24))
        self.file.seek(self.tables)
        blocks = -(-self.n // self.block_ids)
        self.offsets = np.append(np.frombuffer(self.file.read(8 * blocks), "<u8"), self.tables)
        ids, known = np.frombuffer(self.file.read(8 * docs), "<i8"), self.file.read(docs)
        self.doc_ids = [int(i) if k else None for i, k in zip(ids, known, strict=True)]
        self.starts = np.frombuffer(self.file.read(8 * (docs + 1)), "<u8").astype(np.int64)

    def ids(self, a: int, b: int) -> np.ndarray:
        if a >= b:
            return np.zeros(0, "<u4")
        x, y = a // self.block_ids, (b - 1) // self.block_ids
        self.file.seek(int(self.offsets[x]))
        data = self.file.read(int(self.offsets[y + 1] - self.offsets[x]))
        parts = []
        for k in range(x, y + 1):
            n = min(self.block_ids, self.n - k * self.block_ids)
            base = int(self.offsets[k] - self.offsets[x])
            parts.append(unpack_bits(data[base : base + int(self.offsets[k + 1] - self.offsets[k])], self.bits, n))
        return np.concatenate(parts)[a - x * self.block_ids : b - x * self.block_ids]

    def close(self) -> None:
        self.file.close()


def write_token_files(docs: DataFrame, out_dir: str, tokenizer_path: str, end_id: int, vocabulary: int | None = None) -> list[dict]:
    """Encode every text, write the ids in ascending doc_id order, and return the manifest's rows in that order.

    Rows go through one range exchange by doc_id; each task streams its sorted rows into files under
    temporary names. The manifest is written to the shared folder before the files take their last names, and
    names are taken from it alone: what a lost or repeated attempt left is never read. A null doc_id
    comes first, repeated doc_ids are ordered by text; a null text is empty and has only the end id.
    vocabulary is the number of ids, the tokenizer's own by default; a larger id is an error, never cut.
    """
    spark = docs.sparkSession
    vocabulary = vocabulary or max(encoder(tokenizer_path).tokenizer.get_vocab_size(), end_id + 1)
    bits = bits_for(vocabulary)
    files.make_dir(out_dir)
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    total = narrow.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // PARTITION_BYTES))
    dealt = narrow.repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, enc, end = TaskContext.get().partitionId(), encoder(tokenizer_path), np.array([end_id], "<u4")
        done, w = [], None

        def close() -> None:
            w.close()
            done.append((part, len(done), w.uri, w.n, len(w.docs)))

        for batch in batches:
            ids = batch.column(0).to_pylist()
            for at, texts in text_groups(batch.column(1).to_pylist()):
                for i, raw in enumerate(enc.encode(texts)):
                    if w is not None and w.n >= FILE_IDS:
                        close()
                        w = None
                    if w is None:
                        w = TokenFileWriter(files.join(out_dir, "_temporary", f"{part:06d}-{uuid.uuid4().hex}"), bits)
                    w.add(ids[at + i], np.concatenate((np.frombuffer(raw, "<u4"), end)))
        if w is not None:
            close()
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64()), strict=True)] if done else [pa.array([], t) for t in (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64())], names=["part", "file", "temporary", "n_ids", "n_docs"])

    written = cut(dealt.mapInArrow(run, "part long, file long, temporary string, n_ids long, n_docs long"))
    manifest, start = [], 0
    for k, r in enumerate(written.orderBy("part", "file").collect()):  # a row for each file
        manifest.append({"file": f"tokens-{k:06d}.wtk", "temporary": r["temporary"], "start": start, "n_ids": r["n_ids"], "n_docs": r["n_docs"]})
        start += r["n_ids"]
    files.write_text(files.join(out_dir, "manifest.json"), json.dumps({"bits": bits, "vocabulary": vocabulary, "block_ids": BLOCK_IDS, "files": manifest}))
    files.move_all(spark, [(m["temporary"], files.join(out_dir, m["file"])) for m in manifest])
    files.remove_dir(files.join(out_dir, "_temporary"))  # what lost attempts left
    files.write_text(files.join(out_dir, "_SUCCESS"), "")
    return manifest


def read_token_files(spark: SparkSession, out_dir: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, read from the files that the manifest names."""
    manifest = json.loads(files.read_text(files.join(out_dir, "manifest.json")))["files"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                r = TokenFileReader(files.join(out_dir, name))
                for a in range(0, len(r.doc_ids), 1000):
                    b = min(a + 1000, len(r.doc_ids))
                    sums = [zlib.crc32(r.ids(int(r.starts[i]), int(r.starts[i + 1])).tobytes()) for i in range(a, b)]
                    yield pa.RecordBatch.from_arrays([pa.array(r.doc_ids[a:b], pa.int64()), pa.array(r.starts[a:b] + start), pa.array(np.diff(r.starts[a : b + 1])), pa.array(sums, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])
                r.close()

    rows = spark.createDataFrame([(m["file"], m["start"]) for m in manifest], "file string, start long").repartition(max(1, len(manifest)))
    return rows.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
