"""Files in the shared folder, opened inside tasks by URI (local paths, HDFS and object stores alike)."""

from __future__ import annotations

import posixpath
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession


def at(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri)


def join(uri: str, *names: str) -> str:
    return "/".join([uri.rstrip("/"), *names])


def make_dir(uri: str) -> None:
    store, path = at(uri)
    store.create_dir(path, recursive=True)


def writer(uri: str):
    store, path = at(uri)
    store.create_dir(posixpath.dirname(path), recursive=True)
    return store.open_output_stream(path)


def reader(uri: str):
    store, path = at(uri)
    return store.open_input_file(path)


def read_text(uri: str) -> str:
    with reader(uri) as f:
        return f.read().decode()


def write_text(uri: str, text: str) -> None:
    with writer(uri) as f:
        f.write(text.encode())


def move(source: str, target: str) -> None:
    """Rename; done already (by an attempt before) counts as done."""
    store, path = at(source)
    to = at(target)[1]
    if store.get_file_info(path).type == fs.FileType.NotFound and store.get_file_info(to).type != fs.FileType.NotFound:
        return
    store.create_dir(posixpath.dirname(to), recursive=True)
    store.move(path, to)


def move_all(spark: SparkSession, pairs: list[tuple[str, str]], at_once: int = 64) -> None:
    """Rename the sources to the targets in tasks of ``at_once`` files; a task that runs again finds them done."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for source, target in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                move(source, target)
            yield batch

    if pairs:
        spark.createDataFrame(pairs, "source string, target string").repartition(-(-len(pairs) // at_once)).mapInArrow(run, "source string, target string").count()


def remove_dir(uri: str) -> None:
    store, path = at(uri)
    if store.get_file_info(path).type != fs.FileType.NotFound:
        store.delete_dir(path)
