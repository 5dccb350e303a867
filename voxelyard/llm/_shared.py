"""Helpers shared by the corpus operators."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from voxelyard.sources.workdir import drop_table, new_path, shared_dir, write_table  # noqa: F401


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows and bytes of an Arrow batch between the JVM and a Python worker; with the session's own defaults, tens of MB of text are held several times over in each task.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": ("10000", "1000"), "spark.sql.execution.arrow.maxBytesPerBatch": ("67108864", "8388608")}


def small_batches(spark: SparkSession) -> None:
    """Bound what a task holds of texts: where the session has Spark's default batch sizes, it gets those of ``BATCH``; sizes that were set stay."""
    for name, (usual, own) in BATCH.items():
        if spark.conf.get(name, usual).rstrip("b") in (usual, own):
            spark.conf.set(name, own)


def partitions_for(spark: SparkSession, size: int | None, each: int = 64 << 20) -> int:
    """Partitions for so many bytes: as many as keep each within bounds, and at least the session's number."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-(size or 0) // each))


def release() -> None:
    """Give freed memory back to the system; workers are used again and would keep their peak."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def released(run: Callable) -> Callable:
    """A function over batches that gives its memory back at the end of its partition."""

    @wraps(run)
    def inner(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            release()

    return inner


def values_of(column, rows: int = 256) -> Iterator:
    """Python values of an Arrow column, converted in slices: few of a batch's texts are held twice at a time."""
    for at in range(0, len(column), rows):
        yield from column.slice(at, rows).to_pylist()


def words_of(text: str | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text as UTF-8 bytes; bytes.split() splits at exactly these characters."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


def filesystem(uri: str):
    """pyarrow's file system for a URI and the path within it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith(("/", "file:")) else f"/{uri}")


@contextmanager
def opened_for_writing(uri: str) -> Iterator:
    store, path = filesystem(uri)
    store.create_dir(path.rsplit("/", 1)[0], recursive=True)
    with store.open_output_stream(path, compression=None) as out:
        yield out


class RangeReader:
    """Reads byte ranges; keeps the files of the last few URIs open."""

    def __init__(self, keep: int = 8):
        self.keep, self.files = keep, {}

    def read(self, uri: str, offset: int, length: int) -> bytes:
        if uri not in self.files:
            if len(self.files) >= self.keep:
                self.files.pop(next(iter(self.files))).close()
            store, path = filesystem(uri)
            self.files[uri] = store.open_input_file(path)
        return self.files[uri].read_at(length, offset)
