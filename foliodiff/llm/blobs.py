"""Packed exchange: tasks hand one another numpy arrays, compressed, as binary columns of ordinary shuffles.

A map task cuts what it reads into blocks of documents, and within a block reduces equal keys, so a key that a third of
all rows share leaves each block once. Rows of the exchange are (bucket, block, kind, payload):

    kind ASK    entries of one bucket of keys, from one block
    kind KNOWN  what the block could decide alone; passes through
    kind DOCS   the keys (d1, d2) of the block's documents; passes through

A block's name is its task's partition and its number there, so inputs must come in the same order when a task runs
again: a scan of files or tables does, and so does a sorted input.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from .words import mix

ASK, KNOWN, DOCS = 0, 1, 2
SCHEMA = "bucket int, block long, kind int, payload binary"
NAMES = ["bucket", "block", "kind", "payload"]
#: Entries that a task holds before it ends a block.
BLOCK = 2_000_000
#: Bytes that pass between the JVM and Python at once, less than a piece of text (see words).
MESSAGE = 3 << 20
NO_ID = -(2**63)


def doc_keys(doc_id: Column, text: Column) -> tuple[Column, Column]:
    """(d1, d2): the id, nulls first, and a hash of the text, so that rows of one id and other text stay apart."""
    return F.coalesce(doc_id.cast("long"), F.lit(NO_ID)), F.xxhash64(F.coalesce(text, F.lit("")))


def release() -> None:
    """Gives freed memory back: Python workers live on between tasks, and share their executor's memory with the JVM."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # another C library
        pass


def frugal(run: Callable[[pa.Table], pa.Table]) -> Callable[[pa.Table], pa.Table]:
    """run, with memory given back before and after: a worker that waits holds none that the next stage needs."""

    def lean(group: pa.Table) -> pa.Table:
        release()
        found = run(group)
        release()
        return found

    return lean


def each(group: pa.Table, *names: str) -> Iterator[tuple]:
    """The rows of a group, one at a time: its payloads are not copied all at once."""
    columns = [group.column(n) for n in names]
    for i in range(group.num_rows):
        yield tuple(c[i].as_py() for c in columns)


def pack(*arrays: np.ndarray) -> bytes:
    head = ";".join(f"{a.dtype.str},{len(a)}" for a in arrays).encode() + b"\n"
    packer = zstandard.ZstdCompressor(level=1).compressobj(size=len(head) + sum(a.nbytes for a in arrays))
    told = [packer.compress(head), *(packer.compress(memoryview(np.ascontiguousarray(a)).cast("B")) for a in arrays if len(a)), packer.flush()]
    return b"".join(told)


def unpack(blob: bytes) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    at = raw.index(b"\n") + 1
    out = []
    for spec in raw[: at - 1].decode().split(";"):
        dtype, n = spec.split(",")
        out.append(np.frombuffer(raw, np.dtype(dtype), int(n), at))
        at += out[-1].nbytes
    return out


def block_name(number: int) -> int:
    return (TaskContext.get().partitionId() << 24) | number


def bucket_of(block: int, buckets: int) -> int:
    """Where a block's rows that pass through go: spread by hash, since the first blocks of all tasks have alike names."""
    return int(mix(np.array([block], np.uint64))[0] % np.uint64(buckets))


def rows(found: Iterable[tuple[int, int, int, bytes]]) -> pa.RecordBatch:
    columns = list(zip(*found, strict=True)) or [(), (), (), ()]
    types = [pa.int32(), pa.int64(), pa.int32(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], NAMES)


def messages(found: list[tuple[int, int, int, bytes]]) -> Iterator[pa.RecordBatch]:
    """rows(found) in batches of about MESSAGE bytes, so that no great buffer is made for them."""
    at = 0
    while True:
        stop, size = at, 0
        while stop < len(found) and (stop == at or size + len(found[stop][3]) <= MESSAGE):
            size += len(found[stop][3])
            stop += 1
        yield rows(found[at:stop])
        at = stop
        if at >= len(found):
            return


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Steps that run inside hand Python their rows about MESSAGE bytes at a time; by default it is up to 64 MB, in buffers outside the heap of the executor."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name, None)
    spark.conf.set(name, str(MESSAGE))
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def by_bucket(buckets: np.ndarray, n_buckets: int) -> Iterable[tuple[int, np.ndarray]]:
    """(bucket, positions of its entries in their order) for each bucket that has any."""
    order = np.argsort(buckets, kind="stable")
    ends = np.searchsorted(buckets[order], np.arange(n_buckets + 1))
    for b in range(n_buckets):
        if ends[b] < ends[b + 1]:
            yield b, order[ends[b] : ends[b + 1]]


def runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, lengths) of equal neighbours."""
    if not len(keys):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return starts, np.diff(np.append(starts, len(keys)))
