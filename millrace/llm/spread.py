"""Helpers that spread work over a cluster: shard counts, tables in the shared folder, streamed groups,
packed runs of hashes and connected components.

Hashes travel as packed ``binary`` runs, one row for a (shard, range) cell, so that Spark's rows stay few while the
values themselves are merged in numpy. Nothing here brings links, components or hashes of documents to the driver.
"""

from __future__ import annotations

import contextlib
import contextvars
import ctypes
import functools
import inspect
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of input (as stored) that one shard of documents should hold.
SHARD_BYTES = 1_000_000


def stored_bytes(df: DataFrame) -> int:
    """Spark's own estimate of the bytes behind ``df``'s leaves (file sizes); no job is run."""
    leaves = df._jdf.queryExecution().analyzed().collectLeaves()
    total = 0
    for i in range(leaves.size()):
        size = int(leaves.apply(i).stats().sizeInBytes())
        total += size if size < 1 << 60 else 0
    return total


#: Stored bytes from which small inputs are cut finer, to keep all shuffle partitions busy.
LEAST_SHARD = 256_000


def shard_count(df: DataFrame, each: int = 2, shard_bytes: int = SHARD_BYTES) -> int:
    """How many shards of about ``shard_bytes`` stored bytes to cut ``df`` into; of small inputs ``each`` a shuffle partition, if that leaves
    ``LEAST_SHARD`` bytes to each. Rows sent from shards to ranges are as many as shards times ranges at the most, so both
    follow the bytes, and ranges, which hold less for each byte, are cut coarser."""
    parts, stored = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), stored_bytes(df)
    return max(-(-stored // shard_bytes), min(each * parts, -(-stored // LEAST_SHARD)), 1)


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir); a temporary one only where it is unset and
    all work is done by this machine. A cluster without that setting is refused: its executors would not see the files."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="millrace-"))
        folder = spark.sparkContext.getCheckpointDir()
    return folder.rstrip("/")


_SCOPE: contextvars.ContextVar[str] = contextvars.ContextVar("scope", default="millrace")


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """What is settled inside the block is removed at its end; results that read it must have been written by then."""
    scope = f"millrace/{uuid.uuid4().hex}"
    token = _SCOPE.set(scope)
    try:
        yield
    finally:
        _SCOPE.reset(token)
        remove(spark, f"{shared_folder(spark)}/{scope}")


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder, wherever Spark's file systems reach."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def settle(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: cuts the lineage and survives lost executors. The
    table stays until the folder is cleared, or until the end of the ``scratch`` block that it was written in."""
    path = f"{shared_folder(df.sparkSession)}/{_SCOPE.get()}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shard_of(column: str, n: int):
    return F.pmod(F.xxhash64(F.col(column)), F.lit(n)).cast("int")


def give_back() -> None:
    """Return freed memory to the system: workers live on between groups, and the C library would keep it."""
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


def giving_back(step: Callable) -> Callable:
    """A step on tables that gives freed memory back before and after its work."""

    @functools.wraps(step)
    def run(*args):
        give_back()
        try:
            return step(*args)
        finally:
            give_back()

    # Spark counts the arguments to see whether the step takes the group's key
    run.__signature__ = inspect.signature(step)
    return run


def rows_giving_back(step: Callable) -> Callable:
    """The same for a step on a stream of batches, so that idle workers hold no memory while later stages run."""

    @functools.wraps(step)
    def run(batches):
        give_back()
        try:
            yield from step(batches)
        finally:
            give_back()

    return run


def _trim():
    try:
        return ctypes.CDLL("libc.so.6").malloc_trim
    except (OSError, AttributeError):
        return None


_TRIM = _trim()


# ---- Arrow and numpy ------------------------------------------------------------------------------------------------


def binary_column(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """A LargeBinary-free ``binary`` array whose i-th value is ``values[bounds[i]:bounds[i + 1]]`` as raw bytes."""
    values = np.ascontiguousarray(values)
    offsets = np.asarray(bounds, np.int64) * values.itemsize
    if len(offsets) and offsets[-1] > np.iinfo(np.int32).max:
        raise OverflowError(f"{int(offsets[-1])} bytes in one batch of packed runs; use more shards")
    offsets = offsets.astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(values)])


def column_bytes(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string or binary column in row order (null: empty), and each row's bounds in them."""
    array = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(array, pa.ChunkedArray):
        array = pa.concat_arrays(array.chunks) if array.num_chunks else pa.array([], pa.binary())
    if len(array) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    large = pa.types.is_large_string(array.type) or pa.types.is_large_binary(array.type)
    if array.null_count:
        array = array.fill_null(b"" if pa.types.is_binary(array.type) or pa.types.is_large_binary(array.type) else "")
    _, offsets, data = array.buffers()
    at = np.frombuffer(offsets, np.int64 if large else np.int32)[array.offset : array.offset + len(array) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, at - at[0]


def packed(column, dtype) -> tuple[np.ndarray, np.ndarray]:
    """Values of a column of packed runs, and how many each row holds."""
    raw, at = column_bytes(column)
    if raw.ctypes.data % np.dtype(dtype).itemsize:
        raw = raw.copy()
    return raw.view(dtype), np.diff(at) // np.dtype(dtype).itemsize


def long_column(column) -> tuple[np.ndarray, np.ndarray]:
    """A long column as (values, is null); nulls read as 0."""
    array = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    null = np.asarray(array.is_null())
    return np.asarray(array.fill_null(0)).astype(np.int64), null


def slices(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices of all ``starts[i] + 0 .. lengths[i] - 1``, in order."""
    lengths = np.asarray(lengths, np.int64)
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total, dtype=np.int64) + np.repeat(np.asarray(starts, np.int64) - (ends - lengths), lengths)


def gather(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """``values[starts[i]:ends[i]]`` for all i, one after another; for few long slices."""
    return np.concatenate([values[:0], *(values[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True))])


def blocks(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Stretches (from, to) of consecutive rows whose sizes sum to about ``most``."""
    tops, at = np.cumsum(sizes), 0
    while at < len(sizes):
        to = max(at + 1, int(np.searchsorted(tops, (tops[at - 1] if at else 0) + most, "right")))
        yield at, to
        at = to


def gather_slices(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray, most: int = 1 << 18) -> np.ndarray:
    """``values[slices(starts, lengths)]`` in steps, so that the indices take little memory."""
    out, at = np.empty(int(lengths.sum()), values.dtype), 0
    for a, b in blocks(lengths, most):
        part = values[slices(starts[a:b], lengths[a:b])]
        out[at : at + len(part)] = part
        at += len(part)
    return out


def range_of(values: np.ndarray, n: int) -> np.ndarray:
    """The range of ``n`` equal ones over the upper 32 bits that each uint64 hash falls in; keeps their order."""
    return ((values >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)


def cells(ranges_sorted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values of a sorted array, and the bounds of each one's run."""
    if not len(ranges_sorted):
        return np.zeros(0, np.int64), np.zeros(1, np.int64)
    first = np.flatnonzero(np.r_[True, ranges_sorted[1:] != ranges_sorted[:-1]])
    return ranges_sorted[first], np.r_[first, len(ranges_sorted)]


def streamed_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Whole groups of a partition that is sorted by ``keys``: tables of one or more complete groups each."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        change = np.zeros(batch.num_rows, bool)
        for k in keys:
            v = np.asarray(batch.column(batch.schema.get_field_index(k)))
            change[1:] |= v[1:] != v[:-1]
            if held:
                prev = held[-1]
                change[0] |= prev.column(prev.schema.get_field_index(k))[prev.num_rows - 1].as_py() != v[0]
        cut = np.flatnonzero(change)
        if not len(cut):
            held.append(batch)
            continue
        last = int(cut[-1])
        if held or last:
            yield pa.Table.from_batches([*held, batch.slice(0, last)] if last else held)
        held = [batch.slice(last)]
    if held:
        yield pa.Table.from_batches(held)


def group_bounds(table: pa.Table, keys: list[str]) -> np.ndarray:
    """Bounds of the groups of a table that is sorted by ``keys``."""
    change = np.ones(table.num_rows, bool)
    change[1:] = False
    for k in keys:
        v = np.asarray(table.column(k))
        change[1:] |= v[1:] != v[:-1]
    return np.r_[np.flatnonzero(change), table.num_rows]


def union_find(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index reachable from each of ``n`` nodes by the links (a, b): vectorised label spreading."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        while True:
            up = label[label]
            if np.array_equal(up, label):
                break
            label = up
        open_ = label[a] != label[b]
        a, b = a[open_], b[open_]
    return label


# ---- connected components -------------------------------------------------------------------------------------------


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Components of the undirected links ``edges(a, b)`` (longs): ``(node, component)`` for every linked node, where
    component is the smallest node reachable.

    Large-star and small-star steps over the links: each step is a grouped minimum (combined before the shuffle, so a
    node with very many links is no hot spot) and a join that adaptive execution can split. Each round is written to
    the shared folder; rounds grow with the logarithm of the longest chain. Null or equal ends are ignored.
    """
    links = edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).where("a <> b")
    links = settle(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    for _ in range(rounds):
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e"))
        links = settle(small.select("e.*").where("a <> b").distinct())
        now = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    star = links.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return star.unionByName(star.select(F.col("component").alias("node"), "component").distinct())


Rows = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]
