"""Shards of documents for the substring operators: reading them, exact copies, and which anchors occur elsewhere."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm import spread
from millrace.llm.spread import column_bytes, long_column

#: Shards that may send their runs of one anchor to one group; the windows of more common anchors are dealt one by one.
COMMON = 256
CELL = pa.schema([("__range", pa.int64()), ("__shard", pa.int32()), ("__values", pa.binary())])
CELL_DDL = "__range long, __shard int, __values binary"
#: What is sent back to a shard. kind 0: packed anchors that occur elsewhere; 1: a document (at) that is a copy of an
#: earlier one, with its digest; 2: verdicts for what the shard sent to range ``at``.
BACK_DDL = "__shard int, __kind int, __at long, __values binary"
BACK = pa.schema([("__shard", pa.int32()), ("__kind", pa.int32()), ("__at", pa.int64()), ("__values", pa.binary())])


@dataclass
class Shard:
    """Documents of one shard in order of id (then text), as one buffer; rows without id come last."""

    rows: np.ndarray  # places in the table that was read
    ids: np.ndarray
    null: np.ndarray
    raw: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    live: np.ndarray  # takes part: has an id and is no copy of an earlier document


def read_shard(table: pa.Table, id_col: str, text_col: str, copies: tuple[np.ndarray, list[bytes]]) -> Shard:
    """copies: ids of documents that are copies of an earlier one, and the digest of each. Of several rows with one id only those with
    that digest are copies."""
    ids, null = long_column(table.column(id_col))
    raw, at = column_bytes(table.column(text_col))
    order = np.lexsort((ids, null))
    tie = np.flatnonzero((ids[order][1:] == ids[order][:-1]) & (null[order][1:] == null[order][:-1]))
    if len(tie):
        text = [raw[at[i] : at[i + 1]].tobytes() for i in range(len(ids))]
        order = np.array(sorted(range(len(ids)), key=lambda i: (null[i], ids[i], text[i])), np.int64)
    lengths = np.diff(at)[order]
    ends = np.cumsum(lengths)
    raw = spread.gather(raw, at[:-1][order], at[1:][order])
    ids, null = ids[order], null[order]
    live = ~null & ~np.isin(ids, copies[0])
    if len(tie):
        several = np.isin(ids, ids[tie + 1]) & ~live & ~null
        known = set(zip(copies[0].tolist(), copies[1], strict=True))
        for i in np.flatnonzero(several).tolist():
            digest = hashlib.md5(raw[ends[i] - lengths[i] : ends[i]].tobytes(), usedforsecurity=False).hexdigest().encode()
            live[i] = (int(ids[i]), digest) not in known
    return Shard(order, ids, null, raw, ends - lengths, ends, live)


def back_of(table: pa.Table) -> tuple[tuple[np.ndarray, list[bytes]], np.ndarray, np.ndarray]:
    """From what was sent back: copies with their digests, the sorted anchors that occur elsewhere (those that are common with the low bit
    set), and the verdicts in order of range."""
    kind = np.asarray(table.column("__kind"))
    at = np.asarray(table.column("__at"))
    if not len(kind):
        return (at, []), np.zeros(0, np.uint64), np.zeros(0, np.uint8)
    copies = at[kind == 1], table.filter(pa.array(kind == 1)).column("__values").to_pylist()
    anchors, _ = spread.packed(table.filter(pa.array(kind == 0)).column("__values"), np.uint64)
    said = table.filter(pa.array(kind == 2))
    said = said.take(pa.array(np.argsort(np.asarray(said.column("__at")), kind="stable")))
    return copies, np.sort(anchors), column_bytes(said.column("__values"))[0]


def live_docs(shard: Shard) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The shard's live documents moved together: (buffer, starts, ends, place in the shard)."""
    live = np.flatnonzero(shard.live)
    lengths = shard.ends[live] - shard.starts[live]
    ends = np.cumsum(lengths)
    raw = shard.raw if len(live) == len(shard.ids) else spread.gather(shard.raw, shard.starts[live], shard.ends[live])
    return raw, ends - lengths, ends, live


def copies_of_earlier(docs: DataFrame, id_col: str, text_col: str, n_shards: int) -> DataFrame:
    """Documents whose whole text equals that of a document with a smaller id, as rows to send back.

    Digests are grouped with a combine before the shuffle, so a huge group of copies is one row a task; the join back
    on the digest is one that adaptive execution splits when a digest is hot.
    """
    seen = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("__at"), F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary")).alias("__digest"))
    first = seen.groupBy("__digest").agg(F.min("__at").alias("__first"), F.max("__at").alias("__last")).where("__first < __last")
    again = seen.join(first, "__digest").where("__at > __first")
    return again.select(spread.shard_of("__at", n_shards).alias("__shard"), F.lit(1).alias("__kind"), "__at", F.col("__digest").cast("binary").alias("__values"))


def cells_table(values: np.ndarray, shard: int, n_ranges: int, bounds_of=None) -> pa.Table:
    """One row for each range that the sorted hashes ``values`` touch."""
    rng, bounds = spread.cells(spread.range_of(values, n_ranges))
    return pa.table([pa.array(rng), pa.array(np.full(len(rng), shard, np.int32)), spread.binary_column(values, bounds)], schema=CELL)


def anchors_elsewhere(common: int = COMMON):
    """The step that merges the anchors of one range."""
    return spread.giving_back(lambda table: _elsewhere(table, common))


def _elsewhere(table: pa.Table, common: int) -> pa.Table:
    """Merge the sorted anchor runs of one range: send to each shard those of its anchors that occur more than once.

    An anchor's low bit says that its own shard already holds it more than once; in what is sent back it says that the anchor
    is common, i.e. that more than ``common`` shards hold it.
    """
    values, counts = spread.packed(table.column("__values"), np.uint64)
    shard = np.repeat(np.asarray(table.column("__shard")), counts)
    at = int(table.column("__range")[0].as_py())
    key = values & np.uint64(0xFFFFFFFFFFFFFFFE)
    order = np.argsort(key, kind="stable")
    k = key[order]
    first = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
    size = np.diff(np.r_[first, len(k)])
    many = (size > 1) | (np.maximum.reduceat(values[order] & np.uint64(1), first) > 0)
    keep = np.repeat(many, size)
    k, s = (k | np.repeat(size > common, size).astype(np.uint64))[keep], shard[order][keep]
    by = np.argsort(s, kind="stable")
    who, bounds = spread.cells(s[by].astype(np.int64))
    return pa.table([pa.array(who.astype(np.int32)), pa.array(np.zeros(len(who), np.int32)), pa.array(np.full(len(who), at, np.int64)), spread.binary_column(k[by], bounds)], schema=BACK)


def changes(rows: np.ndarray) -> np.ndarray:
    """Where rows of a sorted table of hashes differ from the one before; true for the first."""
    head = np.ones(len(rows), bool)
    head[1:] = (rows[1:] != rows[:-1]).any(axis=1)
    return head


def judge_hashes(table: pa.Table) -> pa.Table:
    """Rows (range, shard, packed 128-bit hashes, packed documents) of one range: for each hash, does a smaller document hold it?"""
    whole = spread.packed(table.column("__values"), np.uint64)[0].reshape(-1, 2)
    doc, counts = spread.packed(table.column("__docs"), np.int64)
    order = np.lexsort((doc, whole[:, 1], whole[:, 0]))
    head = changes(whole[order])
    least = np.empty(len(order), np.int64)
    least[order] = doc[order][head][np.cumsum(head) - 1]
    bounds = np.r_[0, np.cumsum(counts)]
    n = table.num_rows
    return pa.table([table.column("__shard").cast(pa.int32()), pa.array(np.full(n, 2, np.int32)), table.column("__range"), spread.binary_column((least < doc).astype(np.uint8), bounds)], schema=BACK)


def unique_anchors(values: np.ndarray, doc: np.ndarray, repeat_in_doc: np.ndarray | None = None) -> np.ndarray:
    """Sorted distinct anchors of a shard; the low bit is set for those of more than one document (or, if given, for
    those in ``repeat_in_doc``)."""
    order = np.argsort(values, kind="stable")
    v, d = values[order], doc[order]
    first = np.flatnonzero(np.r_[True, v[1:] != v[:-1]]) if len(v) else np.zeros(0, np.int64)
    if not len(first):
        return v
    many = np.minimum.reduceat(d, first) != np.maximum.reduceat(d, first)
    u = v[first]
    if repeat_in_doc is not None and len(repeat_in_doc):
        many |= np.isin(u, repeat_in_doc)
    return u | many.astype(np.uint64)
