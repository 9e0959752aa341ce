"""Substring dedup over words by seed and extend.

A window is ``length`` consecutive words ``[^\\x20\\x09-\\x0D]+`` of one document. Every word covered by a window goes, if
the window's word sequence also starts earlier (in a document with a smaller id, or before it in the same document).

1. Seeds are winnowed anchors: the least of the ``gram``-word hashes in each window. Documents are dealt to shards by id;
   shards send their distinct seeds to hash ranges, which say the seeds that occur more than once.
2. A seed's matches are extended to the left and right to every window that the seed anchors: the
   extensions travel, each distinct one once a shard with its smallest document, and meet by the hash of all their words.
3. Shards learn which extensions a smaller document holds. What covers a word is the union of its
   matching windows, so runs of matching windows are the maximal repeats of at least ``length`` words.

A seed that a third of all documents hold costs one row a shard, not one a document, and no pairs are formed.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import LongType, StringType, StructField, StructType

from millrace.llm import shards, spread, windows

LENGTH, GRAM = 20, 8
#: Stored bytes of input for each range of seeds or extensions.
RANGE = 8_000_000


def _words(shard: shards.Shard):
    raw, starts, ends, place = shards.live_docs(shard)
    begin, stop, code, doc = windows.word_tokens(raw, starts, ends)
    n = np.bincount(doc, minlength=len(starts)) if len(doc) else np.zeros(len(starts), np.int64)
    tops = np.cumsum(n)
    return raw, begin, stop, code, tops - n, tops, place


def _seeds(code, starts, ends, length, gram):
    """Runs of windows by seed, and the seeds that stand at several places."""
    parts, repeated = [], []
    for base, s, e, docs in windows.segments(starts, ends, length):
        h = windows.item_grams(code[base : base + int(e[-1])], gram) & windows.EVEN
        first, end, seed, doc = windows.runs(h, s, e, gram, length)
        parts.append((first + base, end + base, windows.scattered(seed), docs[doc]))
        # a run longer than its seed can anchor holds the seed twice; so may a short one over words that repeat
        u = np.unique(seed)
        if len(u):
            at = np.minimum(np.searchsorted(u, h), len(u) - 1)
            times = np.bincount(at[u[at] == h], minlength=len(u))
            repeated.append(windows.scattered(u[times > 1]))
    if not parts:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(0, np.uint64), z, np.zeros(0, np.uint64)
    return *(np.concatenate(x) for x in zip(*parts, strict=True)), np.unique(np.concatenate(repeated)) if repeated else np.zeros(0, np.uint64)


def _extensions(shard, seeds, length, gram):
    """Windows whose seed occurs elsewhere: (place, document, 128-bit hash of their words), and the distinct hashes in the
    order they are sent, each with its first place."""
    raw, begin, stop, code, starts, ends, place = _words(shard)
    first, end, seed, doc, _ = _seeds(code, starts, ends, length, gram)
    hit = np.isin(seed, seeds & windows.EVEN)
    first, end, doc = first[hit], end[hit], doc[hit]
    at = spread.slices(first, end - first)
    d = np.repeat(doc, end - first)
    whole = np.empty((len(at), 2), np.uint64)  # 128 bits by two independent hashes
    if len(at):
        whole[:, 0] = windows.item_grams(code, length)[at]
        whole[:, 1] = windows.item_grams(windows.mix(code ^ windows.C), length)[at]
    order = np.lexsort((at, whole[:, 1], whole[:, 0]))  # documents stand in order of id, so the first place is the earliest
    head = shards.changes(whole[order])
    which = np.empty(len(order), np.int64)
    which[order] = np.cumsum(head) - 1
    return raw, begin, stop, starts, ends, place, at, d, which, order[head], whole


def find_seeds(length, gram, id_col, text_col, n_ranges):
    def step(key, docs: pa.Table, back: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return shards.CELL.empty_table()
        copies, _, _ = shards.back_of(back)
        shard = shards.read_shard(docs, id_col, text_col, copies)
        _, _, _, code, starts, ends, place = _words(shard)
        _, _, seed, doc, repeated = _seeds(code, starts, ends, length, gram)
        # several runs of one document count as well as several documents
        return shards.cells_table(shards.unique_anchors(seed, np.arange(len(seed)), repeated), int(docs.column("__shard")[0].as_py()), n_ranges)

    return spread.giving_back(step)


SENT = pa.schema([*shards.CELL, ("__docs", pa.binary())])
SENT_DDL = shards.CELL_DDL + ", __docs binary"


def send_extensions(length, gram, id_col, text_col, n_ranges):
    def step(key, docs: pa.Table, back: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return SENT.empty_table()
        copies, seeds, _ = shards.back_of(back)
        shard = shards.read_shard(docs, id_col, text_col, copies)
        *_, place, at, d, which, sent, whole = _extensions(shard, seeds, length, gram)
        rng, bounds = spread.cells(spread.range_of(whole[sent, 0], n_ranges))
        return pa.table([pa.array(rng), pa.array(np.full(len(rng), docs.column("__shard")[0].as_py(), np.int32)), spread.binary_column(whole[sent], 2 * bounds), spread.binary_column(shard.ids[place][d[sent]], bounds)], schema=SENT)

    return spread.giving_back(step)


@spread.giving_back
def judge_extensions(table: pa.Table) -> pa.Table:
    """For each extension that a shard sent: does a smaller document hold it?"""
    return shards.judge_hashes(table)


def remove_words(length, gram, id_col, text_col, fields, keep_text):
    def step(key, docs: pa.Table, back: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return fields.empty_table()
        copies, seeds, verdict = shards.back_of(back)
        shard = shards.read_shard(docs, id_col, text_col, copies)
        raw, begin, stop, starts, ends, place, at, d, which, sent, _ = _extensions(shard, seeds, length, gram)
        # gone: a smaller document holds the window, or it starts earlier in this shard (by id; in one document by place).
        # Rows with the same id are one rank: the first place stands in one of them, and the other keeps its own first.
        ids = shard.ids[place]
        same_row = d == d[sent][which]
        gone = verdict[which].astype(bool) | (ids[d] > ids[d[sent]][which]) | (same_row & (at > at[sent][which])) if len(at) else np.zeros(0, bool)
        twin = np.flatnonzero(~gone & ~same_row) if len(at) else at
        if len(twin):
            pair = np.lexsort((at[twin], d[twin], which[twin]))
            t = twin[pair]
            gone[t[1:][(which[t][1:] == which[t][:-1]) & (d[t][1:] == d[t][:-1])]] = True
        edge = np.zeros(len(begin) + 1, np.int32)
        np.add.at(edge, at[gone], 1)
        np.add.at(edge, at[gone] + length, -1)
        cover = np.cumsum(edge[:-1]) > 0
        n_words, n_removed, kept = np.zeros(len(shard.ids), np.int64), np.zeros(len(shard.ids), np.int64), [b""] * len(shard.ids)
        data = raw.tobytes()
        for j, i in enumerate(place.tolist()):
            a, b = int(starts[j]), int(ends[j])
            c = cover[a:b]
            n_words[i], n_removed[i] = b - a, int(c.sum())
            keep_at = np.flatnonzero(~c) + a if n_removed[i] else range(a, b)
            kept[i] = b" ".join(data[p:q] for p, q in zip(begin[keep_at].tolist(), stop[keep_at].tolist(), strict=True)) if b > a else b""
        for i in np.flatnonzero(~shard.live):
            words = shard.raw[shard.starts[i] : shard.ends[i]].tobytes().split()
            if b"\x1c" in shard.raw[shard.starts[i] : shard.ends[i]].tobytes():
                words = _split(shard.raw[shard.starts[i] : shard.ends[i]])
            n_words[i] = len(words)
            if not shard.null[i] and len(words) >= length:
                n_removed[i] = len(words)
            else:
                kept[i] = b" ".join(words)
        out = docs.take(pa.array(shard.rows)).drop_columns(["__shard"])
        add = {"n_words": pa.array(n_words, pa.int64()), "n_removed": pa.array(n_removed, pa.int64()), "kept_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in kept])}
        if keep_text:
            add["kept_text"] = pa.array([x.decode("utf-8") for x in kept], pa.string())
        for name, x in add.items():
            out = out.append_column(name, x)
        return out.select(fields.names).cast(fields)

    return spread.giving_back(step)


def _split(raw: np.ndarray) -> list[bytes]:
    begin, stop, _, _ = windows.word_tokens(raw, np.zeros(1, np.int64), np.array([len(raw)]))
    data = raw.tobytes()
    return [data[p:q] for p, q in zip(begin.tolist(), stop.tolist(), strict=True)]


def remove_repeated_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM, keep: tuple[str, ...] = (), keep_text: bool = False) -> DataFrame:
    """One row a row of ``docs``: the id, columns named in ``keep``, n_words, n_removed, kept_sha256 (kept words joined
    by one space) and, with ``keep_text``, kept_text.

    A null text has no words. Rows with the same id are one rank: none loses words for another's sake. A row
    whose id is null has no rank: it is kept whole and removes nothing. An empty table gives no rows. Documents of fewer
    than ``length`` words lose nothing. Columns that are not kept may have any name.
    """
    if not 1 <= gram <= length:
        raise ValueError("gram must be from 1 to length")
    n, n_ranges = spread.shard_count(docs), spread.shard_count(docs, 1, RANGE)
    columns = list(dict.fromkeys([id_col, *keep]))
    base = docs.select(*columns, F.col(text_col).alias("__text"))
    base = base.withColumn("__shard", F.when(F.col(id_col).isNull(), F.pmod(F.xxhash64("__text"), F.lit(n)).cast("int")).otherwise(F.pmod(F.xxhash64(F.col(id_col).cast("long")), F.lit(n)).cast("int")))
    copies = shards.copies_of_earlier(docs, id_col, text_col, n)
    parts = base.groupBy("__shard")
    cells = parts.cogroup(copies.groupBy("__shard")).applyInArrow(find_seeds(length, gram, id_col, "__text", n_ranges), shards.CELL_DDL)
    back = copies.unionByName(cells.groupBy("__range").applyInArrow(shards.anchors_elsewhere(), shards.BACK_DDL))
    sent = parts.cogroup(back.groupBy("__shard")).applyInArrow(send_extensions(length, gram, id_col, "__text", n_ranges), SENT_DDL)
    final = back.unionByName(sent.groupBy("__range").applyInArrow(judge_extensions, shards.BACK_DDL))
    schema = StructType([*base.select(*columns).schema.fields, StructField("n_words", LongType()), StructField("n_removed", LongType()), StructField("kept_sha256", StringType()), *([StructField("kept_text", StringType())] if keep_text else [])])
    return parts.cogroup(final.groupBy("__shard")).applyInArrow(remove_words(length, gram, id_col, "__text", to_arrow_schema(schema), keep_text), schema)
