"""Substring dedup over bytes by suffix arrays.

Every byte that a string of ``length`` bytes covers goes, if that string also starts in a document with a smaller id.

1. Documents are dealt to shards by id. Each shard finds the anchors of its windows (see ``windows``) and sends them to
   hash ranges; a range says which anchors occur in other documents too. Only runs with such an anchor can repeat.
2. Each shard sends those runs, each distinct one once with its smallest document id, to the anchor's range. Runs of a
   common anchor would all meet in one group; their strings are classed by the shard's own suffix array instead, and each
   class goes alone to the range of its hash.
3. A range holds every place of the strings with its anchors. It cuts its runs into suffix shards of bounded size, builds a
   suffix array for each by Larsson-Sadakane refinement (groups of equal prefixes are split by the rank of what
   follows, doubling the depth, up to ``length`` bytes), takes common prefixes by Kasai's rule, and reads off classes of equal strings.
   Suffix shards of the same range are merged by binary search in each other's suffix order, by the bytes themselves.
4. Verdicts go back to the document shards, which remove the covered bytes.

The documents' exchange is the same in each step and is reused. Exact copies of whole texts are settled before: the
first document speaks for them. No pair of documents is ever formed.
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
from millrace.llm.windows import U

LENGTH, GRAM = 50, 20
INDEX_BITS = 20
#: Bytes of one suffix shard: two ranks and a place sort as one 64-bit integer.
SUFFIX_SHARD = 1 << INDEX_BITS
#: Stored bytes of input for each range of anchors, and of runs.
ANCHOR_RANGE, TEXT_RANGE = 16_000_000, 4_000_000
FAR = np.iinfo(np.int64).max


# ---- suffix arrays --------------------------------------------------------------------------------------------------


def suffix_array(raw: np.ndarray, depth: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """(places in order of the first ``depth`` bytes from each, rank of each place's group of equal prefixes).

    Larsson-Sadakane: start from groups by five bytes; then sort only groups of more than one by the rank of the
    suffix that begins where their known prefix ends, which doubles the depth known. Beyond the end of ``raw`` stand zeros.
    """
    n = len(raw)
    if n > SUFFIX_SHARD:
        raise ValueError(f"a suffix shard holds {SUFFIX_SHARD} bytes at most")
    shift, low = U(INDEX_BITS), U(SUFFIX_SHARD - 1)
    key = windows.words64(raw)[:n].byteswap() >> U(24)
    key <<= shift
    key |= np.arange(n, dtype=np.uint64)
    key.sort()
    sa = (key & low).astype(np.int32)
    head = np.empty(n, bool)
    if n:
        head[0] = True
    key >>= shift
    np.not_equal(key[1:], key[:-1], out=head[1:])
    slot = np.maximum.accumulate(np.where(head, np.arange(n, dtype=np.int32), 0)) if n else np.zeros(0, np.int32)
    rank = np.empty(n + 1, np.int32)
    rank[n] = 0
    rank[sa] = slot
    ranks, known = {5: rank.copy()}, 5
    while known < depth:
        step = known if 2 * known <= depth else next((h for h in sorted(ranks) if known + h >= depth), known)
        other = ranks.get(step, rank) if step != known else rank
        single = head & np.r_[head[1:], True]
        at = np.flatnonzero(~single)
        if len(at):
            i = sa[at]
            nxt = i.astype(np.int64) + known
            follow = np.where(nxt < n, other[np.minimum(nxt, n)].astype(np.int64) + 1, 0)
            key = rank[i].astype(np.uint64)
            key <<= U(INDEX_BITS + 1)
            key |= follow.astype(np.uint64)
            key <<= shift
            key |= i.astype(np.uint64)
            key.sort()
            i = (key & low).astype(np.int32)
            key >>= shift
            sa[at] = i
            new = np.empty(len(at), bool)
            new[0] = True
            np.not_equal(key[1:], key[:-1], out=new[1:])
            head[at] = new
            group = np.maximum.accumulate(np.where(new, at, 0)).astype(np.int32)
            fresh = rank.copy()
            fresh[i] = group
            rank = fresh
        known += step
        ranks[known] = rank
    return sa, rank[:n]


def common_prefixes(raw: np.ndarray, sa: np.ndarray, cap: int = LENGTH, lanes: int = 4096) -> np.ndarray:
    """Common prefix of each suffix in ``sa`` with the one before it, up to ``cap`` bytes, by Kasai's rule.

    The rule: the next place in the text shares at least one byte less with its own predecessor. It runs in many
    lanes, each over a stretch of the text, comparing eight bytes at a time. Where the cap was reached, order beyond
    it is unknown, so the next place starts from zero.
    """
    n = len(sa)
    out = np.zeros(n, np.int32)
    if n < 2:
        return out
    before = np.empty(n, np.int64)
    before[sa[1:]] = sa[:-1]
    before[sa[0]] = -1
    word = windows.words64(raw, cap + 16)
    lanes = max(1, min(lanes, n // 64))
    step = -(-n // lanes)
    place = np.arange(lanes, dtype=np.int64) * step
    shared = np.zeros(lanes, np.int64)
    by_place = np.zeros(lanes * step, np.int32)
    before = np.concatenate([before, np.full(lanes * step - n, -1)])
    low = U(1)
    for t in range(step):
        i = place + t
        j = before[i]
        shared = np.where((j < 0) | (shared >= cap), 0, np.maximum(shared - 1, 0))
        act = np.flatnonzero(j >= 0)
        while len(act):
            h = shared[act]
            x = word[i[act] + h] ^ word[j[act] + h]
            # lowest differing byte: isolate the lowest set bit, whose exponent is exact as a float
            bit = x & (~x + low)
            same = np.where(x == 0, 8, (np.frexp(bit.astype(np.float64))[1] - 1) >> 3)
            h = np.minimum(h + same, cap)
            shared[act] = h
            act = act[(x == 0) & (h < cap)]
        by_place[i] = shared
    room = n - np.arange(n)
    return np.minimum(by_place[:n], room)[sa].astype(np.int32)


def window_classes(raw: np.ndarray, valid: np.ndarray, doc: np.ndarray, length: int):
    """Classes of equal strings at the ``valid`` places of a suffix shard: (class of each place, least doc of each class, a place of each)."""
    sa, _ = suffix_array(raw, length)
    shared = common_prefixes(raw, sa, length)
    head = shared < length
    head[:1] = True
    number = np.cumsum(head) - 1
    cls = np.empty(len(raw), np.int64)
    cls[sa] = number
    first = np.flatnonzero(head)
    d = np.where(valid, doc, FAR)[sa]
    least = np.minimum.reduceat(d, first)
    # a valid place of each class, for its key in merging
    p = np.where(valid, np.arange(len(raw)), FAR)[sa]
    return cls, least, np.minimum.reduceat(p, first)


def strings(raw: np.ndarray, places: np.ndarray, length: int) -> np.ndarray:
    """The ``length`` bytes from each place, as byte strings that compare like them (all are of one length, so the zeros that end a
    string may be left out of the comparison)."""
    rows = np.lib.stride_tricks.sliding_window_view(raw, length)[places]
    return np.ascontiguousarray(rows).view(f"S{length}").ravel()


def least_documents(raw: np.ndarray, starts: np.ndarray, lens: np.ndarray, doc: np.ndarray, group: np.ndarray, length: int, size: int = SUFFIX_SHARD) -> np.ndarray:
    """For every window of each run (a slice of ``raw``), the least document among all runs that hold the same string.

    group: equal for runs that may share a string, rising. Suffix shards are cut between groups where that is possible; only those that
    cut a large group are merged."""
    out = np.empty(int((lens - length + 1).sum()), np.int64)
    at = np.r_[0, np.cumsum(lens - length + 1)]
    parts, tops = [], starts + lens
    a = 0
    while a < len(starts):
        b = max(a + 1, int(np.searchsorted(tops, starts[a] + size, "right")))
        if b < len(starts) and group[b - 1] == group[b]:
            b = max(int(np.searchsorted(group, group[b])), a) if group[a] != group[b] else b
        cut = (a > 0 and group[a - 1] == group[a]) or (b < len(starts) and group[b - 1] == group[b])
        base, stop = starts[a], starts[b - 1] + lens[b - 1]
        text = raw[base:stop]
        where = spread.slices(starts[a:b] - base, lens[a:b] - length + 1)
        valid = np.zeros(len(text), bool)
        valid[where] = True
        d = np.zeros(len(text), np.int64)
        d[where] = np.repeat(doc[a:b], lens[a:b] - length + 1)
        cls, least, place = window_classes(text, valid, d, length)
        used = np.flatnonzero(least < FAR)  # classes are numbered in suffix order
        key = strings(text, place[used], length) if cut else None
        number = np.zeros(len(least), np.int32)
        number[used] = np.arange(len(used), dtype=np.int32)
        parts.append((at[a], at[b], group[a], group[b - 1], number[cls[where]], least[used], key))
        a = b
    if len(parts) > 1:  # merge: look each class up by its bytes in the suffix order of the other suffix shards
        for i, (_, _, low, high, _, least, key) in enumerate(parts):
            for j, (_, _, from_, to, _, theirs, other) in enumerate(parts):
                if (j < i and to == low) or (j > i and from_ == high):
                    found = np.minimum(np.searchsorted(other, key), len(other) - 1)
                    hit = other[found] == key
                    least[hit] = np.minimum(least[hit], theirs[found[hit]])
    for i in range(len(parts)):
        lo, hi, _, _, cls, least, _ = parts[i]
        parts[i] = None
        out[lo:hi] = least[cls]
    return out


# ---- steps of the operator ------------------------------------------------------------------------------------------


def _runs(raw, starts, ends, length, gram):
    """Runs of all documents: first window, end of windows, anchor, document, hash of the bytes that the run covers."""
    parts = [[], [], [], [], []]
    for base, s, e, docs in windows.segments(starts, ends, length):
        piece = raw[base : base + int(e[-1])]
        first, end, anchor, doc = windows.runs(windows.byte_grams(piece, gram), s, e, gram, length)
        for have, x in zip(parts, (first + base, end + base, windows.scattered(anchor), docs[doc], windows.span_hashes(piece, first, end + length - 1)), strict=True):
            have.append(x)
    kinds = (np.int64, np.int64, np.uint64, np.int64, np.uint64)
    return [np.concatenate(x) if x else np.zeros(0, k) for x, k in zip(parts, kinds, strict=True)]


class Chosen:
    """The shard's runs whose anchor occurs elsewhere.

    Runs of anchors that few shards hold: ``which`` says the distinct run that each of them is, ``sent`` the distinct ones in
    the order they are sent in. Runs of common anchors are taken apart: ``cls`` says the class of equal strings of each of
    their windows (by the shard's own suffix array), ``least`` each class's least document here, ``key`` its 128-bit hash,
    in the order of which classes are sent.
    """

    def __init__(self, shard, anchors, length, gram):
        self.raw, starts, ends, self.place = shards.live_docs(shard)
        first, end, anchor, doc, content = _runs(self.raw, starts, ends, length, gram)
        some = np.isin(anchor, anchors & windows.EVEN)
        common = np.isin(anchor, anchors[(anchors & U(1)).astype(bool)] & windows.EVEN)
        ids = shard.ids[self.place]
        hit = some & ~common
        self.first, self.end, self.anchor, content = first[hit], end[hit], anchor[hit], content[hit]
        self.ids = ids[doc[hit]]
        order = np.lexsort((self.ids, content, self.anchor))
        a, c = self.anchor[order], content[order]
        head = np.r_[True, (a[1:] != a[:-1]) | (c[1:] != c[:-1])] if len(order) else np.zeros(0, bool)
        self.which = np.empty(len(order), np.int64)
        self.which[order] = np.cumsum(head) - 1
        self.sent = order[head]
        self._classes(first[common], end[common], ids[doc[common]], length)

    def _classes(self, first, end, ids, length):
        self.window = spread.slices(first, end - first)
        self.window_ids = np.repeat(ids, end - first)
        lens = end - first + length - 1
        whole, least, keys = np.empty(len(self.window), np.int64), [np.zeros(0, np.int64)], [np.zeros((0, 2), np.uint64)]
        at = n = 0
        for a, b in spread.blocks(lens, SUFFIX_SHARD):
            text = spread.gather_slices(self.raw, first[a:b], lens[a:b])
            starts = np.cumsum(lens[a:b]) - lens[a:b]
            here = spread.slices(starts, lens[a:b] - length + 1)
            valid, d = np.zeros(len(text), bool), np.zeros(len(text), np.int64)
            valid[here] = True
            d[here] = self.window_ids[at : at + len(here)]
            cls, low, p = window_classes(text, valid, d, length)
            used = np.flatnonzero(low < FAR)
            number = np.zeros(len(low), np.int64)
            number[used] = np.arange(len(used)) + n
            whole[at : at + len(here)] = number[cls[here]]
            least.append(low[used])
            keys.append(np.stack([windows.span_hashes(text, p[used], p[used] + length, seed) for seed in (0, 1)], axis=1))
            at, n = at + len(here), n + len(used)
        key, least = np.concatenate(keys), np.concatenate(least)
        order = np.lexsort((least, key[:, 1], key[:, 0]))  # equal classes of several stretches are one
        head = shards.changes(key[order])
        to = np.empty(len(order), np.int64)
        to[order] = np.cumsum(head) - 1
        self.cls, self.key, self.least = to[whole], key[order][head], least[order][head]


def find_anchors(length, gram, id_col, text_col, n_ranges):
    """The step by which a shard sends its anchors."""

    def step(key, docs: pa.Table, back: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return shards.CELL.empty_table()
        copies, _, _ = shards.back_of(back)
        shard = shards.read_shard(docs, id_col, text_col, copies)
        raw, starts, ends, place = shards.live_docs(shard)
        _, _, anchor, doc, _ = _anchors_only(raw, starts, ends, length, gram)
        return shards.cells_table(shards.unique_anchors(anchor, shard.ids[place][doc]), int(docs.column("__shard")[0].as_py()), n_ranges)

    return spread.giving_back(step)


def _anchors_only(raw, starts, ends, length, gram):
    anchor, doc = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for base, s, e, docs in windows.segments(starts, ends, length):
        _, _, v, d = windows.runs(windows.byte_grams(raw[base : base + int(e[-1])], gram), s, e, gram, length)
        anchor.append(windows.scattered(v))
        doc.append(docs[d])
    return None, None, np.concatenate(anchor), np.concatenate(doc), None


SENT = pa.schema([*shards.CELL, ("__docs", pa.binary()), ("__lens", pa.binary()), ("__anchors", pa.binary())])
SENT_DDL = shards.CELL_DDL + ", __docs binary, __lens binary, __anchors binary"


def send_runs(length, gram, id_col, text_col, n_ranges):
    """Runs go to the range of their anchor; strings of common anchors to ranges of their own, by their hash."""

    def step(key, docs: pa.Table, back: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return SENT.empty_table()
        copies, anchors, _ = shards.back_of(back)
        shard = shards.read_shard(docs, id_col, text_col, copies)
        c = Chosen(shard, anchors, length, gram)
        number, first, end = docs.column("__shard")[0].as_py(), c.first[c.sent], c.end[c.sent]
        rng, bounds = spread.cells(spread.range_of(c.anchor[c.sent], n_ranges))
        lens = end - first + length - 1
        text = spread.gather_slices(c.raw, first, lens)
        bytes_at = np.r_[0, np.cumsum(lens)][bounds]
        runs = pa.table([pa.array(rng), pa.array(np.full(len(rng), number, np.int32)), spread.binary_column(text, bytes_at), spread.binary_column(c.ids[c.sent], bounds), spread.binary_column(lens.astype(np.int32), bounds), spread.binary_column(c.anchor[c.sent].astype(np.uint32), bounds)], schema=SENT)
        rng, bounds = spread.cells(spread.range_of(c.key[:, 0], n_ranges))
        common = pa.table([pa.array(rng + n_ranges), pa.array(np.full(len(rng), number, np.int32)), spread.binary_column(c.key, 2 * bounds), spread.binary_column(c.least, bounds), *[pa.nulls(len(rng), pa.binary())] * 2], schema=SENT)
        return pa.concat_tables([runs, common])

    return spread.giving_back(step)


def judge_range(length, n_ranges):
    """Verdicts on all that was sent to one range: does a smaller document hold the string?"""

    def step(table: pa.Table) -> pa.Table:
        if int(table.column("__range")[0].as_py()) >= n_ranges:
            return shards.judge_hashes(table)
        raw, sizes = spread.packed(table.column("__values"), np.uint8)
        lens, counts = spread.packed(table.column("__lens"), np.int32)
        doc, _ = spread.packed(table.column("__docs"), np.int64)
        lens = lens.astype(np.int64)
        starts = np.cumsum(lens) - lens
        # the same run from several shards is one text, with the smallest document
        content = np.empty((len(lens), 2), np.uint64)  # 128 bits by two independent hashes
        for a, b in spread.blocks(lens, 1 << 18):
            base, stop = starts[a], starts[b - 1] + lens[b - 1]
            for seed in (0, 1):
                content[a:b, seed] = windows.span_hashes(raw[base:stop], starts[a:b] - base, starts[a:b] + lens[a:b] - base, seed)
        group, _ = spread.packed(table.column("__anchors"), np.uint32)  # part of each anchor; runs of different ones share no string
        order = np.lexsort((doc, content[:, 1], content[:, 0], group))
        head = shards.changes(content[order])
        which = np.empty(len(order), np.int64)
        which[order] = np.cumsum(head) - 1
        one = order[head]
        text = spread.gather_slices(raw, starts[one], lens[one])
        least = least_documents(text, np.cumsum(lens[one]) - lens[one], lens[one], doc[one], group[one], length)
        n_windows = lens - length + 1
        at = np.cumsum(n_windows[one]) - n_windows[one]
        mine = np.empty(int(n_windows.sum()), np.uint8)
        to = np.r_[0, np.cumsum(n_windows)]
        for a, b in spread.blocks(n_windows, 1 << 18):
            mine[to[a] : to[b]] = least[spread.slices(at[which[a:b]], n_windows[a:b])] < np.repeat(doc[a:b], n_windows[a:b])
        rows = np.r_[0, np.cumsum(counts)]
        bounds = to[rows]
        n = table.num_rows
        return pa.table([table.column("__shard").cast(pa.int32()), pa.array(np.full(n, 2, np.int32)), table.column("__range"), spread.binary_column(mine, bounds)], schema=shards.BACK)

    return spread.giving_back(step)


def remove_spans(length, gram, id_col, text_col, fields, keep_text):
    def step(key, docs: pa.Table, back: pa.Table) -> pa.Table:
        copies, anchors, verdict = shards.back_of(back)
        if not docs.num_rows:
            return fields.empty_table()
        shard = shards.read_shard(docs, id_col, text_col, copies)
        c = Chosen(shard, anchors, length, gram)
        raw, first, end, ids, which, sent, place = c.raw, c.first, c.end, c.ids, c.which, c.sent, c.place
        # windows of the sent runs, in order; then of every run; then of the strings that were sent one by one
        n_sent = end[sent] - first[sent]
        n_run = end - first
        at = (np.cumsum(n_sent) - n_sent)[which] if len(which) else which
        gone = verdict[spread.slices(at, n_run)].astype(bool)
        gone |= np.repeat(ids > ids[sent][which], n_run) if len(which) else False
        alone = verdict[int(n_sent.sum()) :][c.cls].astype(bool) | (c.window_ids > c.least[c.cls])
        window = np.concatenate([spread.slices(first, n_run)[gone], c.window[alone]])
        del c, gone, alone
        edge = np.bincount(window, minlength=len(raw) + 1).astype(np.int32)
        edge -= np.bincount(window + length, minlength=len(raw) + 1).astype(np.int32)
        covered = np.cumsum(edge[:-1], dtype=np.int32) > 0
        del window, edge
        cover = np.zeros(len(shard.raw), bool)
        at = 0
        for i in place.tolist():
            a, b = int(shard.starts[i]), int(shard.ends[i])
            cover[a:b] = covered[at : at + b - a]
            at += b - a
        for i in np.flatnonzero(~shard.live & ~shard.null):
            if shard.ends[i] - shard.starts[i] >= length:
                cover[shard.starts[i] : shard.ends[i]] = True
        n = len(shard.ids)
        n_bytes = shard.ends - shard.starts
        total = np.r_[np.int32(0), np.cumsum(cover, dtype=np.int32)]
        removed = total[shard.ends] - total[shard.starts]
        opens = cover.copy()
        opens[1:] &= ~cover[:-1]
        heads = shard.starts[(n_bytes > 0)]
        opens[heads] = cover[heads]
        total = np.r_[np.int32(0), np.cumsum(opens, dtype=np.int32)]
        spans = total[shard.ends] - total[shard.starts]
        kept = []
        for i in range(n):
            x = shard.raw[shard.starts[i] : shard.ends[i]]
            kept.append((x[~cover[shard.starts[i] : shard.ends[i]]] if removed[i] else x).tobytes())
        out = docs.take(pa.array(shard.rows)).drop_columns(["__shard"])
        add = {"n_bytes": pa.array(n_bytes, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "n_spans": pa.array(spans, pa.int64()), "kept_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in kept])}
        if keep_text:
            add["kept_text"] = pa.array([x.decode("utf-8", "ignore") for x in kept], pa.string())
        for name, x in add.items():
            out = out.append_column(name, x)
        return out.select(fields.names).cast(fields)

    return spread.giving_back(step)


def remove_repeated_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM, keep: tuple[str, ...] = (), keep_text: bool = False, common: int = shards.COMMON) -> DataFrame:
    """One row a row of ``docs``: the id, columns named in ``keep``, n_bytes, n_removed, n_spans, kept_sha256 and, with
    ``keep_text``, kept_text (bytes of a character that was cut in two are dropped there, as text must stay valid).

    A null text is empty. Rows with the same id are one rank: none is removed for another's sake. A row whose id is
    null has no rank: it is kept whole and removes nothing. An empty table gives no rows. Documents shorter than
    ``length`` lose nothing. Columns that are not kept may have any name. common: shards that may send their runs of one
    anchor to one group; more common anchors have their strings dealt one by one. The result does not depend on it.
    """
    if not 8 <= gram <= 24 or gram > length:
        raise ValueError("gram must be from 8 to 24 and at most length")
    n, n_ranges, n_anchors = spread.shard_count(docs), spread.shard_count(docs, 1, TEXT_RANGE), spread.shard_count(docs, 1, ANCHOR_RANGE)
    columns = list(dict.fromkeys([id_col, *keep]))
    base = docs.select(*columns, F.col(text_col).alias("__text"))
    base = base.withColumn("__shard", F.when(F.col(id_col).isNull(), F.pmod(F.xxhash64("__text"), F.lit(n)).cast("int")).otherwise(F.pmod(F.xxhash64(F.col(id_col).cast("long")), F.lit(n)).cast("int")))
    copies = shards.copies_of_earlier(docs, id_col, text_col, n)
    parts = base.groupBy("__shard")
    cells = parts.cogroup(copies.groupBy("__shard")).applyInArrow(find_anchors(length, gram, id_col, "__text", n_anchors), shards.CELL_DDL)
    shared = cells.groupBy("__range").applyInArrow(shards.anchors_elsewhere(common), shards.BACK_DDL)
    back = copies.unionByName(shared)
    sent = parts.cogroup(back.groupBy("__shard")).applyInArrow(send_runs(length, gram, id_col, "__text", n_ranges), SENT_DDL)
    verdicts = sent.groupBy("__range").applyInArrow(judge_range(length, n_ranges), shards.BACK_DDL)
    schema = StructType([*base.select(*columns).schema.fields, *(StructField(x, LongType()) for x in ("n_bytes", "n_removed", "n_spans")), StructField("kept_sha256", StringType()), *([StructField("kept_text", StringType())] if keep_text else [])])
    final = back.unionByName(verdicts)
    return parts.cogroup(final.groupBy("__shard")).applyInArrow(remove_spans(length, gram, id_col, "__text", to_arrow_schema(schema), keep_text), schema)
