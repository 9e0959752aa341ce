"""Near-duplicate documents by b-bit MinHash.

Low bits of the minima are packed into signatures, whose equal fields, counted by bit operations and corrected for chance
collisions, estimate the similarity. Candidates come from bands of whole minima; links are confirmed on full sets.

1. One row a document: size and hash of its shingle set, bands, packed signature. Equal sets form classes; the smallest
   document stands for its class, so a huge group of copies is one row from here on.
2. In each band bucket, members that no leader resembles closely become leaders, and every member is joined to each leader that it
   resembles at all, by the estimate. As distance obeys the triangle inequality, two documents over the threshold that share a bucket
   come into one family. Large buckets are cut into blocks whose leaders meet again: each block of leaders with every other, each two
   in a group of their own, so that no task gets a whole bucket.
3. Families (connected components) bring their documents' full sets together in blocks; links are exact there, and
   only as many as join what is not yet joined are passed on. Components of those links are the result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm import spread, windows
from millrace.llm.spread import connected_components, settle

BANDS, ROWS, BITS = 32, 5, 4
HASHES = BANDS * ROWS
#: Estimates from which a member needs no leader of its own, and from which it joins a leader's family.
NEAR, LOOSE = 0.85, 0.35
BLOCK = 1024
_RNG = np.random.default_rng(11)
MULTIPLY = _RNG.integers(1, 1 << 32, HASHES, dtype=np.uint64).astype(np.uint32) | np.uint32(1)
ADD = _RNG.integers(0, 1 << 32, HASHES, dtype=np.uint64).astype(np.uint32)


def shingle_sets(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, n: int) -> list[np.ndarray]:
    """Sorted distinct hashes of each document's n-word shingles; of fewer words, the whole sequence as one."""
    _, _, code, doc = windows.word_tokens(windows.lower_ascii(raw), starts, ends)
    counts = np.bincount(doc, minlength=len(starts)) if len(doc) else np.zeros(len(starts), np.int64)
    gram = windows.mix(windows.item_grams(code, n) + np.uint64(n))
    out, at = [], 0
    for k in counts.tolist():
        if k >= n:
            x = np.sort(gram[at : at + k - n + 1])
            out.append(x[np.r_[True, x[1:] != x[:-1]]])
        elif k:
            out.append(windows.mix(windows.item_grams(code[at : at + k], k)[:1] + np.uint64(k)))
        else:
            out.append(np.zeros(0, np.uint64))
        at += k
    return out


def minima(sets: list[np.ndarray]) -> np.ndarray:
    """The least value of each hash function over each set (none of them empty): one row a set."""
    values = (np.concatenate(sets) >> np.uint64(32)).astype(np.uint32)
    at = np.cumsum([0, *(len(s) for s in sets[:-1])])
    out = np.empty((len(sets), HASHES), np.uint32)
    for i in range(HASHES):
        out[:, i] = np.minimum.reduceat(values * MULTIPLY[i] + ADD[i], at)
    return out


def band_keys(m: np.ndarray) -> np.ndarray:
    grouped = m.reshape(len(m), BANDS, ROWS).astype(np.uint64)
    key = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), (len(m), BANDS)).copy()
    for i in range(ROWS):
        key = windows.mix(key * windows.A + grouped[:, :, i])
    return key.view(np.int64)


def signatures(m: np.ndarray) -> np.ndarray:
    """The low bits of scrambled minima, sixteen to a 64-bit word."""
    low = (windows.mix(m.astype(np.uint64)) & np.uint64((1 << BITS) - 1)).reshape(len(m), -1, 64 // BITS)
    return np.bitwise_or.reduce(low << (np.arange(64 // BITS, dtype=np.uint64) * np.uint64(BITS)), axis=2)


FIELD_LOW = np.uint64(sum(1 << (BITS * i) for i in range(64 // BITS)))


def estimate(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Collision-corrected similarity from packed signatures, by counting fields that differ."""
    d = x ^ y
    d |= d >> np.uint64(2)
    d |= d >> np.uint64(1)
    differ = np.bitwise_count(d & FIELD_LOW).sum(-1, dtype=np.int64)
    chance = 1 / (1 << BITS)
    return (1 - differ / HASHES - chance) / (1 - chance)


SIGNED = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()), ("bands", pa.list_(pa.int64())), ("sig", pa.binary())])
SIGNED_DDL = "doc_id long, n_shingles long, k1 long, k2 long, bands array<long>, sig binary"


def sign(n: int):
    def step(batches):
        for batch in batches:
            raw, at = spread.column_bytes(batch.column(1))
            for _, s, e, docs in windows.segments(at[:-1], at[1:], 1, size=1 << 20, cut=1 << 62) if batch.num_rows else ():
                base = int(at[docs[0]])
                sets = shingle_sets(raw[base : base + int(e[-1])], s, e, n)
                size = np.array([len(x) for x in sets])
                full = np.flatnonzero(size)
                k1, k2 = np.zeros(len(sets), np.uint64), np.zeros(len(sets), np.uint64)
                bands, sig = [None] * len(sets), [None] * len(sets)
                if len(full):
                    some = [sets[i] for i in full]
                    flat, head = np.concatenate(some), np.cumsum([0, *size[full][:-1]])
                    k1[full] = np.add.reduceat(windows.mix(flat ^ windows.B), head)
                    k2[full] = np.add.reduceat(windows.mix(flat ^ windows.C), head) + size[full].astype(np.uint64)
                    m = minima(some)
                    for i, b, g in zip(full.tolist(), band_keys(m), signatures(m), strict=True):
                        bands[i], sig[i] = b, g.tobytes()
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(int(docs[0]), len(docs)), pa.array(size, pa.int64()), pa.array(k1.view(np.int64)), pa.array(k2.view(np.int64)), pa.array(bands, SIGNED.field("bands").type), pa.array(sig, pa.binary())], schema=SIGNED)

    return step


def pairs_of(found: list[tuple[int, np.ndarray]]) -> np.ndarray:
    """(one, other) rows from each one's others."""
    parts = [np.stack([np.full(len(j), i), j], axis=1) for i, j in found]
    return np.concatenate([np.zeros((0, 2), np.int64), *parts])


def lead(sig: np.ndarray) -> tuple[list[int], np.ndarray]:
    """Leaders of a bucket, in order, and (leader, member) joins."""
    free = np.ones(len(sig), bool)
    leaders, joins = [], []
    for i in range(len(sig)):
        if not free[i]:
            continue
        leaders.append(i)
        e = estimate(sig, sig[i])
        free &= e < NEAR
        free[i] = False
        joins.append((i, np.flatnonzero(e >= LOOSE)))
    return leaders, pairs_of(joins)


JOINS = pa.schema([("__key", pa.int64()), ("a", pa.int64()), ("b", pa.int64())])
JOINS_DDL = "__key long, a long, b long"
#: Of one group: the bucket's key, the two blocks of the bucket that meet in it, and how many blocks there are.
CELL = ["__key", "__i", "__j"]


def met(sig: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Joins between two blocks of leaders: for each of the left one, those of the right one that it resembles at all."""
    return pairs_of([(i, right[estimate(sig[right], sig[i]) >= LOOSE]) for i in left.tolist()])


def lead_buckets(batches):
    """Rows (key, i, j, block, blocks, doc, sig), sorted by key, i and j -> joins (a, b), no more of a group than
    connect what its leaders connect; leaders of buckets of several blocks as (key, a, null)."""
    for table in spread.streamed_groups(batches, CELL):
        bounds = spread.group_bounds(table, CELL)
        doc, key, i_, j_, block, blocks = (np.asarray(table.column(c)) for c in ("doc", *CELL, "__block", "__blocks"))
        sig = spread.packed(table.column("sig"), np.uint64)[0].reshape(len(doc), -1)
        size, lead_of = np.diff(bounds), i_[bounds[:-1]] == j_[bounds[:-1]]
        two = bounds[:-1][(size == 2) & (blocks[bounds[:-1]] == 1)]
        near = two[estimate(sig[two], sig[two + 1]) >= LOOSE] if len(two) else two
        keys, a, b = [None] * len(near), doc[near].tolist(), doc[near + 1].tolist()
        for g in np.flatnonzero((size > 2) | (blocks[bounds[:-1]] > 1)):
            lo, hi = bounds[g], bounds[g + 1]
            if lead_of[g]:
                leaders, pairs = lead(sig[lo:hi])
            else:
                leaders, pairs = [], met(sig[lo:hi], np.flatnonzero(block[lo:hi] == i_[lo]), np.flatnonzero(block[lo:hi] == j_[lo]))
            label = spread.union_find(int(hi - lo), pairs[:, 0], pairs[:, 1])
            far = np.flatnonzero(label != np.arange(hi - lo))
            keys += [None] * len(far)
            a += doc[lo + label[far]].tolist()
            b += doc[lo + far].tolist()
            if blocks[lo] > 1:
                keys += [int(key[lo])] * len(leaders)
                a += [int(doc[lo + x]) for x in leaders]
                b += [None] * len(leaders)
        if a:
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64())], schema=JOINS)


def confirm(n: int, percent: int):
    """Rows (family, i, j, chunk, doc, text), sorted by cell -> exact links that join a cell's documents."""

    def links(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        size = np.array([len(s) for s in sets], np.int64)
        flat = np.concatenate(sets)
        owner = np.repeat(np.arange(len(sets)), size)
        order = np.argsort(flat, kind="stable")
        f, owner = flat[order], owner[order]
        head = np.r_[True, f[1:] != f[:-1]]
        first = np.flatnonzero(head)
        shared = np.diff(np.r_[first, len(f)]) > 1
        keep = np.repeat(shared, np.diff(np.r_[first, len(f)]))
        column = (np.cumsum(shared) - 1)[np.cumsum(head) - 1][keep]
        owner = owner[keep]
        both = np.zeros((len(left), len(right)))  # doubles hold every count exactly
        row_l, row_r = np.full(len(sets), -1), np.full(len(sets), -1)
        row_l[left], row_r[right] = np.arange(len(left)), np.arange(len(right))
        for a in range(0, int(column[-1]) + 1 if len(column) else 0, 4096):
            lo, hi = np.searchsorted(column, [a, a + 4096])
            c, o = column[lo:hi] - a, owner[lo:hi]
            x, y = np.zeros((len(left), 4096), np.float32), np.zeros((len(right), 4096), np.float32)
            for m, r in ((x, row_l[o]), (y, row_r[o])):
                m[r[r >= 0], c[r >= 0]] = 1
            both += x @ y.T
        union = size[left][:, None] + size[right][None, :] - both
        hit = np.nonzero(100 * both >= percent * union)
        return left[hit[0]], right[hit[1]]

    def step(batches):
        for table in spread.streamed_groups(batches, ["__family", "__i", "__j"]):
            bounds = spread.group_bounds(table, ["__family", "__i", "__j"])
            doc, chunk, i, j = (np.asarray(table.column(c)) for c in ("doc", "__chunk", "__i", "__j"))
            raw, at = spread.column_bytes(table.column("text"))
            out_a, out_b = [], []
            for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
                sets = shingle_sets(raw[at[lo] : at[hi]], at[lo:hi] - at[lo], at[lo + 1 : hi + 1] - at[lo], n)
                if i[lo] == j[lo]:
                    left = right = np.arange(hi - lo)
                else:
                    left, right = np.flatnonzero(chunk[lo:hi] == i[lo]), np.flatnonzero(chunk[lo:hi] == j[lo])
                if not len(left) or not len(right):
                    continue
                a, b = links(sets, left, right)
                a, b = a[a != b], b[a != b]
                label = spread.union_find(hi - lo, a, b)
                d = doc[lo:hi]
                far = np.flatnonzero(label != np.arange(hi - lo))
                out_a += d[label[far]].tolist()
                out_b += d[far].tolist()
            if out_a:
                yield pa.RecordBatch.from_arrays([pa.array(out_a, pa.int64()), pa.array(out_b, pa.int64())], names=["a", "b"])

    return step


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of ``docs``.

    Documents are linked if 100 * intersection >= percent * union of their sets of ``words``-word shingles, A-Z
    lower-cased. component_id: the smallest id reachable, kept: whether that is its own. Null and empty texts have no shingles and link with
    nothing. A row without id is kept and links with nothing. Rows with the same id share its component if their texts
    are linked; each is judged by its own text. No rows give no rows. Other columns may have any name.

    Of two documents at similarity 0.8, some band agrees with probability 1 - (1 - 0.8**5)**32, i.e. all but three in a
    million; ``percent`` below 80 is refused, as it would find fewer.
    """
    if percent < 80:
        raise ValueError("bands are laid out for 80 percent or more")
    signed = settle(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(spread.rows_giving_back(sign(words)), SIGNED_DDL))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    full = signed.where("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = settle(full.groupBy("k1", "k2").agg(F.min("doc_id").alias("doc"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"), F.first("sig").alias("sig")))
    buckets = classes.select("doc", F.explode("bands").alias("__key"))
    many = buckets.groupBy("__key").agg(F.count("*").alias("__n")).where("__n > 1")
    sigs = classes.select("doc", "sig")

    def blocked(rows: DataFrame, sizes: DataFrame) -> DataFrame:
        """Members of buckets with the block of at most about ``BLOCK`` that each is in."""
        of = sizes.select("__key", F.ceil(F.col("__n") / BLOCK).cast("int").alias("__blocks"))
        return rows.join(of, "__key").withColumn("__block", F.pmod(F.xxhash64("doc", "__key"), F.col("__blocks")).cast("int"))

    def led(rows: DataFrame) -> DataFrame:
        dealt = rows.join(sigs, "doc").select(*CELL, "__block", "__blocks", "doc", "sig").repartition(parts, *CELL).sortWithinPartitions(*CELL, "doc")
        return settle(dealt.mapInArrow(spread.rows_giving_back(lead_buckets), JOINS_DDL))

    members = blocked(buckets, many)
    joins = led(members.select("__key", "doc", F.col("__block").alias("__i"), F.col("__block").alias("__j"), "__block", "__blocks"))
    # leaders of a bucket's blocks meet: each block of leaders with itself and with every other, in a group of its own
    leaders = joins.where("b IS NULL").select("__key", F.col("a").alias("doc"))
    again = blocked(leaders, leaders.groupBy("__key").agg(F.count("*").alias("__n"))).withColumn("__o", F.explode(F.sequence(F.lit(0), F.col("__blocks") - 1)))
    again = led(again.select("__key", "doc", F.least("__block", "__o").alias("__i"), F.greatest("__block", "__o").alias("__j"), "__block", "__blocks"))
    joins = joins.where("b IS NOT NULL").unionByName(again.where("b IS NOT NULL"))
    families = connected_components(joins.select("a", "b"))
    families = families.join(classes.select(F.col("doc").alias("node"), "n"), "node").select(F.col("node").alias("doc"), F.col("component").alias("__family"), "n")
    families = settle(families)
    size = families.groupBy("__family").agg(F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("n") / 400_000)).cast("int").alias("__chunks"))
    placed = families.join(size, "__family").withColumn("__chunk", F.pmod(F.xxhash64("doc"), F.col("__chunks")).cast("int"))
    cells = placed.withColumn("__o", F.explode(F.sequence(F.lit(0), F.col("__chunks") - 1))).select("__family", F.least("__chunk", "__o").alias("__i"), F.greatest("__chunk", "__o").alias("__j"), "__chunk", "doc")
    texts = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"))
    # as the cells grow with the corpus, one plan for every size: sorted by document and merged, never broadcast, so that it can spill
    together = texts.join(cells.hint("merge"), "doc").select("__family", "__i", "__j", "__chunk", "doc", "text").repartition(parts, "__family", "__i", "__j").sortWithinPartitions("__family", "__i", "__j", "doc")
    components = connected_components(together.mapInArrow(spread.rows_giving_back(confirm(words, percent)), "a long, b long"))
    found = classes.select("k1", "k2", "doc").join(components.select(F.col("node").alias("doc"), "component"), "doc", "left").select("k1", "k2", F.coalesce("component", "doc").alias("__c"))
    own = F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("__c")).otherwise(F.col("doc_id"))
    out = signed.select("doc_id", "n_shingles", "k1", "k2").join(found, ["k1", "k2"], "left").withColumn("component_id", own)
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))
