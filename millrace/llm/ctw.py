"""Language-model scoring by context-tree weighting over bytes.

A byte is decomposed into eight binary decisions (255 nodes of a binary tree). For each of those nodes a context tree of
the preceding bytes, up to ``depth`` deep, holds Krichevsky-Trofimov counts; the weighted probability of a context is half its own estimate
plus half the product of its longer contexts'. As block probabilities depend on counts only, counts gathered in parallel give exactly the
weights that a sequential pass would.

1. Counting: each task counts the (depth+1)-byte strings and words of its training rows; a grouped aggregate sums them by
   key, and ranges pack their distinct keys. Strings go by their two latest context bytes, so each range holds
   whole context trees from depth two on. What is gathered grows with the corpus.
2. Depths one and zero, at most 65 280 nodes whatever the corpus, are summed by a grouped aggregate and weighted on the driver.
3. Scoring: documents are dealt to shards; a shard asks the ranges for its distinct strings and words, and the ranges
   answer with log probabilities and counts, in the order asked. A range that holds much of the text answers in several
   groups, each with its own copy of that range's keys.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from millrace.llm import spread, windows
from millrace.llm.windows import U

DEPTH = 4
#: Stands before the first byte and after the last one; no byte of UTF-8 has this value.
EDGE = 0xFF
LOG2 = float(np.log(2))
INDEX_BITS = 22


def log_gamma(x: np.ndarray) -> np.ndarray:
    """ln Gamma(x) for x > 0, by Stirling's series after eight steps of the recurrence."""
    x = np.asarray(x, float)
    shift = np.log(x)
    for i in range(1, 8):
        shift += np.log(x + i)
    y = x + 8
    r = 1 / (y * y)
    return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + (1 / 12 - r * (1 / 360 - r * (1 / 1260 - r / 1680))) / y - shift


def log_kt(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """ln of the Krichevsky-Trofimov block probability of ``a`` zeros and ``b`` ones."""
    return log_gamma(a + 0.5) + log_gamma(b + 0.5) - log_gamma(a + b + 1.0) - np.log(np.pi)


def string_codes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, depth: int) -> np.ndarray:
    """For each byte of each document and its end: context bytes from latest to oldest, then the byte, as one number."""
    lengths = ends - starts
    room = lengths + depth + 1
    top = np.cumsum(room)
    buf = np.full(int(top[-1]) if len(top) else 0, EDGE, np.uint8)
    buf[spread.slices(top - room + depth, lengths)] = raw[spread.slices(starts, lengths)]
    at = spread.slices(top - room + depth, lengths + 1)
    code = np.zeros(len(at), np.uint64)
    for back in range(1, depth + 1):
        code = (code << U(8)) | buf[at - back].astype(np.uint64)
    return (code << U(8)) | buf[at].astype(np.uint64)


def distinct(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sorted distinct codes, counts, index of each input's code). Codes of at most 42 bits sort as one number with their
    place; longer ones by an indirect sort."""
    if len(codes) and int(codes.max()) >> (64 - INDEX_BITS):
        u, back, counts = np.unique(codes, return_inverse=True, return_counts=True)
        return u, counts.astype(np.int64), back
    parts, size = [], 1 << INDEX_BITS
    for a in range(0, len(codes), size):
        key = (codes[a : a + size] << U(INDEX_BITS)) | np.arange(min(size, len(codes) - a), dtype=np.uint64)
        key.sort()
        at = (key & U(size - 1)).astype(np.int64)
        key >>= U(INDEX_BITS)
        head = np.r_[True, key[1:] != key[:-1]]
        inverse = np.empty(len(key), np.int32)
        inverse[at] = np.cumsum(head, dtype=np.int32) - 1
        first = np.flatnonzero(head)
        parts.append((key[first], np.diff(np.r_[first, len(key)]), inverse))
    if not parts:
        z = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), z, z
    if len(parts) == 1:
        return parts[0]
    u, back = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    counts = np.bincount(back, weights=np.concatenate([p[1] for p in parts])).astype(np.int64)
    at = np.cumsum([0, *(len(p[0]) for p in parts)])
    return u, counts, np.concatenate([back[at[i] : at[i + 1]][p[2]] for i, p in enumerate(parts)])


def merge_counts(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    k = keys[order]
    first = np.flatnonzero(np.r_[True, k[1:] != k[:-1]]) if len(k) else np.zeros(0, np.int64)
    return k[first], np.add.reduceat(counts[order], first) if len(first) else counts[:0]


def range_of_code(codes: np.ndarray, depth: int, n: int) -> np.ndarray:
    """The range of a string: by its two latest context bytes."""
    return spread.range_of(windows.mix(codes >> U(8 * (depth - 1))), n)


# ---- the weighted trees of one range --------------------------------------------------------------------------------


class Trees:
    """Nodes of depth 2 and deeper for the strings of one range, each with its estimate and weight."""

    def __init__(self, codes: np.ndarray, counts: np.ndarray, depth: int):
        self.depth = depth
        ctx, byte = codes >> U(8), codes & U(255)
        keys, zeros, ones = [], [], []
        for t in range(8):
            keys.append((ctx << U(8)) | U(1 << t) | (byte >> U(8 - t)))
            bit = ((byte >> U(7 - t)) & U(1)).astype(bool)
            zeros.append(np.where(bit, 0, counts))
            ones.append(np.where(bit, counts, 0))
        key, a, b = self._sum(np.concatenate(keys), np.concatenate(zeros), np.concatenate(ones))
        self.levels = {}
        weighted = log_kt(a, b)
        self.levels[depth] = (key, np.zeros(len(key)), (b + 0.5) / (a + b + 1.0), True)
        for d in range(depth - 1, 1, -1):
            up = ((key >> U(16)) << U(8)) | (key & U(255))
            key, a, b, below = self._sum(up, a, b, weighted)
            own = log_kt(a, b)
            self.levels[d] = (key, own - below, (b + 0.5) / (a + b + 1.0), False)
            weighted = np.logaddexp(own, below) - LOG2
        self.top = (key, a, b, weighted)

    @staticmethod
    def _sum(key, *values):
        order = np.argsort(key, kind="stable")
        k = key[order]
        first = np.flatnonzero(np.r_[True, k[1:] != k[:-1]]) if len(k) else np.zeros(0, np.int64)
        return k[first], *(np.add.reduceat(v[order], first) if len(first) else v[:0] for v in values)

    def log10(self, codes: np.ndarray, shallow: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        """log10 probability of each string's last byte after its context. shallow: (log weight, estimate) of the nodes of
        depth 0 (row 256) and 1 (row of the latest byte) by binary node."""
        byte, out = codes & U(255), np.zeros(len(codes))
        latest = (codes >> U(8 * self.depth)).astype(np.int64)
        for t in range(8):
            node = U(1 << t) | (byte >> U(8 - t))
            p = np.full(len(codes), 0.5)
            for d in range(self.depth, 1, -1):
                key, log_w, est, leaf = self.levels[d]
                want = ((codes >> U(8 * (self.depth - d + 1))) << U(8)) | node
                i = np.minimum(np.searchsorted(key, want), max(len(key) - 1, 0))
                hit = key[i] == want if len(key) else np.zeros(len(want), bool)
                w = 1.0 if leaf else 1 / (1 + np.exp(-np.clip(log_w[i], -700, 700))) if len(key) else 0.0
                mixed = w * est[i] + (1 - w) * p if len(key) else p
                p = np.where(hit, mixed, 0.5)
            n = node.astype(np.int64)
            for row in (latest, np.full(len(codes), 256)):
                w = 1 / (1 + np.exp(-np.clip(shallow[0][row, n], -700, 700)))
                p = w * shallow[1][row, n] + (1 - w) * p
            one = ((byte >> U(7 - t)) & U(1)).astype(bool)
            out += np.log10(np.where(one, p, 1 - p))
        return out


def shallow_nodes(rows) -> tuple[np.ndarray, np.ndarray]:
    """Weights and estimates of depths 1 and 0 from sums by (latest byte, binary node): at most 65 280 rows."""
    a, b, below = (np.zeros((257, 256)) for _ in range(3))
    for r in rows:
        a[r["latest"], r["node"]], b[r["latest"], r["node"]], below[r["latest"], r["node"]] = r["a"], r["b"], r["weighted"]
    own = log_kt(a[:256], b[:256])
    below[256] = (np.logaddexp(own, below[:256]) - LOG2).sum(0)
    a[256], b[256] = a[:256].sum(0), b[:256].sum(0)
    return log_kt(a, b) - below, (b + 0.5) / (a + b + 1.0)


# ---- Spark ----------------------------------------------------------------------------------------------------------

#: Ranges of words, and of strings, at most: a shard's questions travel in one row a range.
RANGES = 4096
#: Distinct keys that a counting task holds before it sends them.
HELD = 1 << 20
#: Questions (keys of all shards) that one group of a range should get.
ASKED = 1 << 22

COUNTS = pa.schema([("__range", pa.int32()), ("__key", pa.int64()), ("__count", pa.int64())])
COUNTS_DDL = "__range int, __key long, __count long"
MODEL = pa.schema([("__range", pa.int32()), ("__keys", pa.binary()), ("__counts", pa.binary()), ("__total", pa.int64())])
MODEL_DDL = "__range int, __keys binary, __counts binary, __total long"
ASK = pa.schema([("__range", pa.int32()), ("__salt", pa.int32()), ("__shard", pa.int32()), ("__keys", pa.binary())])
ASK_DDL = "__range int, __salt int, __shard int, __keys binary"
ANSWER = pa.schema([("__shard", pa.int32()), ("__range", pa.int32()), ("__values", pa.binary())])
ANSWER_DDL = "__shard int, __range int, __values binary"


def _units(raw, at, depth):
    """For a stretch of about 1 MiB of documents at a time: (word hashes, string codes, their documents, words a document)."""
    starts, ends = at[:-1], at[1:]
    for base, s, e, docs in windows.segments(starts, ends, 1, size=1 << 20, cut=1 << 62):
        piece = raw[base : base + int(e[-1])]
        _, _, code, doc = windows.word_tokens(windows.lower_ascii(piece), s, e)
        yield code, string_codes(piece, s, e, depth), docs, np.bincount(doc, minlength=len(docs))


def _cells(keys: np.ndarray, rng: np.ndarray, first: int):
    """Keys in order of their range: (order, ranges from ``first`` on, bounds)."""
    order = np.argsort(rng, kind="stable")
    who, bounds = spread.cells(rng[order])
    return order, who + first, bounds


def count_training(depth: int, n: int, most: int = HELD):
    """Distinct words and strings of a task's rows with counts. Equal keys of several rows or tasks are summed by the
    aggregate that follows, so a task sends what it holds whenever that is ``most`` distinct keys."""

    def step(batches):
        have, held = [], 0

        def merged():
            for kind in (0, 1):
                parts = [h[1:] for h in have if h[0] == kind]
                if parts:
                    k, c = merge_counts(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]))
                    yield kind, k, c

        def rows():
            for kind, k, c in merged():
                rng = range_of_code(k, depth, n) + n if kind else spread.range_of(k, n)
                for a in range(0, len(k), 1 << 17):
                    part = slice(a, a + (1 << 17))
                    yield pa.RecordBatch.from_arrays([pa.array(rng[part].astype(np.int32)), pa.array(k[part].view(np.int64)), pa.array(c[part])], schema=COUNTS)

        for batch in batches:
            raw, at = spread.column_bytes(batch.column(0))
            for word, code, _, _ in _units(raw, at, depth):
                for kind, (k, c) in enumerate((np.unique(word, return_counts=True), distinct(code)[:2])):
                    have.append((kind, k, c.astype(np.int64)))
                held += len(have[-1][1]) + len(have[-2][1])
                if held > 2 * most:
                    have = list(merged())
                    held = sum(len(h[1]) for h in have)
                    if held > most:
                        yield from rows()
                        have, held = [], 0
        yield from rows()

    return spread.rows_giving_back(step)


def pack_ranges(batches):
    """Rows (range, key, count), whole ranges sorted by range and key, as one packed row a range."""
    for table in spread.streamed_groups(batches, ["__range"]):
        bounds = spread.group_bounds(table, ["__range"])
        key, count = (np.asarray(table.column(c)) for c in ("__key", "__count"))
        rng = np.asarray(table.column("__range"))[bounds[:-1]]
        order = np.concatenate([a + np.argsort(key[a:b].view(np.uint64), kind="stable") for a, b in zip(bounds[:-1], bounds[1:], strict=True)])
        total = np.add.reduceat(count, bounds[:-1])
        yield from pa.table([pa.array(rng.astype(np.int32)), spread.binary_column(key[order], bounds), spread.binary_column(count[order], bounds), pa.array(total)], schema=MODEL).to_batches()


def shallow_sums(depth: int):
    """Of each range's trees, sums by latest byte and binary node."""
    fields = pa.schema([("latest", pa.int32()), ("node", pa.int32()), ("a", pa.int64()), ("b", pa.int64()), ("weighted", pa.float64())])

    def step(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                key, a, b, w = Trees(spread.packed(row.column(1), np.uint64)[0], spread.packed(row.column(2), np.int64)[0], depth).top
                up = ((key >> U(16)) << U(8)) | (key & U(255))
                key, a, b, w = Trees._sum(up, a, b, w)
                yield pa.RecordBatch.from_arrays([pa.array((key >> U(8)).astype(np.int32)), pa.array((key & U(255)).astype(np.int32)), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(w)], schema=fields)

    return spread.rows_giving_back(step)


def _shard_units(docs: pa.Table, depth: int):
    """Of a shard: word hashes, string codes, words a document, bytes and end a document."""
    raw, at = spread.column_bytes(docs.column("__text"))
    words, codes, per_doc = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)], np.zeros(docs.num_rows, np.int64)
    for word, code, rows, n in _units(raw, at, depth):
        words.append(word)
        codes.append(code)
        per_doc[rows] = n
    return np.concatenate(words), np.concatenate(codes), per_doc, np.diff(at) + 1


def ask(depth: int, n: int, salts: np.ndarray):
    """A shard's distinct words and strings, as one row a range; the shard's number picks the group of the range."""

    def step(docs: pa.Table) -> pa.Table:
        word, code, _, _ = _shard_units(docs, depth)
        shard, parts = docs.column("__shard")[0].as_py(), []
        for keys, rng, first in ((w := np.unique(word), spread.range_of(w, n), 0), (c := distinct(code)[0], range_of_code(c, depth, n), n)):
            order, who, bounds = _cells(keys, rng, first)
            parts.append(pa.table([pa.array(who.astype(np.int32)), pa.array((shard % salts[who]).astype(np.int32)), pa.array(np.full(len(who), shard, np.int32)), spread.binary_column(keys[order], bounds)], schema=ASK))
        return pa.concat_tables(parts)

    return spread.giving_back(step)


def answer(depth: int, n: int, shallow):
    """Answers of one group of a range: counts of words, or log10 probabilities of strings, one value for each key asked."""

    def step(key, asked: pa.Table, model: pa.Table) -> pa.Table:
        if not asked.num_rows:
            return ANSWER.empty_table()
        keys, sizes = spread.packed(asked.column("__keys"), np.uint64)
        have, _ = spread.packed(model.column("__keys"), np.uint64)
        counts, _ = spread.packed(model.column("__counts"), np.int64)
        one, back = np.unique(keys, return_inverse=True)
        if int(asked.column("__range")[0].as_py()) < n:
            i = np.minimum(np.searchsorted(have, one), max(len(have) - 1, 0))
            value = np.where(have[i] == one, counts[i], 0).astype(np.float64) if len(have) else np.zeros(len(one))
        else:
            value = Trees(have, counts, depth).log10(one, shallow)
        bounds = np.r_[0, np.cumsum(sizes)]
        return pa.table([asked.column("__shard").cast(pa.int32()), asked.column("__range").cast(pa.int32()), spread.binary_column(value[back], bounds)], schema=ANSWER)

    return spread.giving_back(step)


def score(depth: int, n: int, totals: tuple[int, int, int], fields: pa.Schema):
    n_tokens_all, n_distinct, n_docs = totals

    def step(key, docs: pa.Table, said: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return fields.empty_table()
        word, code, per_doc, n_bytes = _shard_units(docs, depth)
        order = np.argsort(np.asarray(said.column("__range")), kind="stable")
        said = said.take(pa.array(order))
        is_word = np.asarray(said.column("__range")) < n
        w, w_inverse = np.unique(word, return_inverse=True)
        c, _, c_inverse = distinct(code)
        del word, code
        count, log_p = np.empty(len(w)), np.empty(len(c))
        for have, rng, out, rows in ((w, spread.range_of(w, n), count, is_word), (c, range_of_code(c, depth, n), log_p, ~is_word)):
            if len(have):
                out[_cells(have, rng, 0)[0]] = spread.packed(said.filter(pa.array(rows)).column("__values"), np.float64)[0]
        k = docs.num_rows
        doc = np.repeat(np.arange(k), per_doc)
        below = n_tokens_all + n_distinct + 1
        seen = count[w_inverse] if len(w) else np.zeros(0)
        base = np.bincount(doc, weights=np.log10((seen + 1) / below), minlength=k) + np.log10((n_docs + 1) / below)
        known = np.bincount(doc, weights=seen > 0, minlength=k) + (n_docs > 0)
        total = np.add.reduceat(log_p[c_inverse], np.cumsum(n_bytes) - n_bytes)
        cols = [docs.column(x).combine_chunks() for x in fields.names[:-7]]
        cols += [pa.array(per_doc + 1, pa.int64()), pa.array(known.astype(np.int64)), pa.array(np.full(k, n_tokens_all), pa.int64()), pa.array(base), pa.array(total)]
        cols += [pa.array(n_bytes - 1, pa.int64()), pa.array(-total * np.log2(10) / n_bytes)]
        return pa.table(cols, names=fields.names).cast(fields)

    return spread.giving_back(step)


def score_texts(docs: DataFrame, held_out, id_col: str = "doc_id", text_col: str = "text", depth: int = DEPTH) -> DataFrame:
    """Scores of every row by a model of the rows where the condition ``held_out`` is false.

    Returns id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes, bits_per_byte (over the bytes and
    the end). base_score is the add-one unigram score of lower-cased words and the end; score is the log10 probability
    of the text's bytes and end under the weighted trees.

    A null text is empty and scores its end alone. Repeated rows count and are scored each. With no training rows the trees are
    empty, and each bit has probability one half. No rows give no rows. Other columns may have any name. A
    null condition counts as false. A task holds about 30 bytes for each byte of its shard or of its longest text.

    depth: from 2 to 7 bytes of context (a string of depth + 1 bytes is one 64-bit number). Questions and answers grow with
    the distinct strings of a shard, which are many more for deep trees.
    """
    if not 2 <= depth <= 7:
        raise ValueError("depth must be from 2 to 7: a string and its place share one 64-bit number")
    n, n_shards = min(spread.shard_count(docs, 1), RANGES), spread.shard_count(docs)
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    base = docs.select(F.col(id_col).alias(id_col), F.coalesce(held_out, F.lit(False)).alias("held_out"), F.coalesce(F.col(text_col), F.lit("")).alias("__text"))
    # each key is summed by the engine, map side first: no task gets all strings of a hot context from all others
    counted = base.where("NOT held_out").select("__text").mapInArrow(count_training(depth, n), COUNTS_DDL).groupBy("__range", "__key").agg(F.sum("__count").alias("__count"))
    model = spread.settle(counted.repartition(parts, "__range").sortWithinPartitions("__range").mapInArrow(spread.rows_giving_back(pack_ranges), MODEL_DDL))
    n_docs, n_rows, n_bytes = base.agg(F.count_if(~F.col("held_out")), F.count("*"), F.coalesce(F.sum(F.octet_length("__text")), F.lit(0))).first()
    words = model.where(F.col("__range") < n).agg(F.sum("__total"), F.sum(F.octet_length("__keys") / 8)).first()
    totals = (int(words[0] or 0) + n_docs, int(words[1] or 0) + (n_docs > 0), n_docs)
    sums = model.where(F.col("__range") >= n).mapInArrow(shallow_sums(depth), "latest int, node int, a long, b long, weighted double")
    shallow = shallow_nodes(sums.groupBy("latest", "node").agg(F.sum("a").alias("a"), F.sum("b").alias("b"), F.sum("weighted").alias("weighted")).collect())
    # a range that holds a large share of all places is answered in several groups, by the number of the shard that asks
    seen = model.select("__range", "__total").collect()  # one row a range, 8192 at most
    places = {0: max(totals[0], 1), 1: max(sum(r["__total"] for r in seen if r["__range"] >= n), 1)}
    salts = np.ones(2 * n, np.int64)
    for r in seen:
        kind = int(r["__range"] >= n)
        salts[r["__range"]] = -(-int((n_bytes + n_rows) / (1 if kind else 4) * r["__total"] / places[kind]) // ASKED) or 1
    spark = docs.sparkSession
    groups = spark.createDataFrame([(i, int(x)) for i, x in enumerate(salts.tolist())], "__range int, __salts int")
    spread_model = model.join(F.broadcast(groups), "__range").select("__range", F.explode(F.sequence(F.lit(0), F.col("__salts") - 1)).alias("__salt"), "__keys", "__counts")
    dealt = base.withColumn("__shard", F.pmod(F.xxhash64(F.col(id_col), F.when(F.col(id_col).isNull(), F.col("__text"))), F.lit(n_shards)).cast("int"))
    by_shard = dealt.groupBy("__shard")
    asked = by_shard.applyInArrow(ask(depth, n, salts), ASK_DDL)
    said = asked.groupBy("__range", "__salt").cogroup(spread_model.groupBy("__range", "__salt")).applyInArrow(answer(depth, n, shallow), ANSWER_DDL)
    schema = StructType([*base.select(id_col, "held_out").schema.fields, *(StructField(x, LongType()) for x in ("n_tokens", "n_known", "train_tokens")), StructField("base_score", DoubleType()), StructField("score", DoubleType()), StructField("n_bytes", LongType()), StructField("bits_per_byte", DoubleType())])
    return by_shard.cogroup(said.groupBy("__shard")).applyInArrow(score(depth, n, totals, to_arrow_schema(schema)), schema)
