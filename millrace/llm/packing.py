"""Best-fit packing of tokenized documents into sequences of a fixed size.

Documents become pieces of at most ``size`` tokens. Only the histogram of their lengths (at most ``size`` numbers) comes
to the driver. There the configuration linear program over the histogram is solved by multiplicative weights, with a knapsack
dynamic program for prices; the fractional solution is rounded, the rest solved again, and the last rest goes by best
fit. The plan is a bounded table that says, for the r-th piece of a length, its sequence and offset; pieces look theirs
up where they are.
"""

from __future__ import annotations

import re
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm import spread

SIZE, END_ID = 1024, 2
#: Characters on whose classes both tokenizer libraries agree whatever their Unicode version: Latin, and common signs.
PLAIN = re.compile(r"[\u0000-ɏ‐-›€]*\Z")
SPECIAL = "<|endoftext|>"


@lru_cache(2)
def encoder(name: str):
    """text -> array of ids of a byte-level BPE file for ``tokenizers``. Where the same vocabulary lies beside it as ranks, texts of
    ``PLAIN`` characters go through a faster library, which gives the same ids (tests compare every text of the small tables and
    every such character); all others through ``tokenizers``."""
    import base64
    import os

    import public_tokenizers
    from tokenizers import Tokenizer

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    path = public_tokenizers.path(name)
    slow = Tokenizer.from_file(path)
    fast = None
    ranks = path.removesuffix(".json") + ".tiktoken"
    if name.startswith("byte_bpe") and os.path.exists(ranks):
        import tiktoken

        with open(ranks, "rb") as f:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        fast = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})

    def encode(text: str) -> np.ndarray:
        if fast is not None and SPECIAL not in text and PLAIN.match(text):
            return fast.encode_to_numpy(text, disallowed_special=())
        return np.array(slow.encode(text, add_special_tokens=False).ids, np.uint32)

    return encode


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def cut(docs: DataFrame, id_col: str, text_col: str, name: str, size: int, end_id: int, ids: bool = False) -> DataFrame:
    """Pieces of each row's ids and the end id: all of ``size`` tokens but the first, which may be shorter."""
    kind = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    fields = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), *([("ids", pa.list_(pa.int32()))] if ids else [])])

    def step(batches):
        encode = encoder(name)
        for batch in batches:
            rows = [[] for _ in fields]
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                tokens = np.append(encode(text.as_py() or ""), end_id).astype("<u4")
                first = len(tokens) % size or min(size, len(tokens))
                at = 0
                for i, to in enumerate(range(first, len(tokens) + 1, size)):
                    part = tokens[at:to]
                    for have, x in zip(rows, (doc, i, at, to - at, zlib.crc32(part.tobytes()), part.astype(np.int32)), strict=False):
                        have.append(x)
                    at = to
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(rows, fields, strict=True)], schema=fields)

    return kind.mapInArrow(step, PIECES + (", ids array<int>" if ids else ""))


def best_configuration(value: np.ndarray, size: int) -> np.ndarray:
    """The most valuable multiset of lengths that fits: an unbounded knapsack, solved by room. value: by length, [0] unused."""
    best = np.zeros(size + 1)
    took = np.zeros(size + 1, np.int64)
    for room in range(1, size + 1):
        v = best[room - 1 :: -1] + value[1 : room + 1] if room > 1 else best[:1] + value[1:2]
        i = int(v.argmax())
        if v[i] > best[room - 1]:
            best[room], took[room] = v[i], i + 1
        else:
            best[room] = best[room - 1]
    out, room = np.zeros(size + 1, np.int64), size
    while room > 0:
        if took[room]:
            out[took[room]] += 1
            room -= took[room]
        else:
            room -= 1
    return out


def best_fit(counts: np.ndarray, size: int) -> list[tuple[tuple[int, ...], int]]:
    """Best fit, longest first, on counts: (lengths in a sequence, how many such sequences)."""
    open_: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    done = []
    for length in range(size, 0, -1):
        left = int(counts[length])
        for room in range(length, size + 1):
            if not left:
                break
            for have, n in open_.pop(room, []):
                k = min(room // length, -(-left // n)) if left else 0
                if not k:
                    open_.setdefault(room, []).append((have, n))
                    continue
                full = min(n, left // k)
                for content, m in ((have + (length,) * k, full), (have, n - full)):
                    if m:
                        open_.setdefault(size - sum(content), []).append((content, m))
                left -= full * k
        if left:
            k = size // length
            for each, m in ((k, left // k), (left % k, 1)):
                if each and m:
                    open_.setdefault(size - each * length, []).append(((length,) * each, m))
    for groups in open_.values():
        done += groups
    return done


Plan = list[tuple[tuple[int, ...], int]]


def covering_program(counts: np.ndarray, size: int = SIZE, sweeps: float = 4.0, rounds: int = 2400, rate: float = 0.05, gap: float = 1e-4) -> tuple[dict[tuple[int, ...], float], float]:
    """A fractional solution of the configuration program, and a lower bound of every solution: ({configuration: times}, bound).

    The program: use configurations (multisets of lengths that fit in ``size``) as few times as covers ``counts`` pieces.
    Multiplicative weights: the price of a length falls by the factor exp(-rate) for each full covering of its demand. Each
    round a knapsack finds the configuration of most value at the prices; what it is worth gives a bound by duality
    (demand at these prices over the value of the best configuration), and it is used as often as its scarcest
    length allows. After ``sweeps`` coverings of all demand, or ``rounds`` rounds, the sum of all rounds is scaled so that the
    demand of pieces is met on average. It ends early where it covers each length within ``gap`` of the bound.
    """
    lengths = np.flatnonzero(counts)
    need = counts.astype(float)
    share = np.arange(size + 1) / size
    price = np.where(counts > 0, share * (1 + share / 8), 0.0)
    covered, times, total = np.zeros(size + 1), {}, 0.0
    bound = float((share * need).sum())
    for _ in range(rounds):
        if not len(lengths):
            break
        a = best_configuration(price, size)
        bound = max(bound, float((price * need).sum() / (a * price).sum()))
        used = np.flatnonzero(a)
        step = float((need[used] / a[used]).min())
        key = tuple(np.repeat(used, a[used])[::-1].tolist())
        times[key] = times.get(key, 0.0) + step
        total += step
        covered[used] += a[used] * step
        price[used] *= np.exp(-rate * a[used] * step / need[used])
        least = float((covered[lengths] / need[lengths]).min())
        if least >= sweeps or least > 0 and total / least <= bound * (1 + gap):
            break
    scale = float((share * need).sum()) / max(float((share * covered).sum()), 1e-300)
    return {c: t * scale for c, t in times.items()}, bound


def rounded(times: dict[tuple[int, ...], float], counts: np.ndarray, size: int) -> tuple[dict[tuple[int, ...], int], np.ndarray]:
    """Whole times for each configuration, none over what is to be covered, and the counts that are left: ({configuration: times}, left).

    First the whole part of each fraction, then one more by falling fraction; both as far as pieces are left.
    """
    left, fixed = counts.astype(np.int64).copy(), {}
    by = sorted(times, key=lambda c: (times[c] % 1, sum(c), c), reverse=True)
    for take in (np.floor, lambda x: 1.0):
        for c in by:
            used, each = np.unique(c, return_counts=True)
            n = min(int(take(times[c])), int((left[used] // each).min()))
            if n:
                fixed[c] = fixed.get(c, 0) + n
                left[used] -= each * n
    return fixed, left


def plan_sequences(counts: np.ndarray, size: int = SIZE, solves: int = 4) -> tuple[Plan, float]:
    """Configurations and how often to use each, covering ``counts`` pieces by length exactly, and the program's lower bound.

    The fractional solution is rounded. What rounding leaves uncovered is a program of its own, solved in the same way (with
    fewer rounds), up to ``solves`` in all and as far as that needs fewer sequences; the last rest goes by best fit.
    """
    left, fixed, plan, bound = counts, {}, None, 0.0
    for i in range(solves):
        times, low = covering_program(left, size, rounds=400 if i else 2400)
        bound = bound if i else low
        more, left = rounded(times, left, size)
        for c, n in more.items():
            fixed[c] = fixed.get(c, 0) + n
        whole = [*fixed.items(), *best_fit(left, size)]
        if plan is None or sum(n for _, n in whole) < sum(n for _, n in plan):
            plan = whole
        if not more or sum(n for _, n in plan) <= bound + 1 - 1e-6:
            break
    return plan, bound


def lookup(plan: Plan, size: int) -> dict[str, np.ndarray]:
    """The plan by length: ranks from ``low`` on have the sequence base + (rank - low) // each and their offset."""
    rows, base, used = [], 0, np.zeros(size + 1, np.int64)
    for content, n in plan:
        at = 0
        for length in sorted(set(content), reverse=True):
            each = content.count(length)
            rows.append((length, used[length], base, each, at))
            used[length] += each * n
            at += each * length
        base += n
    rows.sort()
    return dict(zip(("length", "low", "base", "each", "offset"), np.array(rows, np.int64).reshape(-1, 5).T.copy(), strict=True))


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = "byte_bpe_50k.json", size: int = SIZE, end_id: int = END_ID) -> DataFrame:
    """Pieces with their places: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A null text is empty: one piece, the end id. Repeated rows, and rows without id, are packed like any others. No
    rows give no rows. Only id and text are read, so other columns may have any name.

    The rank of a piece among those of its length comes from counts by length and chunk, so a length that very
    many pieces share is ranked in many tasks.
    """
    chunks = spread.shard_count(docs)
    pieces = spread.settle(cut(docs, id_col, text_col, tokenizer, size, end_id).withColumn("__chunk", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(chunks)).cast("int")))
    by = pieces.groupBy("length", "__chunk").agg(F.count("*").alias("n"))
    counts = np.zeros(size + 1, np.int64)
    for r in by.groupBy("length").agg(F.sum("n").alias("n")).collect():  # at most ``size`` rows
        counts[r["length"]] = r["n"]
    table = lookup(plan_sequences(counts, size)[0], size)
    key = (table["length"] << 44) + table["low"]
    before = by.select("length", "__chunk", (F.sum("n").over(Window.partitionBy("length").orderBy("__chunk")) - F.col("n")).alias("__before"))
    ranked = pieces.withColumn("__rank", F.row_number().over(Window.partitionBy("length", "__chunk").orderBy("doc_id", "piece")) - 1)
    ranked = ranked.join(before, ["length", "__chunk"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("__rank") + F.col("__before")).alias("__rank"))
    fields = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])

    def place(batches):
        for b in batches:
            length, rank = np.asarray(b.column(3)), np.asarray(b.column(5))
            i = np.searchsorted(key, (length << 44) + rank, "right") - 1
            r = rank - table["low"][i]
            seq = table["base"][i] + r // table["each"][i]
            off = table["offset"][i] + r % table["each"][i] * length
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(seq, pa.int64()), pa.array(off, pa.int64())], schema=fields)

    return ranked.mapInArrow(place, PIECES + ", sequence_id long, offset long")
