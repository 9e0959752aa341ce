"""Quality rules by repetition coverage.

Rolling hashes of several n-gram lengths are taken over a batch of texts at once in numpy; duplicated hashes within a
document mark their words, and the characters of marked words and of repeated lines give the coverage that the rules
bound. One pass over the rows, no shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import BooleanType, LongType, StructField, StructType

from millrace.llm import spread, windows
from millrace.llm.windows import U


@dataclass(frozen=True)
class Rules:
    """A document is kept unless it breaks one of these. Coverage limits are shares of the characters in words."""

    min_words: int = 50
    max_repeat_words: float = 0.5  # words in 3-word windows found twice or more
    max_line_chars: float = 0.3  # characters of lines equal to an earlier one
    max_gram_chars: tuple[tuple[int, float], ...] = ((5, 0.35), (10, 0.25))  # words a gram: limit
    max_symbols: float = 0.1  # of the characters in words


SYMBOL = np.zeros(256, bool)
SYMBOL[np.frombuffer(b"#*$%&|<>", np.uint8)] = True
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "dup_line_chars")


def _per_doc(flags: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[ends] - total[starts]


def _duplicated(keys: np.ndarray) -> np.ndarray:
    """Which keys occur twice or more."""
    s = np.sort(keys)
    twice = np.unique(s[1:][s[1:] == s[:-1]])
    if not len(twice):
        return np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(twice, keys), len(twice) - 1)
    return twice[at] == keys


def _covered(code: np.ndarray, doc: np.ndarray, n: int, within: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Words in n-word windows of their document that occur twice or more, and the windows' starts. within: starts of
    shorter windows that do; others can't."""
    at = np.arange(max(0, len(code) - n + 1)) if within is None else within[within + n <= len(code)]
    at = at[doc[at] == doc[at + n - 1]]
    gram = windows.item_grams(code, n)[at]
    at = at[_duplicated(windows.mix(gram + doc[at].astype(np.uint64) * windows.A))]
    edge = np.zeros(len(code) + 1, np.int64)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + n, -1)
    return np.cumsum(edge[:-1]) > 0, at


def measure(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, grams: tuple[int, ...]) -> dict[str, np.ndarray]:
    """The counts of each document of a buffer."""
    n = len(starts)
    begin, stop, code, doc = windows.word_tokens(raw, starts, ends)
    out = {"n_words": np.bincount(doc, minlength=n).astype(np.int64)}
    word = (raw != 32) & ((raw < 9) | (raw > 13))
    points = word & ((raw & 0xC0) != 0x80)
    out["word_chars"] = _per_doc(points, starts, ends)
    out["n_symbols"] = _per_doc(SYMBOL[raw], starts, ends)
    chars = np.zeros(len(raw) + 1, np.int64)
    np.cumsum(points, out=chars[1:])
    word_chars = chars[stop] - chars[begin]
    covered, at = _covered(code, doc, 3, None)
    out["n_repeat_words"] = np.bincount(doc[covered], minlength=n).astype(np.int64)
    for g in sorted(grams):
        covered, at = _covered(code, doc, g, at if g >= 3 else None)
        out[f"dup_chars_{g}"] = np.bincount(doc[covered], weights=word_chars[covered], minlength=n).astype(np.int64)
    # lines: from a document's start or after a line feed, to the next line feed or the document's end
    feed = np.flatnonzero(raw == 10)
    heads = np.unique(np.r_[starts[ends > starts], feed + 1])
    heads = heads[heads < len(raw)]
    tails = np.minimum(np.r_[heads[1:], len(raw)], ends[np.searchsorted(starts, heads, "right") - 1]) if len(heads) else heads
    tails = tails - ((tails > heads) & (raw[np.maximum(tails - 1, 0)] == 10)) if len(heads) else tails
    words_at = np.zeros(len(raw) + 1, np.int64)
    np.cumsum(word, out=words_at[1:])
    real = words_at[tails] > words_at[heads] if len(heads) else np.zeros(0, bool)
    heads, tails = heads[real], tails[real]
    line_doc = np.searchsorted(starts, heads, "right") - 1
    key = windows.mix(windows.span_hashes(raw, heads, tails) + line_doc.astype(np.uint64) * windows.B)
    order = np.argsort(key, kind="stable")
    k = key[order]
    again = np.zeros(len(k), bool)
    again[order[1:]] = k[1:] == k[:-1]
    out["n_dup_lines"] = np.bincount(line_doc[again], minlength=n).astype(np.int64)
    out["dup_line_chars"] = np.bincount(line_doc[again], weights=(chars[tails] - chars[heads])[again], minlength=n).astype(np.int64)
    return out


def judge(m: dict[str, np.ndarray], rules: Rules) -> tuple[np.ndarray, np.ndarray]:
    """(base_failed, kept)."""
    failed = (m["n_words"] < rules.min_words) | (m["n_repeat_words"] > rules.max_repeat_words * m["n_words"])
    bad = m["dup_line_chars"] > rules.max_line_chars * m["word_chars"]
    bad |= m["n_symbols"] > rules.max_symbols * m["word_chars"]
    for g, limit in rules.max_gram_chars:
        bad |= m[f"dup_chars_{g}"] > limit * m["word_chars"]
    return failed, ~failed & ~bad


def quality(docs: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), rules: Rules = Rules(), only_kept: bool = False) -> DataFrame:
    """The columns in ``keep``, the counts, dup_chars_N for each gram length, base_failed and kept; one row a row of
    ``docs``, or only the kept ones.

    A null or empty text has no words, so it fails the base rules. Each row is judged alone, so repeated rows and null
    ids make no difference. No rows give no rows. A name in ``keep`` that a count also has is refused.
    """
    grams = tuple(g for g, _ in rules.max_gram_chars)
    names = [*COUNTS, *(f"dup_chars_{g}" for g in grams)]
    if clash := {*keep} & {*names, "base_failed", "kept"}:
        raise ValueError(f"rename these columns first: {sorted(clash)}")
    base = docs.select(*keep, docs[text_col].alias("__text"))
    schema = StructType([*base.select(*keep).schema.fields, *(StructField(x, LongType()) for x in names), StructField("base_failed", BooleanType()), StructField("kept", BooleanType())])
    fields = to_arrow_schema(schema)

    def step(batches):
        for batch in batches:
            raw, at = spread.column_bytes(batch.column(batch.schema.get_field_index("__text")))
            parts = []
            for _, s, e, docs_ in windows.segments(at[:-1], at[1:], 1, cut=1 << 62) if batch.num_rows else ():
                base_at = int(at[docs_[0]])
                parts.append(measure(raw[base_at : base_at + int(e[-1])], s, e, grams))
            if not parts:
                continue
            m = {k: np.concatenate([p[k] for p in parts]) for k in parts[0]}
            failed, kept = judge(m, rules)
            cols = [batch.column(batch.schema.get_field_index(k)) for k in keep] + [pa.array(m[k], pa.int64()) for k in names] + [pa.array(failed), pa.array(kept)]
            out = pa.RecordBatch.from_arrays(cols, names=fields.names)
            out = pa.Table.from_batches([out]).cast(fields)
            yield from (out.filter(pa.array(kept)) if only_kept else out).to_batches()

    return base.mapInArrow(spread.rows_giving_back(step), schema)
