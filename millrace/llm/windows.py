"""Windows of a fixed number of items (bytes or words) that occur more than once, by anchors.

A window's anchor is the smallest hash among the short grams inside it (winnowing), so equal windows have equal
anchors wherever they stand. Consecutive windows of a document with the same anchor form a run. Only runs whose anchor
occurs elsewhere can hold a repeated window; that filter loses nothing.
"""

from __future__ import annotations

import numpy as np

from millrace.llm import spread

U = np.uint64
TOP = U(0xFFFFFFFFFFFFFFFF)
EVEN = U(0xFFFFFFFFFFFFFFFE)
A, B, C = U(0x9E3779B97F4A7C15), U(0xC2B2AE3D27D4EB4F), U(0x165667B19E3779F9)
BASE = U(0xD6E8FEB86659FD93)
_LOW_BYTES = np.array([(1 << (8 * i)) - 1 for i in range(8)], np.uint64)
#: Windows of a run at most.
LONGEST_RUN = 1 << 14


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of uint64 values."""
    x = x ^ (x >> U(30))
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def words64(raw: np.ndarray, extra: int = 8) -> np.ndarray:
    """At each position the eight bytes from there, little-endian, zeros beyond the end; longer by ``extra``."""
    buf = np.zeros(len(raw) + extra + 8, np.uint8)
    buf[: len(raw)] = raw
    return np.ndarray((len(raw) + extra,), "<u8", buf, strides=(1,))


def span_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0, most: int = 1 << 18) -> np.ndarray:
    """A 64-bit hash of the bytes of each slice ``raw[start:end]``; slices may overlap. Another seed, an independent hash.

    A slice is read as eight-byte words. Each word is scrambled, scrambled again with its place, and the results are
    summed: as the scramble is not linear, no pattern of the text makes sums agree, unlike a polynomial modulo 2^64.
    Slices of eight bytes or fewer and one length never collide.
    """
    lens = np.asarray(ends, np.int64) - starts
    parts = (lens + 7) >> 3
    word, out = words64(raw), np.zeros(len(lens), np.uint64)
    salt = mix(np.array([seed + 1], np.uint64))
    for a, b in spread.blocks(parts, most):
        k = parts[a:b]
        head = np.cumsum(k) - k
        j = np.arange(int(k.sum()), dtype=np.int64) - np.repeat(head, k)
        x = word[np.repeat(starts[a:b], k) + 8 * j]
        left = np.repeat(lens[a:b], k) - 8 * j
        short = np.flatnonzero(left < 8)
        x[short] &= _LOW_BYTES[left[short]]
        x = mix(mix(x ^ salt) + (j + 1).astype(np.uint64) * A)
        some = np.flatnonzero(k)
        if len(some):
            out[a + some] = np.add.reduceat(x, head[some])
    return mix(out + lens.astype(np.uint64) * B + salt)


def byte_grams(raw: np.ndarray, k: int) -> np.ndarray:
    """An even 64-bit hash of the k bytes from each position (8 <= k <= 24)."""
    n = len(raw)
    w = words64(raw, k)
    h = w[:n] * A
    h ^= h >> U(29)
    h += w[k - 8 : k - 8 + n] * B
    if k > 16:
        mid = (k - 8) // 2
        h ^= h >> U(31)
        h *= C
        h += w[mid : mid + n] * BASE
    h ^= h >> U(32)
    h *= C
    h ^= h >> U(29)
    h &= EVEN
    return h


def item_grams(codes: np.ndarray, k: int) -> np.ndarray:
    """A hash of the k items from each position, by doubling; what reaches beyond the end is padded with zeros."""
    n = len(codes)
    out, have, at = None, 0, 1
    step = np.concatenate([codes, np.zeros(k, np.uint64)])
    rest = k
    while rest:
        if rest & 1:
            if out is None:
                out, have = step.copy(), at
            else:
                tail = step[have:]
                out = mix(out[: len(tail)] * B + tail)
                have += at
        rest >>= 1
        if rest:
            nxt = step[at:]
            step = np.concatenate([mix(step[: len(nxt)] * A + nxt), np.zeros(at, np.uint64)])
            at *= 2
    return out[:n]


def scattered(anchors: np.ndarray) -> np.ndarray:
    """Even hashes that are spread evenly, one for each anchor: as anchors are the least of many hashes, most of them are small, and
    ranges over their own values would be very uneven."""
    return mix(anchors) & EVEN


def sliding_min(h: np.ndarray, w: int) -> np.ndarray:
    """The least of the w values from each position, cut short at the end."""
    m, have = h.copy(), 1
    while have < w:
        step = min(have, w - have)
        np.minimum(m[:-step], m[step:], out=m[:-step]) if step < len(m) else None
        have += step
    return m


def runs(h: np.ndarray, starts: np.ndarray, ends: np.ndarray, k: int, length: int):
    """Runs of windows with one anchor: (first window, end, anchor, document index), in order of place.

    ``h``: gram hashes by position (changed here); documents are ``[starts, ends)``, one after another.
    """
    n = len(h)
    ok = ends - starts >= length
    if not ok.any():
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(0, np.uint64), z
    for s, e in zip(starts.tolist(), ends.tolist(), strict=True):
        h[max(s, e - k + 1) : e] = TOP
    m = sliding_min(h, length - k + 1)
    change = np.empty(n, bool)
    change[0] = True
    np.not_equal(m[1:], m[:-1], out=change[1:])
    change[starts[ok]] = True
    edge = np.zeros(n + 1, np.int8)
    edge[starts[ok]] += 1
    edge[ends[ok] - length + 1] -= 1
    change &= np.cumsum(edge[:-1], dtype=np.int8).astype(bool)
    first = np.flatnonzero(change)
    doc = np.searchsorted(starts, first, "right") - 1
    # empty documents share a start with their successor; searchsorted right takes the last, which holds the window
    end = ends[doc] - length + 1
    same = np.flatnonzero(doc[1:] == doc[:-1])
    end[same] = first[same + 1]
    anchor = m[first]
    parts = -(-(end - first) // LONGEST_RUN)
    if len(parts) and parts.max() > 1:  # over text that repeats itself; a cut run is two runs with one anchor
        top = np.repeat(end, parts)
        first = np.repeat(first, parts) + (np.arange(int(parts.sum())) - np.repeat(np.cumsum(parts) - parts, parts)) * LONGEST_RUN
        end, anchor, doc = np.minimum(first + LONGEST_RUN, top), np.repeat(anchor, parts), np.repeat(doc, parts)
    return first, end, anchor, doc


def word_tokens(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray):
    """Words ``[^\\x20\\x09-\\x0D]+`` of documents in one buffer: (start, end, hash of its bytes, document index)."""
    n = len(raw)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(0, np.uint64), z
    word = (raw != 32) & ((raw < 9) | (raw > 13))
    open_ = np.empty(n, bool)
    open_[0] = word[0]
    np.greater(word[1:], word[:-1], out=open_[1:])
    head = starts[(starts < n) & (starts < ends)]
    open_[head] |= word[head]
    begin = np.flatnonzero(open_)
    close = np.empty(n, bool)
    close[-1] = word[-1]
    np.greater(word[:-1], word[1:], out=close[:-1])
    tail = ends[ends > starts] - 1
    close[tail] |= word[tail]
    stop = np.flatnonzero(close) + 1
    doc = np.searchsorted(starts, begin, "right") - 1
    return begin, stop, span_hashes(raw, begin, stop), doc


def lower_ascii(raw: np.ndarray) -> np.ndarray:
    return np.where((raw >= 65) & (raw <= 90), raw + 32, raw).astype(np.uint8)


def segments(starts: np.ndarray, ends: np.ndarray, length: int, size: int = 1 << 18, cut: int = 1 << 21):
    """Cut consecutive documents into slices of about ``size`` items, to bound memory and stay in cache: (base, starts,
    ends, documents), places relative to base. A document over ``cut`` items is cut into parts that overlap by
    length - 1, so that each window is in exactly one of them."""
    n, at = len(starts), 0
    while at < n:
        to = min(n, max(at + 1, int(np.searchsorted(ends, starts[at] + size, "right"))))
        base, stop = int(starts[at]), int(ends[to - 1])
        if stop - base > cut:
            one = np.zeros(1, np.int64)
            for a in range(base, stop - length + 1, cut):
                yield a, one, np.array([min(a + cut + length - 1, stop) - a]), np.array([at])
        else:
            yield base, starts[at:to] - base, ends[at:to] - base, np.arange(at, to)
        at = to
