"""Plain programs that the operators' results are held against."""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from math import log10

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def words(text):
    return WORD.findall(text or "")


def sha(b):
    return hashlib.sha256(b).hexdigest()


def components(ids, links):
    parent = {i: i for i in ids}

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    return {i: find(i) for i in ids}


def repeated_bytes(rows, length=50):
    """rows: (id, text) with distinct ids."""
    seen, out = set(), {}
    for i, text in sorted(rows):
        b = (text or "").encode()
        cover, mine = bytearray(len(b)), set()
        for p in range(len(b) - length + 1):
            w = b[p : p + length]
            mine.add(w)
            if w in seen:
                cover[p : p + length] = b"\1" * length
        seen |= mine
        spans = sum(1 for j in range(len(b)) if cover[j] and (j == 0 or not cover[j - 1]))
        out[i] = (len(b), sum(cover), spans, sha(bytes(x for x, c in zip(b, cover, strict=True) if not c)))
    return out


def repeated_words(rows, length=20):
    seen, out = set(), {}
    for i, text in sorted(rows):
        b = words(text)
        cover = [0] * len(b)
        for p in range(len(b) - length + 1):
            w = tuple(b[p : p + length])
            if w in seen:
                cover[p : p + length] = [1] * length
            seen.add(w)
        out[i] = (len(b), sum(cover), sha(" ".join(x for x, c in zip(b, cover, strict=True) if not c).encode()))
    return out


def shingles(text, n):
    w = words((text or "").translate(LOWER))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def near_documents(rows, n, percent=80):
    sets = {i: shingles(t, n) for i, t in rows}
    ids = [i for i in sorted(sets) if sets[i]]
    links = []
    for x, i in enumerate(ids):
        for j in ids[x + 1 :]:
            both = len(sets[i] & sets[j])
            if 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                links.append((i, j))
    found = components(sets, links)
    return {i: (len(sets[i]), found[i], found[i] == i) for i in sets}


def unigram(rows, held_out):
    """(n_tokens, n_known, train_tokens, base_score) by id."""
    tokens = {i: [*words((t or "").translate(LOWER)), None] for i, t in rows}
    count = Counter(x for i, ts in tokens.items() if not held_out(i) for x in ts)
    n, v = sum(count.values()), len(count)
    return {i: (len(ts), sum(count[x] > 0 for x in ts), n, sum(log10((count[x] + 1) / (n + v + 1)) for x in ts)) for i, ts in tokens.items()}


class ContextTree:
    """Context-tree weighting, bit by bit and recursively, by the book."""

    def __init__(self, texts, depth):
        self.depth, self.counts, self.scores = depth, Counter(), {}
        for (ctx, x), n in Counter(s for t in texts for s in self.symbols(t)).items():
            for bit in range(8):
                node, b = (1 << bit) | (x >> (8 - bit)), (x >> (7 - bit)) & 1
                for d in range(depth + 1):
                    self.counts[ctx[:d], node, b] += n

        self.children = {}
        for ctx, node, _ in self.counts:
            if ctx:
                self.children.setdefault((ctx[:-1], node), set()).add(ctx)
        self.memo = {}

    def symbols(self, text):
        b = b"\xff" * self.depth + (text or "").encode() + b"\xff"
        for i in range(self.depth, len(b)):
            yield bytes(b[i - 1 - k] for k in range(self.depth)), b[i]

    def block(self, ctx, node):
        """ln of estimate and of weighted probability."""
        from math import exp, lgamma, log, log1p, pi

        if (ctx, node) not in self.memo:
            a, b = self.counts[ctx, node, 0], self.counts[ctx, node, 1]
            own = lgamma(a + 0.5) + lgamma(b + 0.5) - lgamma(a + b + 1) - log(pi)
            if len(ctx) == self.depth:
                self.memo[ctx, node] = own, own, None
            else:
                below = sum(self.block(c, node)[1] for c in self.children.get((ctx, node), ()))
                hi, lo = max(own, below), min(own, below)
                self.memo[ctx, node] = own, log(0.5) + hi + log1p(exp(lo - hi)), below
        return self.memo[ctx, node]

    def p_one(self, ctx, node, d=0):
        from math import exp

        a, b = self.counts[ctx[:d], node, 0], self.counts[ctx[:d], node, 1]
        if d and not a + b:
            return 0.5
        own, _, below = self.block(ctx[:d], node)
        p = (b + 0.5) / (a + b + 1)
        if d == self.depth:
            return p
        w = 1 / (1 + exp(min(700, below - own)))
        return w * p + (1 - w) * self.p_one(ctx, node, d + 1)

    def score(self, text):
        return sum(self.score_symbol(ctx, x) for ctx, x in self.symbols(text))

    def score_symbol(self, ctx, x):
        if (ctx, x) not in self.scores:
            total = 0.0
            for bit in range(8):
                p = self.p_one(ctx, (1 << bit) | (x >> (8 - bit)))
                total += log10(p if (x >> (7 - bit)) & 1 else 1 - p)
            self.scores[ctx, x] = total
        return self.scores[ctx, x]
