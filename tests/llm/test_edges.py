"""Nulls, empty and very long texts, ties and repeated rows, empty tables, and columns with clashing names."""

import os

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from millrace.llm import chat, ctw, embedding_dedup, minhash, mixing, packing, quality, spread, substring_dedup, suffix_dedup, url_filter
from tests.llm import brute

LONG = "the quick brown fox " * 30_000
PASSAGE = " ".join(f"passage{i}" for i in range(60))
ROWS = [
    (1, "en", "s", "one " + PASSAGE),
    (2, "en", "s", PASSAGE + " two"),
    (2, "en", "s", PASSAGE + " two"),
    (3, None, None, None),
    (4, "en", "s", ""),
    (5, "de", "s", " \n\t "),
    (6, "de", "t", "word"),
    (7, "de", "t", "WORD"),
    (8, "fr", "t", LONG),
    (9, "fr", "t", LONG + "x"),
    (10, "fr", "t", "é" * 49 + "日本語 " + PASSAGE),
    (None, "fr", "t", PASSAGE),
]
DDL = "doc_id long, lang string, source string, text string, __shard int, kept string, a long, label string"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, 1, "x", 2, "y") for r in ROWS], DDL).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DDL)


def distinct_rows():
    return [(i, t) for k, (i, _, _, t) in enumerate(ROWS) if i is not None and k != 2]


@pytest.mark.parametrize(("f", "plain"), [(suffix_dedup.remove_repeated_bytes, brute.repeated_bytes), (substring_dedup.remove_repeated_words, brute.repeated_words)])
def test_substrings(docs, none, f, plain):
    got = f(docs, keep=("a",), keep_text=True).collect()
    want = plain(distinct_rows())
    assert len(got) == len(ROWS)
    for r in got:
        row = tuple(r.asDict()[c] for c in r.__fields__ if c not in ("doc_id", "a", "kept_text"))
        assert r.a == 2
        if r.doc_id is not None:
            assert row == want[r.doc_id]
        else:
            assert r.n_removed == 0
    assert f(none).collect() == []


@pytest.mark.parametrize("f", [suffix_dedup.remove_repeated_bytes, substring_dedup.remove_repeated_words])
def test_one_id_over_two_texts(spark, f):
    """One row of an id is a copy of an earlier document; the other one's own text stays, and later documents are held against it."""
    own = " ".join(f"own{i}" for i in range(60))
    rows = [(1, PASSAGE), (2, PASSAGE), (2, own), (3, own + " more"), (3, own + " more")]
    got = sorted((r.doc_id, r.kept_text) for r in f(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), keep_text=True).collect())
    assert [(i, t.strip()) for i, t in got] == [(1, PASSAGE), (2, ""), (2, own), (3, "more"), (3, "more")]


@pytest.mark.parametrize("common", [0, 2, 10**6])
def test_common_anchors(spark, common):
    """One passage in every document, among own words and copies: by strings alone, by both ways, by runs alone."""
    rng, rows = np.random.default_rng(8), []
    for i in range(90):
        own = [f"w{int(x)}" for x in rng.integers(0, 30 if i % 2 else 10**6, 40)]
        at = int(rng.integers(0, 40))
        rows.append((i, " ".join([*own[:at], *PASSAGE.split()[: int(rng.integers(20, 60))], *own[at:]]) + "ab" * (i % 5) * 40))
    rows.append((90, rows[3][1]))
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.remove_repeated_bytes(table, common=common).collect()}
    assert got == brute.repeated_bytes(rows)


def test_suffix_shards_merge():
    """A range over several suffix shards gives the same least documents as one shard does."""
    import numpy as np

    rng = np.random.default_rng(2)
    text = rng.integers(97, 100, 400).astype(np.uint8)
    cuts = rng.integers(0, 300, 60)
    lens = rng.integers(50, 100, 60)
    raw = np.concatenate([text[c : c + n] for c, n in zip(cuts, lens, strict=True)])
    doc = rng.permutation(60)
    starts = np.cumsum(lens) - lens
    group = np.zeros(60, np.uint32)
    one = suffix_dedup.least_documents(raw, starts, lens, doc, group, 50)
    many = suffix_dedup.least_documents(raw, starts, lens, doc, group, 50, size=500)
    first = {}
    for s, n, d in zip(starts, lens, doc, strict=True):
        for p in range(s, s + n - 49):
            w = raw[p : p + 50].tobytes()
            first[w] = min(first.get(w, 10**9), d)
    want = [first[raw[p : p + 50].tobytes()] for s, n in zip(starts, lens, strict=True) for p in range(s, s + n - 49)]
    assert one.tolist() == many.tolist() == want
    # groups that share no string, some larger than a suffix shard
    group = np.sort(rng.integers(0, 5, 60)).astype(np.uint32)
    mark = np.concatenate([np.full(n, 65 + g, np.uint8) for n, g in zip(lens, group, strict=True)])
    raw = np.where(rng.integers(0, 9, 400)[np.concatenate([c + np.arange(n) for c, n in zip(cuts, lens, strict=True)]) % 400] == 0, mark, raw)
    whole = suffix_dedup.least_documents(raw, starts, lens, doc, np.zeros(60, np.uint32), 50)
    apart = suffix_dedup.least_documents(raw, starts, lens, doc, group, 50, size=700)
    assert whole.tolist() == apart.tolist()


def test_minhash(docs, none):
    got = minhash.near_duplicates(docs, words=2).collect()
    want = brute.near_documents(distinct_rows(), 2)
    assert len(got) == len(ROWS)
    for r in got:
        assert (r.n_shingles, r.component_id, r.kept) == (want[r.doc_id] if r.doc_id is not None else (59, None, True))
    assert minhash.near_duplicates(none).collect() == []


def test_minhash_hot_buckets(spark, monkeypatch):
    """Buckets and families of many small blocks: texts that share a stem, some of them near copies, most of them not."""
    monkeypatch.setattr(minhash, "BLOCK", 4)
    rng = np.random.default_rng(5)
    stem, rows = [f"stem{i}" for i in range(60)], []
    for i in range(120):
        own = [f"own{i if i % 3 else i // 12}x{j}" for j in range(int(rng.integers(0, 120)))]
        rows.append((i, " ".join(stem + own)))
    rows += [(200 + i, t + " tail") for i, t in rows[:40]]
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), words=2).collect()}
    assert got == brute.near_documents(rows, 2)


WORD = "ab"
while len(WORD) < 2048:  # Thue and Morse's word: a polynomial modulo 2^64 can't tell it from its mirror
    WORD += WORD.translate(str.maketrans("ab", "ba"))
MIRROR = WORD.translate(str.maketrans("ab", "ba"))


def test_words_that_fool_polynomials(spark):
    passage = " ".join(WORD[i : i + 64] for i in range(0, 2048, 64))
    mirror = " ".join(MIRROR[i : i + 64] for i in range(0, 2048, 64))
    rows = [(1, WORD), (2, MIRROR), (3, WORD + "\n" + MIRROR), (4, "4 " + passage), (5, "5 " + mirror), (6, "6 " + passage)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.n_dup_lines for r in quality.quality(table).collect()} == dict.fromkeys(range(1, 7), 0)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(table, words=2).collect()}
    assert got == brute.near_documents(rows, 2)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.remove_repeated_words(table).collect()}
    assert got == brute.repeated_words(rows)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.remove_repeated_bytes(table).collect()}
    assert got == brute.repeated_bytes(rows)
    base = brute.unigram(rows, lambda i: i == 2)
    scored = {r.doc_id: r.n_known for r in ctw.score_texts(table, F.col("doc_id") == 2).collect()}
    assert scored == {i: base[i][1] for i, _ in rows}


def test_quality(docs, none):
    got = {r.doc_id: r for r in quality.quality(docs).collect()}
    assert got[3].n_words == got[4].n_words == got[5].n_words == 0 and got[3].base_failed and not got[3].kept
    assert got[1].kept and not got[8].kept
    assert got[8].n_words == 120_000 and got[8].n_repeat_words == 120_000 and got[8].dup_chars_10 == got[8].word_chars
    assert quality.quality(none).collect() == []
    with pytest.raises(ValueError):
        quality.quality(docs, keep=("doc_id", "kept"))


def test_mixing(docs, none):
    got = mixing.mix(docs, fraction=0.8).collect()
    assert len(got) == len(ROWS) and all(0 <= r.prob <= 1 for r in got)
    assert mixing.mix(none).collect() == []
    tokens = sum(r.n_tokens * r.prob for r in got)
    assert abs(tokens / sum(r.n_tokens for r in got) - 0.8) < 1e-3


def test_raking_meets_targets(spark):
    cells = spark.createDataFrame([(s, x, 10 * i + 7 * j + 3) for i, s in enumerate("abc") for j, x in enumerate("xy")], "source string, lang string, tokens long")
    targets = {"source": {"a": 0.5, "b": 0.3, "c": 0.2}, "lang": {"x": 0.25, "y": 0.75}}
    frames = {d: spark.createDataFrame(list(t.items()), "value string, share double") for d, t in targets.items()}
    out, gap = mixing.rake(cells, frames)
    out = out.collect()
    assert gap < 1e-9
    total = sum(r.w for r in out)
    for d, t in targets.items():
        for v, share in t.items():
            assert abs(sum(r.w for r in out if r[d] == v) / total - share) < 1e-6


def test_targets_that_cannot_hold(spark):
    rows = [(1, "a", "x", "t w " * 5), (2, "b", "y", "t w " * 5), (3, None, "y", "t"), (4, "", "y", "t"), (5, "\x00", "x", "t")]
    table = spark.createDataFrame(rows, "doc_id long, source string, lang string, text string")
    given = {"source": {"a": 0.9, "b": 0.1}, "lang": {"y": 0.9, "x": 0.1}}
    with pytest.raises(ValueError, match="off"):
        mixing.mix(table.where("doc_id < 3"), dimensions=("source", "lang"), targets=given)
    got = {r.doc_id: r for r in mixing.mix(table, dimensions=("source", "lang"), power=1.0).collect()}
    assert all(abs(r.weight - 1) < 1e-5 and r.target_gap == 0 for r in got.values())
    given = {"source": {"a": 0.4, "b": 0.4, None: 0.1, "": 0.05, "\x00": 0.05}}
    got = {r.doc_id: r for r in mixing.mix(table, dimensions=("source",), targets=given).collect()}
    assert {i: round(r.weight * r.n_tokens / 23, 6) for i, r in got.items()} == {1: 0.4, 2: 0.4, 3: 0.1, 4: 0.05, 5: 0.05}
    sparse = mixing.mix(table.where("doc_id < 3"), dimensions=("source", "lang")).collect()
    assert all(0 <= r.prob <= 1 for r in sparse)


def test_chat(spark):
    rows = [(1, 0, "user", "a <| b <\\| <\\\\| <n"), (1, 1, "assistant", None), (2, None, None, "x"), (None, 0, "us\ner<n<|", "<|im_end|>\n<|im_start|>user\n"), (3, 0, "user", "same"), (3, 0, "user", "same")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in chat.read_back(chat.format_conversations(table)).collect()}
    assert [tuple(t) for t in got[1].turns] == [("user", rows[0][3]), ("assistant", "")] and got[1].valid
    assert [tuple(t) for t in got[None].turns] == [rows[3][2:]]
    assert [tuple(t) for t in got[2].turns] == [("", "x")] and got[2].first_bad == 0
    assert len(got[3].turns) == 2 and not got[3].valid and got[3].first_bad == 1
    assert got[1].loss_texts == [""]
    assert chat.format_conversations(table.where("false")).collect() == []


def test_packing(docs, none):
    got = packing.pack(docs).collect()
    assert {r.doc_id for r in got if r.length == 1} >= {3, 4}
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append(r)
    for rows in by.values():
        at = 0
        for r in sorted(rows, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 1024
    assert sum(r.doc_id == 2 and r.piece == 0 for r in got) == 2
    assert packing.pack(none).collect() == []


def test_special_string_has_its_id(spark):
    from tokenizers import Tokenizer

    import public_tokenizers

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    encode = packing.encoder("byte_bpe_50k.json")
    for text in ("a <|endoftext|> b", "naïve café – “x” 3½  \n\n it's", "日本語 \U0001f600 mixed", "\x1c\x85\xa0  x", ""):
        assert encode(text).tolist() == t.encode(text, add_special_tokens=False).ids


def test_vectors(spark):
    v = [1.0, 0.0]
    rows = [(1, v, 1), (2, v, 1), (2, v, 1), (3, [2.0, 0.1], 1), (4, v, 2), (5, v, None), (6, None, 1), (7, [0.0, 0.0], 1), (8, [float("nan"), 1.0], 1), (9, [None, 1.0], 1), (10, [], 1), (11, [1.0, 0.0, 0.0], 1), (12, [-0.0, 1.0], 1), (13, [0.0, 1.0], 1)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embedding_dedup.near_vectors(table).collect()}
    assert got[1] == (3, 1, True) and got[2][1:] == (1, False) and got[3] == (3, 1, False)
    assert all(got[i] == (0, i, True) for i in (4, 5, 6, 7, 8, 9, 10, 11))
    assert got[12] == (1, 12, True) and got[13] == (1, 12, False)
    assert embedding_dedup.near_vectors(table.where("false")).collect() == []


def test_urls(spark):
    rules = [url_filter.Rule("block", "bad.com", "/"), url_filter.Rule("allow", "good.bad.com", "/")]
    link = '<link rel="canonical" href="{}">'
    rows = [(1, "http://bad.com/x", ""), (2, "http://a.org/1", link.format("http://b.org/2")), (3, "http://b.org/2#f", link.format("https://bad.com/y")), (4, "https://c.org/", link.format("http://good.bad.com/z") + '<meta http-equiv="refresh" content="0; url=http://bad.com/y2">'), (5, None, None), (6, "no host", "x"), (7, "HTTP://A.ORG/1", None), (1, "http://bad.com/x", "")]
    got = [(r.page_id, r.host, r.path, r.rule, r.verdict) for r in url_filter.filter_urls(spark.createDataFrame(rows, "page_id long, url string, html string"), rules).collect()]
    by = {g[0]: g for g in got}
    assert len(got) == len(rows) and by[1][3:] == ("bad.com/", "block")
    assert by[2][4] == by[3][4] == by[7][4] == "block" and by[2][3] is None
    assert by[4][4] == "allow" and by[5] == (5, "", "", None, "allow") and by[6][4] == "allow"


def test_long_texts_and_clashing_columns(spark):
    """What the other tests leave out of very long values, further columns of any name, and empty tables."""
    long = "x<|" * 200_000
    rows = [(1, 0, "user", long, 1, "a", "b", "c"), (1, 1, "assistant", long + "|>", 1, "a", "b", "c")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, turns int, formatted string, valid string, segments string")
    (got,) = chat.read_back(chat.format_conversations(table)).collect()
    assert [t.text for t in got.turns] == [long, long + "|>"] and got.valid and got.loss_texts == [long + "|>"]
    v = [(1, [1.0, 0.0], 1, 5, "x", True), (2, [1.0, 0.0], 1, 5, "x", True)]
    table = spark.createDataFrame(v, "vec_id long, embedding array<float>, label int, n_links int, component_id string, kept boolean")
    assert sorted(tuple(r)[:4] for r in embedding_dedup.near_vectors(table).collect()) == [(1, 1, 1, True), (2, 1, 1, False)]
    rules = [url_filter.Rule("block", "bad.com", "/")]
    url = "http://bad.com/" + "y" * 100_000
    pages = spark.createDataFrame([(1, url, f'<link rel="canonical" href="{url}z">', 1, "h", "v"), (2, None, None, 1, "h", "v")], "page_id long, url string, html string, rule int, host string, verdict string")
    got = {r.page_id: (r.host, len(r.path), r.rule, r.verdict) for r in url_filter.filter_urls(pages, rules).collect()}
    assert got == {1: ("bad.com", 100_001, "bad.com/", "block"), 2: ("", 0, None, "allow")}
    assert url_filter.filter_urls(pages.where("false"), rules).collect() == []


def test_ctw(docs, none):
    got = ctw.score_texts(docs, F.col("doc_id") == 6, depth=2).collect()
    assert len(got) == len(ROWS) and all(r.score < 0 for r in got)
    assert ctw.score_texts(none, F.lit(False), depth=2).collect() == []
    untrained = ctw.score_texts(docs.where("doc_id = 6"), F.lit(True), depth=2).first()
    assert untrained.train_tokens == 0 and abs(untrained.bits_per_byte - 8) < 1e-9


def test_ctw_hot_ranges(docs, monkeypatch):
    """Ranges that answer in many groups, and deeper trees than fit the fast sort, give the scores that they should."""
    held = F.col("doc_id") == 6
    one = {(r.doc_id, r.n_bytes): r.score for r in ctw.score_texts(docs, held, depth=3).collect()}
    monkeypatch.setattr(ctw, "ASKED", 50)
    many = ctw.score_texts(docs, held, depth=3).collect()
    assert all(np.isclose(one[r.doc_id, r.n_bytes], r.score, rtol=1e-12) for r in many) and len(many) == len(ROWS)
    texts = [(i, t) for i, t in distinct_rows() if i not in (8, 9)]
    tree = brute.ContextTree([t for i, t in texts if i != 6], 6)
    table = docs.sparkSession.createDataFrame(texts, "doc_id long, text string")
    for r in ctw.score_texts(table, held, depth=6).collect():
        assert np.isclose(r.score, tree.score(dict(texts)[r.doc_id]), rtol=1e-9)


def test_ctw_counts_in_parts():
    """A task that may hold few keys sends them in parts whose sums are the whole counts; one context has a third of all strings."""
    texts = ["e " * 500 + f"e {i} word{i} " * 20 for i in range(30)]
    batch = pa.record_batch([pa.array(texts)], names=["__text"])
    out = {}
    for most in (20, 1 << 20):
        have = {}
        for b in ctw.count_training(4, 3, most)(iter([batch, batch])):
            for r in b.to_pylist():
                have[r["__range"], r["__key"]] = have.get((r["__range"], r["__key"]), 0) + r["__count"]
        out[most] = have
    assert out[20] == out[1 << 20] and sum(c for (r, _), c in out[20].items() if r >= 3) == 2 * sum(len(t) + 1 for t in texts)


def test_scratch_tables_go(spark, tmp_path):
    root = spread.shared_folder(spark).removeprefix("file:")
    with spread.scratch(spark):
        spread.settle(spark.range(5)).write.parquet(str(tmp_path / "out"))
        inside = set(os.listdir(f"{root}/millrace"))
    assert len(inside - set(os.listdir(f"{root}/millrace"))) == 1
    assert spark.read.parquet(str(tmp_path / "out")).count() == 5


def test_components(spark):
    chain = [(i, i + 1) for i in range(200)] + [(500, 501), (501, 500), (7, 7), (None, 3)]
    got = {r.node: r.component for r in spread.connected_components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(201)}, 500: 500, 501: 500}


@pytest.mark.parametrize("leaf", [150, 4096])
def test_every_link_of_vectors_is_found(spark, monkeypatch, leaf):
    """Lone pairs in an isotropic label, in one that shares a direction, and in one of vectors just under the threshold; all against brute force."""
    monkeypatch.setattr(embedding_dedup, "LEAF", leaf, raising=False)
    rng, rows = np.random.default_rng(11), []

    def near(v, cosine):
        w = rng.standard_normal(v.shape)
        w -= (w * v).sum(axis=1)[:, None] * v
        return cosine * v + np.sqrt(1 - cosine**2) * w / np.linalg.norm(w, axis=1)[:, None]

    for label, (mean, n) in enumerate([(0.0, 2000), (0.8, 2500), (0.9795, 5000), (0.97, 140)]):
        c = np.zeros(32)
        c[0] = 1
        g = rng.standard_normal((n, 32))
        g[:, 0] = 0
        v = np.sqrt(mean) * c + np.sqrt(1 - mean) * g / np.linalg.norm(g, axis=1)[:, None]
        v = np.vstack([v, near(v[:100], 0.981)])
        rows += [(i, x, label) for i, x in enumerate(rng.permutation(v).astype(np.float32).tolist(), len(rows))]
    rows += [(len(rows) + i, [float(2**i), 0.0], 9) for i in range(40)]  # a direction that nothing divides
    n_links, links = {}, []
    for label in {r[2] for r in rows}:
        ids = np.array([r[0] for r in rows if r[2] == label])
        u = np.array([r[1] for r in rows if r[2] == label])
        u /= np.linalg.norm(u, axis=1)[:, None]
        hit = u @ u.T >= 0.98
        np.fill_diagonal(hit, False)
        n_links |= dict(zip(ids.tolist(), hit.sum(axis=1).tolist(), strict=True))
        links += [(ids[a], ids[b]) for a, b in zip(*np.nonzero(np.triu(hit)), strict=True)]
    root = spread.union_find(len(rows), *np.array(links).T)
    got = embedding_dedup.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()
    assert {r.vec_id: (r.n_links, r.component_id, r.kept) for r in got} == {i: (n, int(root[i]), root[i] == i) for i, n in n_links.items()}


LINKS = [
    ('<link rel="canonical" href="/a"><link rel="canonical" href="http://b.org/2">', ["http://p.org/a", "http://b.org/2"]),
    ('<meta http-equiv="refresh" content="0; url=/r1"><meta http-equiv="refresh" content="5; url=/r2?url=x">', ["http://p.org/r1", "http://p.org/r2?url=x"]),
    ("<meta content='0;url=page.html' http-equiv=refresh>", ["http://p.org/d/e/page.html"]),
    ('<link rel="canonical" href="?id=1">', ["http://p.org/d/e/f?id=1"]),
    ('<link rel="canonical" href="../x">', ["http://p.org/d/x"]),
    ('<link href="../../../.." rel="canonical">', ["http://p.org/"]),
    ('<link rel="canonical" href="./">', ["http://p.org/d/e/"]),
    ('<link rel="canonical" href="/s?a=1&amp;b=2&#38;c=3&copy=4">', ["http://p.org/s?a=1&b=2&c=3&copy=4"]),
    ('<link rel="canonical" href="//q.org/y">', ["http://q.org/y"]),
    ('<link rel="canonical" href="/to?u=http://z.org/">', ["http://p.org/to?u=http://z.org/"]),
    ('<base href="/base/"><link rel="canonical" href="z">', ["http://p.org/base/z"]),
    ('<link rel="canonical" href="mailto:a@b.org">', []),
]


def test_every_link_spreads(spark):
    """Each form of link: the targets by hand, and a block that reaches each page by a closure over them."""
    pages = [(i, f"http://p.org/d/e/f?n={i}#top", x.replace('"?id=1"', f'"?id={i}"')) for i, (x, _) in enumerate(LINKS)]
    table = spark.createDataFrame(pages, "page_id long, url string, html string")
    want = {(pages[i][1], t.replace("?id=1", f"?id={i}")) for i, (_, ts) in enumerate(LINKS) for t in ts}
    assert {tuple(r) for r in url_filter.links_of(table).collect()} == want
    for target in ("http://b.org/2", "http://p.org/d/e/page.html", "http://p.org/s"):
        host, _, path = target.removeprefix("http://").partition("/")
        rules = [url_filter.Rule("block", host, "/" + path.partition("?")[0])]
        blocked = lambda u: (x := u.removeprefix("http://").partition("/"))[0] == host and ("/" + x[2].partition("?")[0]).startswith(rules[0].path)  # noqa: E731, B023
        reach = {u for u, t in want if blocked(t)} | {u for _, u, _ in pages if blocked(u)}
        size = 0
        while len(reach) != size:
            size = len(reach)
            reach |= {u for u, t in want if t in {t for v, t in want if v in reach}}
        got = {r.page_id for r in url_filter.filter_urls(table, rules).where("verdict = 'block'").collect()}
        assert got == {i for i, u, _ in pages if u in reach} != set(), target
