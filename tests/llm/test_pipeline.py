"""Each stage of the pipeline, held on its own input against plain programs."""

import os
import zlib
from collections import defaultdict

import corpus_pipeline
import duckdb
import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from millrace.llm import packing, queries, spread
from tests.llm import brute

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "lang", "n_chars", "source", "text"]


def kept_bytes(rows, length=50):
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
        out[i] = bytes(x for x, c in zip(b, cover, strict=True) if not c).decode("utf-8", "ignore")
    return out


def packed_well(got, rows):
    """Every document's ids once and in order, sequences without gaps and as few as the plan for their lengths has."""
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in got:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
    assert set(by_doc) == set(rows)
    for i, text in rows.items():
        ids, at = [*t.encode(text or "", add_special_tokens=False).ids, 2], 0
        for n, r in enumerate(sorted(by_doc[i], key=lambda r: r.piece)):
            assert (r.piece, r.start) == (n, at) and r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)
    for pieces in by_seq.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 1024
    plan, bound = packing.plan_sequences(np.bincount([r.length for r in got], minlength=1025))
    assert len(by_seq) == sum(n for _, n in plan) <= 1.02 * bound + 1
    return set(by_seq)


WORDS = " ".join(f"word{i}" for i in range(80))
ODD = [(1, WORDS + " one"), (2, WORDS + " two"), (2, WORDS + " two"), (3, None), (4, ""), (5, "x " * 40_000), (6, " ".join(f"own{i}" for i in range(70))), (None, " ".join(f"free{i}" for i in range(70)))]


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stages_on_odd_rows(spark, name, stage):
    """Nulls, empty and long texts, repeated rows, rows without id, columns with clashing names, and no rows at all."""
    ddl = "doc_id long, text string, lang string, source string, n_chars long, kept string, __shard int, weight double"
    docs = spark.createDataFrame([(i, t, None if i == 6 else "en", "s", len(t or ""), "k", 1, 2.0) for i, t in ODD], ddl).repartition(3)
    out = stage(spark, docs, SF)
    got = out.collect()
    ids = sorted((r.doc_id for r in got), key=str)
    if name == "quality":
        assert ids == [1, 2, 2, 6, None]
    elif name == "minhash":
        assert ids == [1, 3, 4, 5, 6, None]
    elif name == "suffix":
        assert ids == [1, 2, 2, 3, 4, 5, 6, None]
        assert [r.text for r in got if r.doc_id == 2] == ["two", "two"]
    elif name == "mixing":
        assert set(ids) <= {1, 2, 3, 4, 5, 6, None} and all(r.text == dict(ODD)[r.doc_id] for r in got)
    else:
        assert sorted({r.doc_id for r in got}, key=str) == [1, 2, 3, 4, 5, 6, None] and sum(r.doc_id == 2 and r.piece == 0 for r in got) == 2
    if name != "packing":
        assert sorted(out.columns) == COLUMNS
    assert stage(spark, docs.where("false"), SF).collect() == []


def test_run_leaves_only_its_result(spark):
    root = spread.shared_folder(spark).removeprefix("file:")
    before = set(os.listdir(root))
    got = corpus_pipeline.run(spark, SF)
    assert got.count() > 0
    (folder,) = [f for f in set(os.listdir(root)) - before if f.startswith("corpus-")]
    assert os.listdir(f"{root}/{folder}") == ["packing"]


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows, seen = {r.doc_id: r.text for r in docs.collect()}, {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        if name != "packing":
            assert sorted(out.columns) == COLUMNS
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        got = docs.collect()
        if name == "quality":
            said = {r.doc_id for r in queries.op2_quality(spark, SF).collect() if r.kept}
            assert {r.doc_id: r.text for r in got} == {i: t for i, t in rows.items() if i in said}
        elif name == "minhash":
            keep = brute.near_documents(list(rows.items()), 5)
            assert {r.doc_id: r.text for r in got} == {i: t for i, t in rows.items() if keep[i][2]}
        elif name == "suffix":
            want = kept_bytes(list(rows.items()))
            assert {r.doc_id: r.text for r in got} == {i: t for i, t in want.items() if t or not rows[i]}
            assert all(r.n_chars == len(r.text) for r in got if r.text != rows[r.doc_id])
        elif name == "mixing":
            con = duckdb.connect()
            con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/suffix/*.parquet'")
            want = {r[0] for r in con.sql(f"SELECT doc_id FROM ({queries._mixing_sql(0.9, 0.9)}) WHERE sampled").fetchall()}
            assert {r.doc_id: r.text for r in got} == {i: t for i, t in rows.items() if i in want}
        else:
            seen = packed_well(got, rows)
        if name != "packing":
            rows = {r.doc_id: r.text for r in got}
    assert seen
