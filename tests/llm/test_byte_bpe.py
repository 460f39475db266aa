import hashlib

import numpy as np
import public_tokenizers
import pytest

from gridloom.llm import byte_bpe as op

KEY = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def plain(text):
    c = op.codec(*KEY)
    ids = np.array(c.encoding.encode_ordinary(text or ""), "<u4").tobytes()
    return len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()


@pytest.mark.parametrize(("chunk", "lap"), [(op.CHUNK, op.LAP), (300, 60), (64, 16)])
def test_whole_texts(docs, rows, chunk, lap):
    got = {r["doc_id"]: tuple(r[1:]) for r in op.encoded_digests(docs, chunk=chunk, lap=lap).collect()}
    assert got == {i: plain(t) for i, t in rows}


def test_stitches_are_used(docs, spark):
    rows = op.with_row(docs.where("doc_id in (9, 10)"))
    cut = op.stitched(op.chunks(rows, 500, 80), KEY, 500, 80).collect()
    assert len(cut) > 100 and all(r["start"] is not None and r["stop"] is not None for r in cut)
    assert any(r["start"] > 0 for r in cut)


def test_where_scans_never_meet(spark):
    text = "word " * 50 + "a" * 3000 + "!" * 3000 + " " * 3000 + "'ll they're " * 40
    df = spark.createDataFrame([(1, text), (2, text[1:])], "doc_id long, text string")
    got = {r["doc_id"]: tuple(r[1:]) for r in op.encoded_digests(df, chunk=200, lap=40).collect()}
    assert got == {1: plain(text), 2: plain(text[1:])}


def test_query(spark, sf_dir):
    texts = {r[0]: r[1] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}
    assert {r["doc_id"]: tuple(r[1:]) for r in op.op7_byte_bpe(spark, sf_dir).collect()} == {i: plain(t) for i, t in texts.items()}


def test_null_ids_repeats_and_empty(spark, empty):
    df = spark.createDataFrame([(None, "a b"), (1, "x" * 100), (1, "x" * 100)], "doc_id long, text string")
    assert sorted((r["doc_id"] or 0, r["n_tokens"]) for r in op.encoded_digests(df, chunk=50, lap=10).collect()) == sorted([(0, plain("a b")[0])] + [(1, plain("x" * 100)[0])] * 2)
    assert op.encoded_digests(empty).collect() == []
