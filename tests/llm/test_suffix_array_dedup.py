import hashlib

import pytest

from gridloom.llm import suffix_array_dedup as op

COLUMNS = ("doc_id", "n_bytes", "n_removed", "size(spans) AS n_spans", "kept_sha256")


def brute(rows, depth):
    seen, out = set(), {}
    for i, text in sorted(rows):
        b = (text or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - depth + 1):
            w = b[p : p + depth]
            if w in seen:
                gone[p : p + depth] = b"\1" * depth
            seen.add(w)
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        spans = sum(1 for j, g in enumerate(gone) if g and (j == 0 or not gone[j - 1]))
        out[i] = len(b), len(b) - len(kept), spans, hashlib.sha256(kept).hexdigest()
    return out


@pytest.mark.parametrize("split_at", [4096, 1])
def test_brute_force(docs, rows, split_at):
    got = {r[0]: tuple(r[1:]) for r in op.deduplicated(docs, split_at=split_at).selectExpr(*COLUMNS).collect()}
    assert got == brute(rows, 100)


def test_documents(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    got = {r[0]: tuple(r[1:]) for r in op.op5_suffix_array_dedup(spark, sf_dir).collect()}
    assert got == brute(rows, 100)


def test_repeated_and_null_ids(spark):
    text = "".join(chr(97 + (i * i) % 23) for i in range(300))
    df = spark.createDataFrame([(None, text), (4, text), (4, text), (2, None)], "doc_id long, text string").coalesce(1)
    got = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_removed"]) for r in op.deduplicated(df).collect())
    assert [x[:2] for x in got] == [(False, 2), (False, 4), (False, 4), (True, 0)]
    first = brute([(4, text)], 100)[4][1]
    assert sorted(x[2] for x in got) == sorted([0, first, 300, 300])


def test_empty(empty):
    assert op.deduplicated(empty).collect() == []
