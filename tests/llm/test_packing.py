import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from gridloom.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")
TOKENIZER = Tokenizer.from_file(PATH)


def plain_ids(text):
    return TOKENIZER.encode(text or "", add_special_tokens=False).ids + [1]


def check(pieces, texts):
    ids = {i: plain_ids(t) for i, t in texts.items()}
    cover, sequences = defaultdict(list), defaultdict(list)
    for r in pieces:
        part = np.array(ids[r["doc_id"]][r["start"] : r["start"] + r["length"]], "<u4")
        assert len(part) == r["length"] and zlib.crc32(part.tobytes()) == r["ids_crc32"] and r["doc_tokens"] == len(ids[r["doc_id"]])
        cover[r["doc_id"]].append((r["start"], r["length"]))
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for i, x in ids.items():
        at = 0
        for start, n in sorted(cover[i]):
            assert start == at
            at += n
        assert at == len(x)
    sizes = []
    for x in sequences.values():
        at = 0
        for offset, n in sorted(x):
            assert offset == at
            at += n
        assert at <= 2048
        sizes.append(at)
    return sizes


def test_pieces(docs, rows):
    check(packing.pack(docs).collect(), dict(rows))


def test_query_pads_little(spark, sf_dir):
    texts = {r[0]: r[1] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}
    sizes = check(packing.op9_packing(spark, sf_dir).collect(), texts)
    padding = sum(2048 - n for n in sizes if n & (n - 1))
    assert padding <= 0.01 * sum(sizes) + 2048


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("abcdé ̈'s'll 12,.\t\n  ́ßΣ日<|endoftext|>\x1c\x85")), max_size=60))
def test_words_encode_alone(text):
    got = np.frombuffer(packing.encode(text.encode(), PATH), "<u4").tolist()
    assert got + [1] == plain_ids(text)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 5000), max_size=60))
def test_packed(lengths):
    pieces = packing.packed(lengths)
    cover, loads = defaultdict(int), defaultdict(int)
    for i, _, n, w, _ in pieces:
        cover[i] += n
        loads[w] += n
    assert dict(cover) == dict(enumerate(lengths))
    assert not loads or max(loads.values()) <= 2048
    assert sorted(loads) == list(range(len(loads)))


def test_differencing_is_nearly_equal():
    rng = np.random.default_rng(5)
    sizes = rng.integers(1, 2048, 1500).tolist()
    to, loads = packing.differencing(sizes, -(-sum(sizes) // 2048))
    assert np.bincount(to, weights=sizes).astype(int).tolist() == loads.tolist()
    assert loads.max() - loads.min() <= 0.05 * loads.mean()


@pytest.mark.parametrize("length", [2048, 4096, 1])
def test_exact_lengths(length):
    assert {x[3] for x in packing.packed([length])} == set(range(max(1, length // 2048)))


def test_null_ids_repeats_and_empty(spark, empty):
    df = spark.createDataFrame([(None, "a b"), (1, None), (1, None)], "doc_id long, text string")
    assert sorted((r["doc_id"] or 0, r["length"]) for r in packing.pack(df).collect()) == [(0, 3), (1, 1), (1, 1)]
    assert packing.pack(empty).collect() == []
