import re

import corpus_pipeline as cp
from gridloom.llm import packing


def stages(spark, docs):
    out = []
    for name, stage in cp.STAGES:
        docs = cp.materialised(stage(spark, docs, ""), name)
        out.append(docs)
    return out


def test_stages(spark, docs, rows):
    junk = [(900, "12345 67890 !!! ###", None, "s", 19), (901, None, None, None, None), (902, "日本語の文章" * 30, None, "s", 180), (903, rows[0][1] + " mail me: a.b@c.de", "en", "s", 1)]
    given = docs.select(*cp.COLUMNS).union(spark.createDataFrame(junk, "doc_id long, text string, lang string, source string, n_chars long"))
    language, near, cut, masked, packed = stages(spark, given)
    for df in (language, near, cut, masked):
        assert tuple(df.columns) == cp.COLUMNS
    ids = lambda df: sorted(r["doc_id"] for r in df.select("doc_id").collect())
    assert {900, 901, 5, 6, 14} & set(ids(language)) == set()
    assert {1, 2, 4, 9, 11, 15} <= set(ids(language))
    assert 1 in ids(near) and 3 not in ids(near)
    assert ids(cut) == ids(near) and ids(masked) == ids(near)
    texts = {r["doc_id"]: r["text"] for r in masked.collect()}
    assert not any(re.search(r"\w@\w", t) for t in texts.values())
    pieces = packed.collect()
    assert sorted({r["doc_id"] for r in pieces}) == ids(masked)
    for i, t in texts.items():
        n = len(packing.encode(t.encode(), packing.public_tokenizers.path("word_bpe_49k.json"))) // 4 + 1
        assert sum(r["length"] for r in pieces if r["doc_id"] == i) == n


def test_run(spark, sf_dir):
    out = cp.run(spark, sf_dir)
    assert out.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    assert out.count() > 0


def test_empty(spark, empty):
    for df in stages(spark, empty):
        assert df.collect() == []
