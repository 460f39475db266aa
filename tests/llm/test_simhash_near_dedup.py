import random
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from gridloom.llm import simhash_near_dedup as op
from gridloom.llm.components import components


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    grams = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(fps):
    parent = {i: i for i, _ in fps}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, f in fps:
        for j, g in fps:
            if i < j and (f ^ g).bit_count() <= 3:
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return {i: root(i) for i, _ in fps}


def test_brute_force(docs, rows):
    fps = [(i, plain_fingerprint(t)) for i, t in rows]
    want = plain_components(fps)
    got = {r["doc_id"]: r for r in op.near_duplicates(docs).collect()}
    assert {i: r["fp"] % (1 << 64) for i, r in got.items()} == dict(fps)
    assert {i: r["component_id"] for i, r in got.items()} == want
    assert sorted(i for i, r in got.items() if r["stays"]) == sorted(set(want.values()))


@pytest.mark.parametrize("split_at", [16_384, 3])
def test_links_of_clusters(spark, split_at):
    rng = random.Random(3)
    fps = []
    for _ in range(12):
        centre = rng.getrandbits(64)
        for _ in range(15):
            fps.append(centre ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 4))))
    fps = list(dict.fromkeys(fps))
    want = plain_components(list(enumerate(fps)))
    df = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f, i) for i, f in enumerate(fps)], "fp long, rep long")
    found = {r["node"]: r["component"] for r in components(op.links(df, split_at=split_at)).collect()}
    assert {i: found.get(i, i) for i in want} == want


def test_pivot_bound_never_discards():
    rng = np.random.default_rng(1)
    fp = rng.integers(0, 1 << 62, 300)
    near = fp ^ (1 << rng.integers(0, 62, 300)) ^ (1 << rng.integers(0, 62, 300))
    assert (np.abs(op.pivot_table(fp) - op.pivot_table(near)).max(axis=1) <= 2).all()


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(300, 200), (200, 300), (7, 7)]
    got = defaultdict(set)
    for r in components(spark.createDataFrame(edges, "a long, b long")).collect():
        got[r["component"]].add(r["node"])
    assert got == {0: set(range(41)), 100: set(range(100, 160)), 200: {200, 300}}


def test_null_ids_repeats_and_empty(spark, empty):
    df = spark.createDataFrame([(None, "a b c"), (3, "a b c"), (3, "a b c"), (1, "q r s t")], "doc_id long, text string").coalesce(1)
    got = sorted((r["doc_id"] or 0, r["component_id"] or 0, r["stays"]) for r in op.near_duplicates(df).collect())
    assert got == [(0, 0, True), (1, 1, True), (3, 3, False), (3, 3, True)]
    assert op.near_duplicates(empty).collect() == []


def test_query(spark, sf_dir):
    rows = op.op8_simhash_near_dedup(spark, sf_dir).collect()
    texts = {r[0]: r[1] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.col("text")).collect()}
    fps = [(i, plain_fingerprint(t)) for i, t in texts.items()]
    assert {r["doc_id"]: r["fingerprint"] for r in rows} == {i: f"{f:016x}" for i, f in fps}
    assert {r["doc_id"]: r["component_id"] for r in rows} == plain_components(fps)
