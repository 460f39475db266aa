import math

import duckdb
import numpy as np
import pytest

from gridloom.llm import pivot_top_k as op


def brute(rows, every=50, k=5):
    use = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, v in {(i, tuple(v)) for i, v in use if i % every == 0}:
        s = sorted((-min(max(sum(a * b for a, b in zip(v, w, strict=True)), -(2**63)), 2**63 - 1), i) for i, w in use if i != q and len(w) == len(v))
        out += [(q, r + 1, i, -x) for r, (x, i) in enumerate(s[:k])]
    return sorted(out)


@pytest.mark.parametrize("block", [4096, 2])
def test_brute_force(spark, block):
    rng = np.random.default_rng(7)
    common = rng.standard_normal(8).round(3).tolist()
    rows = [(i, common if i % 3 == 0 else rng.standard_normal(8).tolist()) for i in range(600)]
    rows += [(700, None), (701, [1.0, None] * 4), (702, [float("nan")] * 8), (703, [float("inf")] * 8), (None, common), (750, [1.0, 2.0]), (800, common), (800, common), (801, common), (801, common), (850, [0.0] * 8)]
    df = spark.createDataFrame([(i, v, 3, "s") for i, v in rows], "vec_id long, embedding array<double>, label int, score string").repartition(4)
    got = sorted(tuple(r) for r in op.top_k(df, block=block).collect())
    assert got == brute(rows)


def test_query_and_sql(spark, sf_dir):
    got = sorted(tuple(r) for r in op.op6_pivot_top_k(spark, sf_dir).collect())
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf_dir}/embeddings.parquet'")
    assert got == sorted(con.execute(op.SQL).fetchall())
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding").collect()]
    assert got == brute(rows)


def test_bound_spares_work():
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((20, 16)) * 400
    x = np.floor(centres[rng.integers(0, 20, 4000)] + rng.standard_normal((4000, 16)) * 20)
    search = op.Search(np.array([17]), x[17:18], op.spread_pivots(x[:1000], 32), 5)
    for i in range(0, 4000, 1500):
        search.meet(np.arange(i, min(4000, i + 1500)), x[i : i + 1500])
    want = np.lexsort((np.arange(4000), -np.where(np.arange(4000) == 17, -np.inf, x @ x[17])))[:5]
    assert search.found()["vec_id"].to_pylist() == want.tolist() and search.evaluated < 2000


@pytest.mark.parametrize("rows", [
    [(0, [1.0, 0.0]), (1, [0.0, 2.0**47]), (2, [1.0, 0.0])],
    [(0, [2.0**32, 1.0]), (1, [2.0**32, 0.0]), (2, [-(2.0**32), 5.0]), (3, [2.0**33, 0.0]), (4, [0.5, 7.0])],
    [(0, [1e300, -1e300]), (1, [1e300, 1e300]), (2, [1e300, 0.0]), (3, [1e307, 0.0]), (4, [-1e20, 3.0]), (5, [1e-9, 1e-9])],
])
def test_any_size(spark, rows):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    kept = [(i, v) for i, v in rows if all(math.isfinite(256 * x) for x in v)]
    assert sorted(tuple(r) for r in op.top_k(df).collect()) == brute(kept)


def test_large_components_are_exact(spark):
    rng = np.random.default_rng(5)
    rows = [(i, (rng.standard_normal(6) * scale).tolist()) for i, scale in enumerate([1, 1e4, 1e6, 1e6, 1e6] * 24)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert sorted(tuple(r) for r in op.top_k(df).collect()) == brute(rows)


def test_few_and_empty(spark):
    df = spark.createDataFrame([(0, [1.0]), (1, [2.0])], "vec_id long, embedding array<double>")
    assert [tuple(r) for r in op.top_k(df).collect()] == [(0, 1, 1, 256 * 512)]
    assert op.top_k(df.limit(0)).collect() == []
