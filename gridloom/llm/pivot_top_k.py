"""Exact top-k inner products by pivot-table elimination (operator 6).

Vectors are integers, floor(256 * x).  Each block of queries is sent to the tasks that scan the
candidates.  A task keeps a table of distances from its candidates and from the queries to many pivots;
by the triangle inequality the greatest coordinate difference is a lower bound of their distance, and so
|q|^2 + |c|^2 - bound^2 over 2 is an upper bound of the inner product.  Candidates are evaluated in the
order of that bound, exactly and in integers, until the k-th score beats all bounds that are left.  Each
task returns its k best per query, and the k best of those are ranked.

Queries come in blocks of ``block`` rows (documented bound of what the driver holds and of what is broadcast);
every block meets all rows, and where there are several each one's result is written before the next.  A task
keeps the k best of each query over its batches, so it holds one batch.  Pivots are fitted on a bounded sample:
``pivots`` rows spread over the first ``sample`` vectors by hash of the id.  They only steer the order of
evaluation, never the result.

Defined results.  Vectors that are null or hold null or non-finite components take no part (nor do those of which
a component times 256 is over all doubles), nor do rows whose id is null.  Rows that repeat a query's id are the
query's own; repeated equal queries are one.  Repeated candidate ids are ranked as often as they occur.  Vectors of
different length have no score.  Ties go to the smaller id; fewer than k candidates are all returned; an empty table
gives an empty result; other columns are ignored.  Sums are exact: in doubles below 2^53, in longs below 2^63, else
in integers of any size; a score that no long holds is given, and ranked, as the nearest long.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import new_path

SCALE = 256
BLOCK = 16_384
PIVOTS = 32
SAMPLE = 1024
#: Candidates of a query that are evaluated first, and how steps grow.
STEP, GROWTH = 64, 16
_SCHEMA = "query_id long, vec_id long, score long"
LEAST, MOST = -(1 << 63), (1 << 63) - 1


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(vec_id, v): the vectors of the rows that take part, as doubles, not yet integers."""
    whole = F.forall(vec_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double") * SCALE) < float("inf")))
    return vectors.where(F.col(id_col).isNotNull() & F.col(vec_col).isNotNull() & whole).select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("v"))


def _by_length(t: pa.Table | pa.RecordBatch) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Ids and matrix of integers, floor(256 * x), of the vectors of each length, ids ascending."""
    ids, v = t["vec_id"].to_numpy(), t["v"]
    v = v.combine_chunks() if isinstance(v, pa.ChunkedArray) else v
    ends, flat = v.offsets.to_numpy(), v.values.to_numpy(zero_copy_only=False)
    size = np.diff(ends)
    out = {}
    for n in np.unique(size):
        rows = np.flatnonzero(size == n)
        rows = rows[np.argsort(ids[rows], kind="stable")]
        out[int(n)] = ids[rows], np.floor(flat[ends[rows][:, None] + np.arange(n)] * SCALE)
    return out


def distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    square = (x * x).sum(axis=1)[:, None] + (pivots * pivots).sum(axis=1)[None, :] - 2 * (x @ pivots.T)
    return np.sqrt(np.maximum(square, 0))


def scores(x: np.ndarray, query: np.ndarray, most: float) -> np.ndarray:
    """Exact inner products as longs, or the nearest long; most: what no sum of absolute products is above."""
    if most < 2**53:
        return (x @ query).astype(np.int64)
    if most < 2**63:
        return x.astype(np.int64) @ query.astype(np.int64)
    q = list(map(int, query.tolist()))
    exact = (sum(int(a) * b for a, b in zip(row, q, strict=True)) for row in x.tolist())
    return np.array([min(max(s, LEAST), MOST) for s in exact], np.int64)


class Search:
    """The k best candidates of each query (vectors of one length) over all batches that it meets."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, pivots: np.ndarray, k: int):
        self.ids, self.vectors, self.pivots, self.k = ids, vectors, pivots, k
        with np.errstate(over="ignore", invalid="ignore"):
            self.table, self.square = distances(vectors, pivots), (vectors * vectors).sum(axis=1)
        self.best = [(np.empty(0, np.int64), np.empty(0, np.int64))] * len(ids)
        self.evaluated = 0

    def meet(self, ids: np.ndarray, x: np.ndarray) -> None:
        with np.errstate(over="ignore", invalid="ignore"):
            table, square = np.ascontiguousarray(distances(x, self.pivots).T), (x * x).sum(axis=1)
            apart = np.empty_like(table)
            largest = float(np.abs(x).max(initial=0)) * x.shape[1]
            for i in range(len(self.ids)):
                np.subtract(table, self.table[i][:, None], out=apart)
                np.abs(apart, out=apart)
                bound = np.maximum(apart.max(axis=0, initial=0) - 1e-3, 0)
                size = self.square[i] + square
                upper = (size - bound * bound) / 2 + 1.0 + 1e-6 * size
                # sums over all doubles bound nothing
                upper[np.isnan(upper)] = np.inf
                self._evaluate(i, ids, x, upper, largest * float(np.abs(self.vectors[i]).max(initial=0)))

    def _evaluate(self, i: int, ids: np.ndarray, x: np.ndarray, upper: np.ndarray, most: float) -> None:
        """Candidates in the order of their bounds, in growing steps, until the k-th score beats all bounds that are left."""
        best_id, best_score = self.best[i]
        alive, step = np.flatnonzero(ids != self.ids[i]), max(STEP, self.k)
        while True:
            if len(best_score) == self.k:
                alive = alive[upper[alive] >= best_score[-1]]
            if not len(alive):
                break
            if len(alive) > step:
                order = np.argpartition(-upper[alive], step - 1)
                part, alive = alive[order[:step]], alive[order[step:]]
            else:
                part, alive = alive, alive[:0]
            self.evaluated += len(part)
            # most of a batch that is left is cheaper to multiply where it lies
            found = scores(x, self.vectors[i], most)[part] if 2 * len(part) > len(x) and most < 2**53 else scores(x[part], self.vectors[i], most)
            best_score = np.concatenate([best_score, found])
            best_id = np.concatenate([best_id, ids[part]])
            if len(best_score) > self.k:
                # those that tie with the k-th stay for the order by id
                high = best_score >= np.partition(best_score, -self.k)[-self.k]
                best_score, best_id = best_score[high], best_id[high]
            top = np.lexsort((best_id, ~best_score))[: self.k]
            best_id, best_score = best_id[top], best_score[top]
            step *= GROWTH
        self.best[i] = best_id, best_score

    def found(self) -> pa.RecordBatch:
        size = [len(x) for x, _ in self.best]
        columns = np.repeat(self.ids, size), np.concatenate([x for x, _ in self.best]), np.concatenate([x for _, x in self.best])
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["query_id", "vec_id", "score"])


def _scan(sent, k: int):
    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, pivots = sent.value
        searches: dict[int, Search] = {}
        for b in batches:
            for n, (ids, x) in _by_length(b).items():
                if n in queries:
                    if n not in searches:
                        searches[n] = Search(*queries[n], pivots.get(n, queries[n][1][:1]), k)
                    searches[n].meet(ids, x)
        for s in searches.values():
            yield s.found()

    return over


def spread_pivots(x: np.ndarray, count: int) -> np.ndarray:
    """Rows of x, each next one farthest from those before."""
    chosen = [0]
    far = distances(x, x[:1])[:, 0]
    while len(chosen) < min(count, len(x)) and far.max() > 0:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, distances(x, x[chosen[-1:]])[:, 0])
    return x[chosen]


def top_k(vectors: DataFrame, every: int = 50, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding", block: int = BLOCK, pivots: int = PIVOTS, sample: int = SAMPLE) -> DataFrame:
    """query_id, rank, vec_id, score: the k highest inner products of every row whose id is divisible by ``every``."""
    spark = vectors.sparkSession
    rows = usable(vectors, id_col, vec_col)
    queries = rows.where(F.col("vec_id") % every == 0).distinct()
    blocks = max(1, -(-queries.count() // block))
    drawn = _by_length(rows.orderBy(F.xxhash64("vec_id")).limit(sample).toArrow())
    reference = {n: spread_pivots(x, pivots) for n, (_, x) in drawn.items()}

    def found(part: DataFrame) -> tuple[DataFrame, Broadcast]:
        sent = spark.sparkContext.broadcast((_by_length(part.toArrow()), reference))
        best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        ranked = rows.mapInArrow(_scan(sent, k), _SCHEMA).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
        return ranked.select("query_id", "rank", "vec_id", "score"), sent

    if blocks == 1:
        return found(queries)[0]
    path = new_path(spark, "top_k")
    for i in range(blocks):
        out, sent = found(queries.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == i))
        out.write.parquet(f"{path}/block={i}")
        sent.destroy()
    return spark.read.schema(out.schema).parquet(path).select(*out.columns)


def op6_pivot_top_k(spark, sf_dir: str) -> DataFrame:
    """Operator 6 over all embeddings: the five best of every fiftieth id."""
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


SQL = """
    WITH v AS (
        SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
        WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(256 * x::DOUBLE))) = 0
    ), s AS (
        SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v) AS s
        FROM (SELECT DISTINCT * FROM v WHERE vec_id % 50 = 0) q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v)
    ), t AS (
        SELECT query_id, vec_id, CASE WHEN s >= 9223372036854775807 THEN 9223372036854775807 WHEN s <= -9223372036854775808 THEN -9223372036854775808 ELSE s::BIGINT END AS score FROM s
    )
    SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
    FROM t QUALIFY rank <= 5
"""
