"""SimHash near-duplicates linked by pivot distance tables (operator 8).

Fingerprints that differ in at most ``radius`` bits are linked.  A row of the pivot table holds a
fingerprint's Hamming distances to many reference fingerprints; by the triangle inequality a pair whose
rows differ by more than the radius in any coordinate is discarded, and survivors are verified.

The table alone would compare all pairs.  So pairs are first dealt out exactly: of ``radius + 2`` bit
blocks, linked fingerprints agree on two at least, and each choice of two blocks is a bucket.  In a
bucket, rows are sorted by the first coordinate and compared while it differs by the radius at most.
A bucket over ``split_at`` fingerprints is cut into slices, and each pair of slices is a bucket.  Tasks
return the edges of spanning forests only.  Equal fingerprints are one row from the start.

Defined results.  Null text is empty, and texts without words have fingerprint zero, linked like any
other.  Rows whose doc_id is null get a fingerprint, link nothing and have a null component.  Repeated
rows share all values; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import each_batch, materialised, text_bytes, whole_groups, with_row
from .components import components

SEED = 42
PIVOTS = 24
SPLIT_AT = 16_384
#: Bytes of rows whose buckets are linked together.
GATHER = 1 << 25


def fingerprint(text: bytes, width: int) -> int:
    words = text.lower().split()
    if not words:
        return 0
    joined = zip(*(words[i:] for i in range(width)), strict=False) if len(words) >= width else [words]
    return majority(np.fromiter((xxhash.xxh64_intdigest(b" ".join(x), SEED) for x in joined), np.uint64))


def bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes have each bit."""
    counts = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 16):
        part = hashes[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return counts


def as_long(bits: np.ndarray) -> int:
    return int(np.packbits(bits, bitorder="little").view(np.int64)[0])


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half the hashes; none: zero."""
    return as_long(2 * bit_counts(hashes) > len(hashes))


def fingerprints(docs: DataFrame, width: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, _row, fp) for every row."""

    def over(b: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([b["doc_id"], b["_row"], pa.array([fingerprint(x, width) for x in text_bytes(b["text"])], pa.int64())], names=["doc_id", "_row", "fp"])

    return each_batch(with_row(docs, id_col, text_col), over, "doc_id long, _row long, fp long")


def block_masks(radius: int) -> list[int]:
    """A mask for each choice of two of radius+2 blocks of the 64 bits, as signed longs."""
    edges = [round(64 * i / (radius + 2)) for i in range(radius + 3)]
    blocks = [(1 << z) - (1 << a) for a, z in zip(edges, edges[1:], strict=False)]
    return [m - (1 << 64) if m >> 63 else m for m in (a | b for a, b in combinations(blocks, 2))]


def pivot_table(fp: np.ndarray, pivots: int = PIVOTS) -> np.ndarray:
    """Hamming distances to reference fingerprints: zero, then fixed random ones."""
    reference = np.random.default_rng(SEED).integers(0, 1 << 63, pivots, np.uint64) << np.uint64(1)
    reference[0] = 0
    return np.bitwise_count(fp.view(np.uint64)[:, None] ^ reference[None, :]).astype(np.int8)


def linked(key: np.ndarray, side: np.ndarray, fp: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows i, j of spanning forests of the links within each bucket; side: -1, or the slice, of which only different ones meet."""
    first = np.bitwise_count(fp.view(np.uint64)).astype(np.int8)
    order = np.lexsort((first, key))
    key, side, fp = key[order], side[order], fp[order]
    table = pivot_table(fp)
    parent, out_i, out_j = np.arange(len(key)), [], []
    alive, step = np.arange(len(key)), 0
    while len(alive):
        step += 1
        alive = alive[alive + step < len(key)]
        alive = alive[(key[alive + step] == key[alive]) & (table[alive + step, 0] - table[alive, 0] <= radius)]
        i, j = alive, alive + step
        fresh = (parent[i] != parent[j]) & ((side[i] < 0) | (side[i] != side[j]))
        i, j = i[fresh], j[fresh]
        near = np.abs(table[i] - table[j]).max(axis=1, initial=0) <= radius
        i, j = i[near], j[near]
        close = np.bitwise_count((fp[i] ^ fp[j]).view(np.uint64)) <= radius
        for a, b in zip(i[close].tolist(), j[close].tolist(), strict=True):
            x, y = a, b
            while parent[x] != x:
                x = parent[x]
            while parent[y] != y:
                y = parent[y]
            if x != y:
                parent[max(x, y)] = min(x, y)
                out_i.append(a)
                out_j.append(b)
        if close.any():
            while (up := parent[parent]).tobytes() != parent.tobytes():
                parent = up
    return order[np.array(out_i, np.int64)], order[np.array(out_j, np.int64)]


def _links(radius: int):
    """Rows come ordered by key, so that a task holds a few whole buckets at a time."""

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, "key", GATHER):
            key, side, fp, rep = (t[c].to_numpy() for c in ("key", "side", "fp", "rep"))
            i, j = linked(key, side, fp, radius)
            yield pa.RecordBatch.from_arrays([pa.array(rep[i]), pa.array(rep[j])], names=["a", "b"])

    return over


def links(fps: DataFrame, radius: int = 3, split_at: int = SPLIT_AT) -> DataFrame:
    """(a, b): edges that connect the representatives of the distinct fingerprints fps(fp, rep) exactly as all links do."""
    masks = F.array(*(F.struct(F.lit(i).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("bits")) for i, m in enumerate(block_masks(radius))))
    dealt = fps.select("fp", "rep", F.explode(masks).alias("m")).select("fp", "rep", F.xxhash64("m.t", "m.bits").alias("key"))
    sizes = dealt.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > 1)
    n = F.ceil(F.col("size") / split_at).cast("int")
    sized = dealt.join(sizes, "key").withColumn("n", n).withColumn("own", F.pmod(F.xxhash64("fp"), F.col("n")).cast("int"))
    spread = sized.select("fp", "rep", "key", "n", "own", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("other"))
    pair = F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other"))
    side = F.when((F.col("n") == 1) | (F.col("own") == F.col("other")), F.lit(-1)).otherwise(F.col("own"))
    # a slice meets itself (all rows at side -1) and each other slice (its rows at side own)
    rows = spread.select(F.when(F.col("n") == 1, F.col("key")).otherwise(pair).alias("key"), side.alias("side"), "fp", "rep")
    return rows.repartition(F.col("key")).sortWithinPartitions("key").mapInArrow(_links(radius), "a long, b long")


def near_duplicates(docs: DataFrame, width: int = 3, radius: int = 3, id_col: str = "doc_id", text_col: str = "text", split_at: int = SPLIT_AT) -> DataFrame:
    """Per row: doc_id, _row, fp, component_id, and whether it is the row of its component that stays."""
    every = materialised(fingerprints(docs, width, id_col, text_col), "fingerprints")
    fps = every.where(F.col("doc_id").isNotNull()).groupBy("fp").agg(F.min(F.struct("doc_id", "_row")).alias("first")).select("fp", F.col("first.doc_id").alias("rep"), F.col("first._row").alias("rep_row"))
    # a doc_id that repeats with different texts ties their fingerprints' components together, as links of length 0 would
    found = components(links(fps, radius, split_at))
    labelled = fps.join(found, fps.rep == found.node, "left").select("fp", "rep_row", F.coalesce("component", "rep").alias("component_id"))
    joined = every.join(labelled, "fp", "left")
    stays = F.col("doc_id").isNull() | ((F.col("doc_id") == F.col("component_id")) & (F.col("_row") == F.col("rep_row")))
    return joined.select("doc_id", "_row", "fp", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"), stays.alias("stays"))


def op8_simhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    """Operator 8 over all documents: three-word shingles, three bits."""
    out = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
