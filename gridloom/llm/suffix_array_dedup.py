"""Exact substring de-duplication by a depth-limited radix sort of suffixes (operator 5).

A byte position's suffix is ordered only through its first ``depth`` bytes, its window.  Passes go from
the most significant digit on, and a window that is alone after a pass has no equal and leaves:

1. Leading digit: the hash of the window's anchor (see window_kernel).  The windows of a run share it, so
   one row stands for about 35 windows.  Rows are dealt to tasks by this digit.
2. Runs with equal leading digit and equal content (by a second 64-bit hash, over all bytes) are wholly
   repeated, but for the earliest one.
3. Groups that hold different runs are ordered by their bytes, eight at a time from the first on, through the
   last: of each class only windows that are equal so far go on.  Classes at the end are exactly the repeated windows.

Each map task keeps, of equal runs or windows, the earliest only, so a key has a row a task at most;
leading digits with over ``split_at`` different runs are dealt by window in pass 3 instead of by digit.

Defined results.  Order: doc_id, null last, then the row's place in the table, then the position.  Null
text is empty; texts shorter than depth keep all bytes; repeated rows are one after the other in that
order, so the later ones lose all their windows; an empty table gives an empty result; other columns
of the input are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import window_kernel as wk
from .common import materialised, slices, text_bytes, whole_groups

GRAM = 24
#: Rows that a task gathers before it drops its own repeats.
GATHER = 500_000
#: Bytes of runs that a task orders together, and the groups that end beyond them.
BODIES = 1 << 22
LONE, DONE, OPEN = 0, 1, 2
_LAST = np.iinfo(np.int64).max


def _order(column: pa.Array) -> np.ndarray:
    return column.fill_null(_LAST).to_numpy(zero_copy_only=False).astype(np.int64)


def _int64(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def _starts(*columns: np.ndarray) -> np.ndarray:
    """Where sorted rows differ from the row above."""
    new = np.zeros(len(columns[0]), bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return new


def _first_digit(depth: int, split_at: int):
    def combined(parts: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        doc, row, at, n, digit, digest = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.lexsort((at, row, doc, digest, digit))
        doc, row, at, n, digit, digest = (x[order] for x in (doc, row, at, n, digit, digest))
        group = _starts(digit)
        first = _starts(digit, digest)
        kinds = np.add.reduceat(first.astype(np.int64), np.flatnonzero(group))
        many = (kinds > split_at)[np.cumsum(group) - 1]
        state = np.where(first, np.where(many & ~group, OPEN, LONE), DONE).astype(np.int8)
        # a leading digit of many runs here: one row tells the others, the rest are open whatever comes
        several = many & first
        own = wk.splitmix(row.view(np.uint64) * np.uint64(1 << 20) + at.view(np.uint64))
        key = np.where(state == LONE, digit, own)
        back = np.lexsort((at, row))
        return pa.RecordBatch.from_arrays(
            [_int64(key[back]), _int64(digest[back]), _int64(doc[back]), _int64(row[back]), pa.array(at[back]), pa.array(n[back].astype(np.int32)), _int64(digit[back]), pa.array(state[back]), pa.array(several[back])],
            names=["key", "digest", "doc", "_row", "at", "n", "digit", "state", "several"],
        )

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, rows = [], 0
        for b in batches:
            texts = text_bytes(b["text"])
            doc, row = _order(b["doc_id"]), b["_row"].to_numpy()
            for block in wk.blocks(np.fromiter(map(len, texts), np.int64, len(texts)), depth):
                i, at, n, digit, digest = wk.runs(b"".join(texts[i][s:e] for i, s, e in block), block, depth, GRAM)
                parts.append((doc[i], row[i], at, n, digit, digest))
                rows += len(at)
                if rows >= GATHER:
                    yield combined(parts)
                    parts, rows = [], 0
        if parts:
            yield combined(parts)

    return over


def _marked(runs: DataFrame, split_at: int) -> DataFrame:
    """Passes 1 and 2: of each run, whether it is wholly repeated (DONE) or to be ordered further (OPEN); lone runs leave."""
    alike, here = Window.partitionBy("key", "digest").orderBy("doc", "_row", "at"), Window.partitionBy("key")
    at = F.row_number().over(alike)
    seen = runs.repartition(F.col("key")).withColumn("nth", at).withColumn("kinds", F.sum((F.col("nth") == 1).cast("long")).over(here)).withColumn("all", F.count(F.lit(1)).over(here)).withColumn("told", F.max("several").over(here))
    mixed = (F.col("kinds") > 1) | F.col("told")
    state = F.when(F.col("state") != LONE, F.col("state")).when(F.col("nth") > 1, F.lit(DONE)).when(mixed, F.lit(OPEN)).otherwise(F.lit(LONE)).cast("byte")
    many = F.col("told") | (F.col("kinds") > split_at) | (F.col("state") == OPEN)
    return seen.select("_row", "at", "n", "digit", state.alias("state"), many.alias("many")).where(F.col("state") != LONE)


def _texts_of_open(depth: int):
    """Pass 3, first half: the bytes of each open run, dealt by leading digit or, where many runs share it, by window."""
    schema = pa.schema([("key", pa.int64()), ("doc", pa.int64()), ("_row", pa.int64()), ("at", pa.int64()), ("done", pa.bool_()), ("body", pa.binary())])

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple[int, int], tuple[int, int, int]] = {}
        for b in batches:
            rows: list[tuple] = []
            spots, digits, many, starts = b["spots"], b["digits"], b["many"], b["spots"].offsets.to_numpy()
            spot_v, digit_v, many_v = (x.values.to_numpy(zero_copy_only=False) for x in (spots, digits, many))
            for k, (text, doc, row) in enumerate(zip(text_bytes(b["text"]), _order(b["doc_id"]).tolist(), b["_row"].to_pylist(), strict=True)):
                for j in range(starts[k], starts[k + 1]):
                    at, n = int(spot_v[j]) >> 20, int(spot_v[j]) & 0xFFFFF
                    if not many_v[j]:
                        rows.append((int(digit_v[j]), doc, row, at, False, text[at : at + n + depth - 1]))
                        continue
                    for p in range(at, at + n):
                        key = xxhash.xxh3_64_intdigest(text[p : p + depth])
                        spot = (doc, row, p)
                        kept = seen.setdefault((int(digit_v[j]), key), spot)
                        # of equal windows in this task the earliest goes on; rows need not come in order
                        if kept < spot:
                            rows.append((0, doc, row, p, True, None))
                            continue
                        if spot < kept:
                            seen[int(digit_v[j]), key] = spot
                        rows.append((key - (1 << 64) if key >> 63 else key, doc, row, p, False, text[p : p + depth]))
                if len(seen) > GATHER:
                    seen.clear()
            columns = list(zip(*rows, strict=True)) or [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return over


def _last_digits(depth: int):
    """Pass 3, second half: windows of runs that come ordered by key, by their bytes; all but the earliest of equals are repeats."""

    def repeats(t: pa.Table) -> pa.RecordBatch:
        done = t["done"].to_numpy()
        key, doc, row, at = (t[c].to_numpy() for c in ("key", "doc", "_row", "at"))
        bodies = [x or b"" for x in t["body"].to_pylist()]
        size = np.fromiter(map(len, bodies), np.int64, len(bodies))
        n = np.where(done, 0, np.maximum(size - depth + 1, 0))
        owner = np.repeat(np.arange(len(n)), n)
        shift = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        equal = wk.classes(np.frombuffer(b"".join(bodies), np.uint8), np.repeat(np.cumsum(size) - size, n) + shift, key[owner], depth)
        several = np.flatnonzero(equal >= 0)
        owner, p, equal = owner[several], at[owner[several]] + shift[several], equal[several]
        order = np.lexsort((p, row[owner], doc[owner], equal))
        again = order[~_starts(equal[order])]
        r, p = np.concatenate([row[done], row[owner[again]]]), np.concatenate([at[done], p[again]])
        order = np.lexsort((p, r))
        r, p = r[order], p[order]
        # neighbouring windows become one span
        new = _starts(r) | np.r_[True, p[1:] != p[:-1] + 1][: len(p)]
        first = np.flatnonzero(new)
        return pa.RecordBatch.from_arrays([pa.array(r[first]), pa.array(p[first]), pa.array(np.diff(np.append(first, len(p))).astype(np.int32))], names=["_row", "at", "n"])

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from map(repeats, whole_groups(batches, "key", BODIES))

    return over


def _cut(depth: int, as_text: bool, carried: list[str]):
    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (x.slice(a, z - a) for x in batches for a, z in slices(x.num_rows)):
            kept, removed, spans, sha, size = [], [], [], [], []
            for text, runs in zip(text_bytes(b["text"]), b["spots"].to_pylist(), strict=True):
                ends: list[list[int]] = []
                for s in sorted(runs or []):
                    at, n = s >> 20, s & 0xFFFFF
                    if ends and at <= ends[-1][1]:
                        ends[-1][1] = max(ends[-1][1], at + n + depth - 1)
                    else:
                        ends.append([at, at + n + depth - 1])
                marks = [0, *(x for e in ends for x in e), len(text)]
                rest = b"".join(text[a:z] for a, z in zip(marks[::2], marks[1::2], strict=True))
                kept.append(rest)
                size.append(len(text))
                removed.append(len(text) - len(rest))
                spans.append([{"start": a, "end": z} for a, z in ends])
                sha.append(hashlib.sha256(rest).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [b["doc_id"], b["_row"], pa.array(size, pa.int64()), pa.array(removed, pa.int64()), pa.array(sha, pa.string()), pa.array([x.decode("utf-8", "ignore") for x in kept], pa.string()) if as_text else pa.array(kept, pa.binary()), pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), *(b[c] for c in carried)],
                names=["doc_id", "_row", "n_bytes", "n_removed", "kept_sha256", "kept", "spans", *carried],
            )

    return over


def _packed(at: str = "at", n: str = "n"):
    """Position and window count of a run in one long; a run is shorter than a kernel block."""
    return F.shiftleft(F.col(at).cast("long"), 20).bitwiseOR(F.col(n).cast("long"))


def repeated_windows(rows: DataFrame, depth: int = 100, split_at: int = 4096) -> tuple[DataFrame, DataFrame]:
    """The texts dealt by row, and (_row, at, n): n neighbouring windows from byte ``at`` on that also start earlier.

    rows: (doc_id, text, _row) and what is carried along, a stored table.
    """
    runs = rows.mapInArrow(_first_digit(depth, min(64, split_at)), "key long, digest long, doc long, _row long, at long, n int, digit long, state byte, several boolean")
    marked = materialised(_marked(runs, split_at), "runs")
    # the filter that the inner join would add, here for both uses
    dealt = rows.where(F.col("_row").isNotNull()).repartition(F.col("_row"))
    still = marked.where(F.col("state") == OPEN).groupBy("_row").agg(F.collect_list(F.struct(_packed().alias("s"), "digit", "many")).alias("x"))
    still = still.select("_row", F.col("x.s").alias("spots"), F.col("x.digit").alias("digits"), F.col("x.many").alias("many"))
    # with all columns, so that the texts are dealt once for both uses
    bodies = dealt.join(still.hint("shuffle_hash"), "_row").select(*rows.columns, "spots", "digits", "many").mapInArrow(_texts_of_open(depth), "key long, doc long, _row long, at long, done boolean, body binary")
    spread = F.when(F.col("done"), F.xxhash64("_row", "at")).otherwise(F.col("key"))
    found = bodies.withColumn("key", spread).repartition(F.col("key")).sortWithinPartitions("key").mapInArrow(_last_digits(depth), "_row long, at long, n int")
    return dealt, marked.where(F.col("state") == DONE).select("_row", "at", "n").union(found)


def deduplicated(docs: DataFrame, depth: int = 100, id_col: str = "doc_id", text_col: str = "text", split_at: int = 4096, as_text: bool = False, row_col: str | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """Per row of docs: doc_id, n_bytes, n_removed, kept_sha256, kept, the removed byte spans, and the columns ``keep``.

    kept: the bytes that stay; as_text: as a string, without the bytes of characters that a cut went through.
    row_col: row ids of docs, which then is a stored table; else texts are written with new ones, as several jobs read them.
    """
    carried = {f"_keep{i}": c for i, c in enumerate(keep)}
    others = [F.col(c).alias(k) for k, c in carried.items()]
    if row_col:
        rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(row_col).alias("_row"), *others)
    else:
        rows = materialised(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.monotonically_increasing_id().alias("_row"), *others), "texts")
    dealt, spans = repeated_windows(rows, depth, split_at)
    spots = spans.groupBy("_row").agg(F.collect_list(_packed()).alias("spots"))
    out = dealt.join(spots.hint("shuffle_hash"), "_row", "left").select("doc_id", "_row", "text", "spots", *carried)
    kinds = "".join(f", {k} {rows.schema[k].dataType.simpleString()}" for k in carried)
    cut = out.mapInArrow(_cut(depth, as_text, list(carried)), f"doc_id long, _row long, n_bytes long, n_removed long, kept_sha256 string, kept {'string' if as_text else 'binary'}, spans array<struct<start:int,end:int>>{kinds}")
    return cut.select("doc_id", "_row", "n_bytes", "n_removed", "kept_sha256", "kept", "spans", *(F.col(k).alias(c) for k, c in carried.items()))


def op5_suffix_array_dedup(spark, sf_dir: str) -> DataFrame:
    """Operator 5 over all documents, windows of 100 bytes."""
    out = deduplicated(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), "kept_sha256")
