"""What the operators share: row ids, materialised steps in the shared folder, joins of checked size, batch loops."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Spark's setting that removes a query's shuffle files when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Rows of ids (a long or two each) that are sent to all executors at most; more are joined by shuffles.
SENT_ROWS = 1 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or on one machine a new one where it is unset."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        named = f"file://{tempfile.mkdtemp(prefix='spark-shared-')}"
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialised(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet in the shared folder and read back: its lineage ends there, and lost executors lose nothing."""
    spark, path = df.sparkSession, new_path(df.sparkSession, name)
    before = spark.conf.get(CLEANUP, "false")
    # what was shuffled for it isn't read again
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored = path
    return out


def discard(stored: DataFrame) -> None:
    """Delete what ``materialised`` wrote; nothing that is still to run may read it."""
    spark = stored.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(stored._stored)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def sized(stored: DataFrame, most: int = SENT_ROWS) -> DataFrame:
    """A stored table of ids for a join: sent to all executors if it has ``most`` rows at most, else left to a shuffle."""
    return F.broadcast(stored) if stored.count() <= most else stored


def with_row(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", row: str = "_row") -> DataFrame:
    """(id, text, row): row tells repeated ids apart. The input should be a table scan, whose splits repeat exactly."""
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.monotonically_increasing_id().alias(row))


def numbered(df: DataFrame, name: str) -> DataFrame:
    """df with _row, written once: every later job reads the ids that were stored, however its scans are split."""
    return materialised(df.withColumn("_row", F.monotonically_increasing_id()), name)


def each_batch(df: DataFrame, f: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str) -> DataFrame:
    """df through f, a thousand rows at a time, as rows can be large."""

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for a, z in slices(b.num_rows):
                yield f(b.slice(a, z - a))

    return df.mapInArrow(over, schema)


def slices(n: int, size: int = 1000) -> Iterator[tuple[int, int]]:
    for i in range(0, n, size):
        yield i, min(n, i + size)


def whole_groups(batches: Iterator[pa.RecordBatch], key: str, most: int) -> Iterator[pa.Table]:
    """Batches that come ordered by key, as tables of about ``most`` bytes that end where a group does."""
    held, size, last = [], 0, None
    for b in (x for x in batches if x.num_rows):
        keys = b[key].to_numpy()
        if size >= most:
            turns = np.flatnonzero(np.append(keys[0] != last, keys[1:] != keys[:-1]))
            if len(turns):
                at = int(turns[-1])
                yield pa.Table.from_batches([*held, b.slice(0, at)])
                held, size, b = [], 0, b.slice(at)
        held.append(b)
        size += b.nbytes
        last = keys[-1]
    if held:
        yield pa.Table.from_batches(held)


def byte_slices(texts: pa.Array, most: int) -> Iterator[tuple[int, int]]:
    """Slices of about ``most`` bytes of texts, and of one text at least."""
    ends = np.cumsum(pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
    a = 0
    while a < len(ends):
        z = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + most, side="right")))
        yield a, z
        a = z


class Remembered(dict):
    """What ``find`` gives for words, kept for the latest short ones, ``most`` to twice as many.

    When full, the younger half becomes the older one, from which words that come again are taken over; words longer than
    ``longest`` are never kept, which bounds the memory.
    """

    def __init__(self, find: Callable, most: int, longest: int = 64):
        super().__init__()
        self.find, self.most, self.longest, self.old = find, most, longest, {}

    def __missing__(self, word):
        found = self.old.get(word)
        if found is None:
            found = self.find(word)
        if len(word) <= self.longest:
            if len(self) >= self.most:
                self.old = dict(self)
                self.clear()
            self[word] = found
        return found


def text_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; null: empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return [x or b"" for x in column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()]
