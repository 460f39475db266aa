"""Byte-level BPE encoding of overlapping chunks, and decoding (operator 7).

A text longer than ``chunk`` characters is cut into chunks that overlap by ``lap``.  Tasks pre-tokenise
the chunks in parallel, each from its own start.  Two chunks are stitched at the first place in their
overlap where both have a pre-token boundary: from there on both scans see the same text and run alike,
so it is a boundary of the whole text too.  (The pattern looks ahead by at most three characters, so
boundaries that near a chunk's cut end do not count.)  Then the pieces between stitches are encoded,
again in parallel, and a text's ids are put together in order.  Where two scans never meet in an overlap
(one pre-token longer than it), the text is put together again and encoded whole.  Shorter texts are
encoded where they are scanned.  Decoding concatenates the raw bytes of the ids.

Defined results.  Null text is empty: no ids.  Null ids keep their row; repeated rows give repeated rows;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import each_batch, with_row

CHUNK = 32_768
LAP = 512
_AHEAD = 4


class Codec:
    """The encoding of a ranks file: pieces to little-endian uint32 ids and back."""

    def __init__(self, path: str, pattern: str):
        lines = Path(path).read_bytes().splitlines()
        ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x)}
        self.encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.pattern = regex.compile(pattern)
        self.raw = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.raw[rank] = token

    def encode(self, text: str) -> bytes:
        return np.array(self.encoding.encode_ordinary(text), "<u4").tobytes()

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.raw.__getitem__, np.frombuffer(ids, "<u4").tolist()))

    def boundaries(self, text: str) -> list[int]:
        return [m.end() for m in self.pattern.finditer(text)]


_CODECS: dict[tuple[str, str], Codec] = {}


def codec(path: str, pattern: str) -> Codec:
    if (path, pattern) not in _CODECS:
        _CODECS[path, pattern] = Codec(path, pattern)
    return _CODECS[path, pattern]


def _digests(key: tuple[str, str], column: str, ids_of: Callable[[Codec, object], bytes]):
    def over(b: pa.RecordBatch) -> pa.RecordBatch:
        c = codec(*key)
        n, sha, back = [], [], []
        for x in b[column].to_pylist():
            ids = ids_of(c, x)
            n.append(len(ids) // 4)
            sha.append(hashlib.sha256(ids).hexdigest())
            back.append(hashlib.sha256(c.decode(ids)).hexdigest())
        return pa.RecordBatch.from_arrays([b["doc_id"], pa.array(n, pa.int64()), pa.array(sha), pa.array(back)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return over


_DIGESTS = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def chunks(rows: DataFrame, chunk: int = CHUNK, lap: int = LAP) -> DataFrame:
    """(doc_id, _row, at, lo, body): overlapping chunks of the texts; lo is where a chunk starts, in characters."""
    schema = pa.schema([("doc_id", pa.int64()), ("_row", pa.int64()), ("at", pa.int32()), ("last", pa.bool_()), ("lo", pa.int64()), ("body", pa.string())])

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for doc, row, text in zip(b["doc_id"].to_pylist(), b["_row"].to_pylist(), b["text"].to_pylist(), strict=True):
                text = text or ""
                cut = [(i, lo) for i, lo in enumerate(range(0, max(1, len(text)), chunk))]
                out = [(doc, row, i, i == len(cut) - 1, lo, text[lo : lo + chunk + lap]) for i, lo in cut]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    return rows.mapInArrow(over, "doc_id long, _row long, at int, last boolean, lo long, body string")


def stitched(cut: DataFrame, key: tuple[str, str], chunk: int = CHUNK, lap: int = LAP) -> DataFrame:
    """The chunks with ``start`` and ``stop``: the part of the body between the stitches, null where scans do not meet."""

    def scan(b: pa.RecordBatch) -> pa.RecordBatch:
        c = codec(*key)
        head, tail = [], []
        for body, last in zip(b["body"].to_pylist(), b["last"].to_pylist(), strict=True):
            ends = [0, *c.boundaries(body)]
            head.append([e for e in ends if e < lap])
            tail.append([] if last else [e - chunk for e in ends if chunk <= e <= len(body) - _AHEAD])
        kind = pa.list_(pa.int32())
        return pa.RecordBatch.from_arrays([*b.columns, pa.array(head, kind), pa.array(tail, kind)], names=[*b.schema.names, "head", "tail"])

    kept = "doc_id long, _row long, at int, last boolean, lo long, body string, head array<int>, tail array<int>"
    scanned = each_batch(cut.repartition("_row", "at"), scan, kept)
    text = Window.partitionBy("_row").orderBy("at")
    meet = F.array_min(F.array_intersect("tail", F.lead("head").over(text)))
    found = scanned.withColumn("meet", meet).withColumn("before", F.lag("meet").over(text))
    start = F.when(F.col("at") == 0, F.lit(0)).otherwise(F.col("before"))
    stop = F.when(F.col("last"), F.length("body")).otherwise(F.col("meet") + chunk)
    return found.select("doc_id", "_row", "at", "body", start.alias("start"), stop.alias("stop"))


def encoded_digests(docs: DataFrame, ranks: str | None = None, pattern: str | None = None, chunk: int = CHUNK, lap: int = LAP, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_tokens, and SHA-256 of the ids (little-endian uint32) and of the decoded bytes."""
    key = ranks or public_tokenizers.path("byte_bpe_50k.tiktoken"), pattern or public_tokenizers.PATTERN
    rows = with_row(docs, id_col, text_col)
    size = F.coalesce(F.length("text"), F.lit(0))
    short = each_batch(rows.where(size <= chunk).select("doc_id", "text"), _digests(key, "text", lambda c, x: c.encode(x or "")), _DIGESTS)
    return short.union(_long_digests(rows.where(size > chunk), key, chunk, lap))


def _long_digests(rows: DataFrame, key: tuple[str, str], chunk: int, lap: int) -> DataFrame:
    def pieces(b: pa.RecordBatch) -> pa.RecordBatch:
        c = codec(*key)
        ids, own = [], []
        for body, start, stop in zip(b["body"].to_pylist(), b["start"].to_pylist(), b["stop"].to_pylist(), strict=True):
            met = start is not None and stop is not None
            ids.append(c.encode(body[start:stop]) if met else None)
            own.append(body[:chunk])
        return pa.RecordBatch.from_arrays([b["doc_id"], b["_row"], b["at"], pa.array(ids, pa.binary()), pa.array(own, pa.string())], names=["doc_id", "_row", "at", "ids", "text"])

    def joined(c: Codec, parts: list[dict]) -> bytes:
        parts = sorted(parts, key=lambda x: x["at"])
        if any(x["ids"] is None for x in parts):
            return c.encode("".join(x["text"] for x in parts))
        return b"".join(x["ids"] for x in parts)

    cut = stitched(chunks(rows, chunk, lap), key, chunk, lap)
    done = each_batch(cut, pieces, "doc_id long, _row long, at int, ids binary, text string")
    # a text whose stitches all met needs its ids only
    broken = F.max(F.col("ids").isNull()).over(Window.partitionBy("_row"))
    done = done.withColumn("text", F.when(broken, F.col("text")))
    whole = done.groupBy("_row").agg(F.first("doc_id").alias("doc_id"), F.collect_list(F.struct("at", "ids", "text")).alias("parts"))
    return each_batch(whole.select("doc_id", "parts"), _digests(key, "parts", joined), _DIGESTS)


def op7_byte_bpe(spark, sf_dir: str) -> DataFrame:
    """Operator 7 over all documents, by the public 50k byte-level ranks."""
    return encoded_digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))
