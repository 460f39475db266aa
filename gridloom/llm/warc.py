"""WARC: a normaliser for monolithic gzip archives, and an archive of web pages (operator 2).

``write_archive`` stores one record a row: of records with equal payloads of at least ``least`` bytes the
one with the largest id is a response, the others are revisits that refer to it.  The text sink writes
them, with the end of a record as its line separator, so that each file is one whole gzip stream.

``normalise`` inflates each such file once, as a stream, rewrites every record as a gzip member of its
own, and writes a sidecar index of (part, offset, length, record).  Members are joined by empty members,
so the files are ordinary multi-member archives.  ``read_records`` reads members by the index.

Everything is read and written through Spark, so archives can be in any store that it opens.  A file is
one task's work; ``records_a_file`` bounds the files that are written here, by records and by bytes.

Defined results.  Null html is an empty payload; a null url leaves the header out; spaces and control
characters in a url are percent-encoded.  A row whose id is null has a record with an empty id and takes
no part in revisits.  Rows that repeat the largest id of a payload are all responses.  An empty table
gives an empty archive and result; other columns are ignored.  A damaged file raises ValueError.
"""

from __future__ import annotations

import gzip
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import StorageLevel, TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialised, new_path

LEAST = 1000
#: A file is one task's work and one cell when it is read: its records and bytes, and what a record's header takes.
RECORDS_A_FILE, FILE_BYTES, HEADER_BYTES = 20_000, 1 << 28, 500
CRLF = "\r\n"
END = "\r\n\r\n"
#: A gzip member without content, which separates members in a file.
EMPTY_MEMBER = gzip.compress(b"", 9, mtime=0)


def marked(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = LEAST) -> DataFrame:
    """(page_id, url, html, payload_bytes, payload_digest, refers_to): refers_to is null for responses."""
    own = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"))
    own = own.withColumn("payload_bytes", F.octet_length("html").cast("long")).withColumn("payload_digest", F.sha1("html"))
    large = F.col("payload_bytes") >= least
    last = own.where(large).groupBy("payload_digest").agg(F.max("page_id").alias("last"), F.count(F.lit(1)).alias("n")).where(F.col("n") > 1).select(F.col("payload_digest").alias("twice"), "last")
    # written first, so that its size is known: pages are only shuffled where there are too many repeated payloads to send
    joined = own.join(materialised(last, "copies"), large & (F.col("payload_digest") == F.col("twice")), "left")
    return joined.withColumn("refers_to", F.when(F.col("page_id") < F.col("last"), F.col("last"))).drop("twice", "last")


def _safe(url: Column) -> Column:
    return F.regexp_replace(url, r"[\x00-\x20\x7f]", "%20")


def record(date: str) -> Column:
    """A record's header and block, without the end."""
    revisit = F.col("refers_to").isNotNull()
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.col("payload_bytes").cast("string"), F.lit(END))
    block = F.when(revisit, http).otherwise(F.concat(http, F.col("html")))
    lines = [
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), F.when(revisit, "revisit").otherwise("response")),
        F.concat(F.lit("WARC-Record-ID: <urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit(">")),
        F.lit(f"WARC-Date: {date}"),
        F.concat(F.lit("WARC-Target-URI: "), _safe(F.col("url"))),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("payload_digest")),
        F.when(revisit, F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        F.concat(F.lit("WARC-Refers-To: <urn:page:"), F.col("refers_to").cast("string"), F.lit(">")),
        F.lit("Content-Type: application/http; msgtype=response"),
        F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string")),
    ]
    return F.concat(F.concat_ws(CRLF, *lines), F.lit(END), block)


def records_a_file(pages: DataFrame, html_col: str = "html", most_bytes: int = FILE_BYTES) -> int:
    """How many records make a file of about ``most_bytes`` before compression, by the pages' mean size; RECORDS_A_FILE at most."""
    mean = pages.agg(F.avg(F.coalesce(F.octet_length(html_col), F.lit(0)))).first()[0] or 0
    return max(1, min(RECORDS_A_FILE, int(most_bytes / (mean + HEADER_BYTES))))


def write_archive(rows: DataFrame, path: str, date: str = "2024-01-01T00:00:00Z", records_a_file: int = RECORDS_A_FILE) -> None:
    """Monolithic gzip files of the records of ``marked`` rows."""
    out = rows.select(record(date).alias("value")).write.option("lineSep", END).option("compression", "gzip")
    out.option("maxRecordsPerFile", records_a_file).text(path)


def parse_header(data: bytes | memoryview) -> tuple[dict[str, str], int] | None:
    """Fields of the header that data starts with, and where its block starts; None if it is not all there."""
    end = bytes(data).find(b"\r\n\r\n")
    if end < 0:
        return None
    first, *lines = bytes(data[:end]).decode("utf-8", "replace").split(CRLF)
    if not first.startswith("WARC/"):
        raise ValueError(f"not a WARC record: {first[:40]!r}")
    fields = (line.partition(":") for line in lines)
    return {k.strip().lower(): v.strip() for k, _, v in fields}, end + 4


def inflated(data: bytes, step: int = 1 << 20) -> Iterator[bytes]:
    """The content of a gzip file of one or many members, piece by piece."""
    rest, inflate = memoryview(data), zlib.decompressobj(31)
    try:
        while len(rest):
            fed = rest[:step]
            out = inflate.decompress(fed, 4 * step)
            if out:
                yield out
            rest = rest[len(fed) - len(inflate.unused_data) - len(inflate.unconsumed_tail) :]
            if not inflate.eof and not len(rest):
                out = inflate.flush()
                if out:
                    yield out
                if not inflate.eof:
                    raise ValueError("the gzip stream ends early")
            elif inflate.eof:
                inflate = zlib.decompressobj(31)
    except zlib.error as e:
        raise ValueError(f"not a gzip stream: {e}") from e


def records(pieces: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields and raw bytes (with the end) of every record of a stream."""
    buffer = bytearray()
    need, found = 0, None
    for piece in pieces:
        buffer += piece
        while len(buffer) >= max(need, 1):
            if found is None:
                found = parse_header(buffer[: 1 << 16])
                if found is None:
                    if len(buffer) >= 1 << 16:
                        raise ValueError("a header over 64 KiB")
                    break
                need = found[1] + int(found[0]["content-length"]) + 4
                continue
            if buffer[need - 4 : need] != b"\r\n\r\n":
                raise ValueError("a record does not end where its length says")
            yield found[0], bytes(buffer[:need])
            del buffer[:need]
            need, found = 0, None
    if buffer:
        raise ValueError("the archive ends inside a record")


def members(files: DataFrame) -> DataFrame:
    """Per record of files(content): part, offset and length in the file that its task writes, record id, and the member."""

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, offset = TaskContext.get().partitionId(), 0
        for b in batches:
            for content in b["content"]:
                rows: list[tuple] = []
                held = 0
                for fields, raw in records(inflated(content.as_py())):
                    member = gzip.compress(raw, 6, mtime=0)
                    rows.append((part, offset, len(member), fields["warc-record-id"], member))
                    offset += len(member) + len(EMPTY_MEMBER)
                    held += len(member)
                    if held > 1 << 23:
                        yield _rows(rows)
                        rows, held = [], 0
                if rows:
                    yield _rows(rows)

    return files.select("content").mapInArrow(over, "part int, offset long, length long, record string, member binary")


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["part", "offset", "length", "record", "member"])


def normalise(spark: SparkSession, source: str, target: str) -> None:
    """Rewrite the gzip files under source as target/archive, a member for each record, with target/index beside it."""
    # kept on the executors' disks so that records are compressed once; a lost executor's part is made again, with the same bytes
    out = members(spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(source)).persist(StorageLevel.DISK_ONLY)
    # the separator's bytes are those of an empty member
    out.select(F.col("member").cast("string").alias("value")).write.option("lineSep", EMPTY_MEMBER.decode("latin-1")).option("encoding", "ISO-8859-1").text(f"{target}/archive")
    out.select("part", "offset", "length", "record").write.parquet(f"{target}/index")
    out.unpersist()


def read_records(spark: SparkSession, target: str) -> DataFrame:
    """Per record of a normalised archive: page_id, type, url, digest and size of the full payload, refers_to, and the payload that is stored."""

    files = spark.read.format("binaryFile").load(f"{target}/archive")
    part = F.regexp_extract(F.element_at(F.split("path", "/"), -1), r"^part-(\d+)", 1).cast("int")
    index = spark.read.schema("part int, offset long, length long, record string").parquet(f"{target}/index")
    entries = index.groupBy("part").agg(F.sort_array(F.collect_list(F.struct("offset", "length", "record"))).alias("entries"))

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content, found in zip(b["content"], b["entries"], strict=True):
                data = memoryview(content.as_buffer())
                rows = found.as_py()
                for i in range(0, len(rows), 256):
                    yield _parsed(data, rows[i : i + 256])

    return files.select(part.alias("part"), "content").join(entries.hint("shuffle_hash"), "part").select("content", "entries").mapInArrow(over, "page_id long, record_type string, url string, payload_digest string, payload_bytes long, refers_to long, payload binary")


def _page(urn: str | None) -> int | None:
    number = (urn or "").removeprefix("<urn:page:").removesuffix(">")
    return int(number) if number else None


def _parsed(data: memoryview, entries: list[dict]) -> pa.RecordBatch:
    out: list[tuple] = []
    for e in entries:
        raw = zlib.decompress(data[e["offset"] : e["offset"] + e["length"]], 31)
        fields, start = parse_header(raw) or ({}, 0)
        if fields.get("warc-record-id") != e["record"]:
            raise ValueError(f"the index does not fit the archive at {e['record']}")
        block = raw[start : start + int(fields["content-length"])]
        http, _, body = block.partition(b"\r\n\r\n")
        size = int(next(x for x in http.decode("latin-1").split(CRLF) if x.lower().startswith("content-length:")).partition(":")[2])
        digest = fields["warc-payload-digest"].removeprefix("sha1:")
        if fields["warc-type"] == "response" and (len(body), hashlib.sha1(body).hexdigest()) != (size, digest):
            raise ValueError(f"the payload of {e['record']} is damaged")
        out.append((_page(e["record"]), fields["warc-type"], fields.get("warc-target-uri"), digest, size, _page(fields.get("warc-refers-to")), body if fields["warc-type"] == "response" else None))
    kinds = (pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=["page_id", "record_type", "url", "payload_digest", "payload_bytes", "refers_to", "payload"])


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 2 over all pages: written, normalised and read back."""
    source, target = new_path(spark, "warc"), new_path(spark, "normalised")
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    write_archive(marked(pages), source, records_a_file=records_a_file(pages))
    normalise(spark, source, target)
    return read_records(spark, target).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL = """
    WITH p AS (
        SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages
    ), m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS last FROM p)
    SELECT page_id, payload_bytes, payload_digest,
           CASE WHEN payload_bytes >= 1000 AND page_id < last THEN 'revisit' ELSE 'response' END AS record_type,
           CASE WHEN payload_bytes >= 1000 AND page_id < last THEN last END AS refers_to
    FROM m
"""
