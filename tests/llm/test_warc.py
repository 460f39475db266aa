import gzip
import hashlib
import random
import zlib

import pytest

from gridloom.llm import warc
from gridloom.llm.common import new_path

BIG = "<p>é" * 500


@pytest.fixture(scope="module")
def pages(spark):
    data = [(1, "http://a/ x\r\ny", BIG, "z"), (5, None, BIG, "z"), (3, "http://b", BIG, "z"), (2, "u", "small", "z"), (9, "u", "small", "z"), (7, "u", None, "z"), (8, "u", "", "z"), (10, "u", "y\r\n\r\nWARC/1.1\r\n" * 200, "z"), (11, "u", "x" * 100_000, None), (None, "u", BIG, None)]
    return spark.createDataFrame(data, "page_id long, url string, html string, payload string").repartition(3)


def read(spark, pages):
    source, target = new_path(spark, "w"), new_path(spark, "n")
    warc.write_archive(warc.marked(pages), source, records_a_file=2)
    warc.normalise(spark, source, target)
    return source, target, warc.read_records(spark, target)


def test_round_trip(spark, pages):
    source, target, got = read(spark, pages)
    rows = {r["page_id"]: r for r in got.collect()}
    html = {r["page_id"]: (r["html"] or "").encode() for r in pages.collect()}
    assert {i: (r["payload_bytes"], r["payload_digest"]) for i, r in rows.items()} == {i: (len(h), hashlib.sha1(h).hexdigest()) for i, h in html.items()}
    assert {i: r["refers_to"] for i, r in rows.items() if r["record_type"] == "revisit"} == {1: 5, 3: 5}
    assert all(bytes(r["payload"]) == html[i] for i, r in rows.items() if r["record_type"] == "response")
    assert rows[1]["url"] == "http://a/%20x%20%20y" and rows[5]["url"] is None


def test_members_and_index(spark, pages):
    source, target, _ = read(spark, pages)
    index = spark.read.parquet(f"{target}/index").collect()
    assert len(index) == 10
    files = {int(r["path"].rsplit("part-", 1)[1][:5]): bytes(r["content"]) for r in spark.read.format("binaryFile").load(f"{target}/archive").collect()}
    for r in index:
        one = zlib.decompress(files[r["part"]][r["offset"] : r["offset"] + r["length"]], 31)
        assert one.startswith(b"WARC/1.1\r\n") and one.endswith(b"\r\n\r\n") and r["record"].encode() in one
    for f in files.values():
        whole = gzip.decompress(f)
        assert whole.count(b"WARC-Record-ID") == len([x for x in warc.records(iter([whole]))])


@pytest.mark.parametrize("step", [1, 7, 1 << 20])
def test_inflates_streams_of_any_shape(step):
    parts = [random.Random(i).randbytes(i * 37) + b"x" * 5000 for i in range(6)]
    data = b"".join(gzip.compress(p) for p in parts)
    assert b"".join(warc.inflated(data, step)) == b"".join(parts)
    assert list(warc.inflated(b"")) == []


def test_damage_is_told():
    good = gzip.compress(b"x" * 1000)
    for bad in (good[:-9], b"plain text", good[:20]):
        with pytest.raises(ValueError):
            list(warc.inflated(bad))
    with pytest.raises(ValueError):
        list(warc.records(iter([b"WARC/1.1\r\nContent-Length: 5\r\n\r\nabc"])))


def test_ties_and_empty(spark):
    twice = spark.createDataFrame([(4, "u", BIG), (4, "u", BIG), (2, "u", BIG)], "page_id long, url string, html string")
    _, _, got = read(spark, twice)
    assert sorted((r["page_id"], r["record_type"], r["refers_to"]) for r in got.collect()) == [(2, "revisit", 4), (4, "response", None), (4, "response", None)]
    assert read(spark, twice.limit(0))[2].collect() == []


def test_large_pages_make_files_of_fewer_records(spark):
    assert warc.records_a_file(spark.createDataFrame([("x" * 500,), (None,)], "html string"), most_bytes=75_000) == 100
    assert warc.records_a_file(spark.createDataFrame([("x" * 500_000,)], "html string"), most_bytes=1000) == 1
    assert warc.records_a_file(spark.createDataFrame([], "html string")) == warc.RECORDS_A_FILE
