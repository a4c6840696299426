"""Web archives: exact round trips, revisits, and archives that do not hold."""

import gzip
import hashlib
import io
import random
import zlib

import pytest
from pyspark.sql import functions as F

from corpora.llm import warc
from corpora.session import scratch_path

SCHEMA = "page_id long, url string, html string"


def pages(spark):
    rng = random.Random(1)
    big = ["".join(rng.choice("ab<é\r\n>😀") for _ in range(n)) for n in (1000, 1500, 3000)]
    rows = [(i, f"http://h/{i}", big[i % 3] if i % 4 else f"page {i}\r\n\r\n") for i in range(120)]
    rows += [(200, None, None), (201, "a b\nc", ""), (202, "u", ""), (203, "u", "x" * 999), (204, "u", "x" * 999)]
    rows += [(205, "u", "y" * 1000), (206, "u", "y" * 1000), (300, "u", "z" * 70000)]
    return rows


def test_round_trip_and_revisits(spark):
    rows = pages(spark)
    frame = spark.createDataFrame(rows, SCHEMA)
    want = {}
    for id, _, html in rows:
        data = (html or "").encode()
        same = [i for i, _, h in rows if (h or "").encode() == data]
        first = max(same) if len(data) >= 1000 else id
        want[id] = (len(data), hashlib.sha1(data).hexdigest(), "response" if first == id else "revisit", None if first == id else first)
    got = {r.id: (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.archived(frame).collect()}
    assert got == want


def test_payloads_come_back(spark):
    frame = spark.createDataFrame(pages(spark), SCHEMA)
    manifest = warc.write_archives(warc.with_revisits(frame), scratch_path(spark, "warc"), archive_bytes=4000)
    assert manifest.agg(F.sum("records")).collect()[0][0] == 128 and manifest.count() > 3
    read = warc.read_archives(manifest).where("record_type = 'response'").collect()
    html = {i: (h or "").encode() for i, _, h in pages(spark)}
    assert all(bytes(r.payload) == html[r.id] for r in read) and {r.id: r.url for r in read}[201] == "abc"


def member():
    return warc._member(1, "http://h/", b"some payload" * 100, None, "2026-01-01T00:00:00Z")


def test_one_gzip_member_per_record_and_any_reader():
    both = member() + warc._member(2, None, b"", None, "2026-01-01T00:00:00Z")
    assert len(list(warc.read_members(io.BytesIO(both)))) == 2
    assert gzip.decompress(both).count(b"WARC/1.1") == 2
    fields, block = next(warc.read_members(io.BytesIO(both)))
    assert int(fields["Content-Length"]) == len(block)


@pytest.mark.parametrize("old, new", [(b"some payload", b"same payload"), (b"Content-Length: 1", b"Content-Length: 2")])
def test_changed_records_fail(old, new):
    whole = gzip.decompress(member()).replace(old, new)
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    with pytest.raises(ValueError):
        for fields, block in warc.read_members(io.BytesIO(packer.compress(whole) + packer.flush())):
            warc._checked(fields, block)


def test_cut_archives_fail():
    with pytest.raises(ValueError):
        list(warc.read_members(io.BytesIO(member()[:-9])))


def test_nulls_repeats_clashes_and_empty_tables(spark):
    big = "q" * 2000
    frame = spark.createDataFrame([(None, "u", big), (1, "u", big), (2, "u", big), (2, "u", big), (None, None, None)], SCHEMA)
    frame = frame.withColumn("digest", F.lit(1)).withColumn("id", F.lit(2)).withColumn("first", F.lit(3))
    got = sorted((r.id or 0, r.record_type, r.refers_to or 0, r.payload_bytes) for r in warc.archived(frame).collect())
    assert got == [
        (0, "response", 0, 0), (0, "revisit", 2, 2000), (1, "revisit", 2, 2000), (2, "response", 0, 2000), (2, "response", 0, 2000),
    ]
    assert warc.archived(frame.limit(0)).count() == 0
