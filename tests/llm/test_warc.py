import base64
import gzip
import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from turnloom.llm import warc

KIND = "page_id long, url string, html string, id string, digest string"
PAGES = ["plain", None, "", "plain", "magic\r\nWARC/1.1\r\nContent-Length: 5\r\n\r\nxx", "WARC/1.1\r\nContent-Length: 0\r\n\r\n\r\n\r\n", "é" * 50_000, "tail\r\n\r\n", "plain", "\r\n\r\nWARC/1.0\r\ncontent-length: 99999999\r\n\r\n"]


@pytest.mark.parametrize("least", [0, 3, 10**9])
def test_round_trip(spark, tmp_path, least):
    df = spark.createDataFrame([(i * 3, f"http://x/{i}\r\nX: y", h, "c", "c") for i, h in enumerate(PAGES)], KIND)
    path = str(tmp_path / "w")
    warc.write_archives(df, path, least=least)
    got = {r.page_id: r for r in warc.read_archives(spark, path, payloads=True).collect()}
    assert len(got) == len(PAGES)
    first = {}
    for i, h in enumerate(PAGES):
        b = (h or "").encode()
        r, again = got[i * 3], first.setdefault(b, i * 3)
        assert r.payload_bytes == len(b)
        assert r.payload_digest == base64.b32encode(hashlib.sha1(b).digest()).decode()
        revisit = again != i * 3 and len(b) >= least
        assert (r.record_type, r.refers_to) == (("revisit", again) if revisit else ("response", None))
        assert revisit or r.payload == b


def test_many_files_and_no_rows(spark, tmp_path):
    df = spark.range(500).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), F.repeat(F.col("id").cast("string"), 200).alias("html"))
    path = str(tmp_path / "w")
    warc.write_archives(df, path, file_bytes=4000)
    assert warc.read_archives(spark, path).select("page_id").distinct().count() == 500
    assert warc.archived(df.limit(0)).count() == 0


def test_pointer_jumping():
    offsets, successors = np.array([0, 5, 10, 12, 30]), np.array([10, 12, 30, 0, 99])
    assert warc.reachable(offsets, successors).tolist() == [True, False, True, False, True]
    n = 1000
    assert warc.reachable(np.arange(n) * 7, np.arange(1, n + 1) * 7).all()
    assert not warc.reachable(np.array([3]), np.array([9])).any()
    assert len(warc.reachable(np.zeros(0, dtype=int), np.zeros(0, dtype=int))) == 0


def test_chains_leave_their_range():
    offsets, successors = np.array([0, 5, 10, 12, 30]), np.array([10, 12, 30, 20, 99])
    assert warc.leaving(offsets, successors, 40).tolist() == [99, -1, 99, -1, 99]
    assert warc.leaving(offsets[:3], successors[:3], 14).tolist() == [30, 12, 30]
    assert len(warc.leaving(offsets[:0], successors[:0], 9)) == 0


def test_what_is_no_record_gives_no_candidate():
    assert warc.parsed(b"1\r\nContent-Length: 1\r\n", 7) is None
    assert warc.parsed(b"1\r\nContent-Length: no\r\n\r\n", 7) is None
    assert warc.parsed(b"WARC/1.1\r\nContent-Length: 2\r\n\r\nab\r\n\r\n", 0)[:2] == (31, 37)
    assert warc.parsed(b"1\r\nContent-Length: 2\r\n\r\nab\r\n\r\n", 7)[:2] == (31, 37)
    assert warc._candidate(b"no magic\r\nContent-Length: 2\r\n\r\n", 0, False) is None


@pytest.fixture
def small_splits(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "97")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")


@pytest.mark.parametrize("trap", ["", "\r\nWARC/1.1\r\nContent-Length: 9\r\n\r\n", "\r\nWARC/1.1\r\nWARC-Type: response\r\nContent-Length: 0\r\n\r\n\r\n\r\n"])
def test_candidates_come_from_many_ranges_of_a_file(spark, tmp_path, small_splits, trap):
    bodies = [f"page {i} " + ("x" * (i * 37 % 400)) + trap * (i % 3) + "\r\nWARC/1" * (i % 2) + "\r" * (i % 4) for i in range(40)]
    df = spark.createDataFrame([(i, f"http://x/WARC/1.{i}", h) for i, h in enumerate(bodies)], "page_id long, url string, html string").coalesce(1)
    path = str(tmp_path / "w")
    warc.write_archives(df, path)
    ranges = warc._rows(spark, path).select("path", "block").distinct()
    assert ranges.count() > 20 and ranges.select("path").distinct().count() == 1
    got = {r.page_id: r for r in warc.read_archives(spark, path, payloads=True).collect()}
    assert {i: r.payload.decode() for i, r in got.items()} == dict(enumerate(bodies))
    for i, h in enumerate(bodies):
        assert (got[i].payload_bytes, got[i].payload_digest, got[i].url) == (len(h), base64.b32encode(hashlib.sha1(h.encode()).digest()).decode(), f"http://x/WARC/1.{i}")


def test_compressed_archives(spark, tmp_path):
    df = spark.createDataFrame([(i, "u", h) for i, h in enumerate(PAGES)], "page_id long, url string, html string").coalesce(1)
    plain = str(tmp_path / "w")
    warc.write_archives(df, plain)
    (file,) = (tmp_path / "w").glob("part-*")
    data, offsets = file.read_bytes(), sorted(r.offset for r in warc.read_archives(spark, plain).collect())
    members = [gzip.compress(data[a:b]) for a, b in zip(offsets, [*offsets[1:], len(data)], strict=True)]
    for name, packed in (("each.warc.gz", b"".join(members)), ("all.warc.gz", gzip.compress(data))):
        (tmp_path / name).write_bytes(packed)
        rows = warc.read_archives(spark, str(tmp_path / name), payloads=True).collect()
        assert sorted(r.offset for r in rows) == offsets and {r.page_id for r in rows} == set(range(len(PAGES)))


def test_payloads_of_many_rows(spark, tmp_path):
    df = spark.createDataFrame([(i, "u", "same") for i in range(50)] + [(100, "u", "same"), (0, "u", "same")], "page_id long, url string, html string")
    rows = warc.archived(df).collect()
    assert sorted((r.page_id, r.record_type, r.refers_to) for r in rows) == sorted([(0, "response", None)] * 2 + [(i, "revisit", 0) for i in [*range(1, 50), 100]])


def test_a_long_url_in_the_middle(spark, tmp_path):
    urls = [f"http://x/{i}" + "?" * (200_000 if i in (3, 7) else 0) for i in range(12)]
    df = spark.createDataFrame([(i, u, f"page {i % 10}") for i, u in enumerate(urls)], "page_id long, url string, html string").coalesce(1)
    path = str(tmp_path / "w")
    warc.write_archives(df, path)
    got = {r.page_id: (r.url, r.payload_bytes) for r in warc.read_archives(spark, path).collect()}
    assert got == {i: (u, 6) for i, u in enumerate(urls)}


@pytest.mark.parametrize("data", [b"no record", b"WARC/1.1\r\nContent-Length: 2\r\n\r\nab\r\n", b"WARC/1.1\r\nContent-Length: 2\r\n\r\nab\r\n\r\nmore"])
def test_broken_chains_are_errors(spark, tmp_path, data):
    (tmp_path / "a.warc").write_bytes(data)
    with pytest.raises(Exception, match="last byte"):
        warc.read_archives(spark, str(tmp_path)).collect()
