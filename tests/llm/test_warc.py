from base64 import b32encode
from hashlib import sha1

import pytest

from terrapath.llm import warc
from terrapath.llm.queries import QUERIES

SCHEMA = "page_id long, url string, html string, chunk string"


def want(rows, least=0):
    first = {}
    for i, _, h in rows:
        b = (h or "").encode()
        if i is not None:
            first[b] = min(first.get(b, i), i)
    out = []
    for i, _, h in rows:
        b = (h or "").encode()
        again = len(b) >= least and first.get(b) is not None and i != first[b] and sum((x or "").encode() == b for _, _, x in rows) > 1
        out.append((i, len(b), b32encode(sha1(b).digest()).decode(), "revisit" if again else "response", first[b] if again else None))
    return sorted(out, key=str)


def run(df, least=0):
    return sorted([(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.read(warc.write(df, revisit_from=least)).collect()], key=str)


ROWS = [(3, "http://a/\r\nX: y", "<p>é</p>"), (1, None, "<p>é</p>"), (2, "u", None), (9, "u", ""), (4, "u", "x" * 300_000), (5, "u", "x" * 300_000), (6, "u", "a\r\n\r\nWARC/1.1\r\n\r\n"), (7, "u", "one"), (7, "u", "one"), (None, "u", "one"), (8, "", "y" * warc.CHUNK)]


@pytest.mark.parametrize("least", [0, 5])
def test_round_trip(spark, least):
    df = spark.createDataFrame([(*r, "z") for r in ROWS], SCHEMA)
    assert run(df, least) == want(ROWS, least)


def test_chunks_are_bounded_and_make_a_warc(spark):
    df = spark.createDataFrame([(*r, "z") for r in ROWS if r[0] == 4], SCHEMA)
    rows = sorted(warc.chunk_table(warc.records(df), chunk=1000).collect(), key=lambda r: r.chunk)
    assert len(rows) == 302 and max(len(r.data) for r in rows[1:]) <= 1000
    whole = b"".join(bytes(r.data) for r in rows)
    head, rest = whole.split(b"\r\n\r\n", 1)
    length = int(dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])["Content-Length"])
    assert rest[length:] == b"\r\n\r\n" and rest[:length].endswith(b"x" * 300_000)
    assert bytes(rows[1].running_sha1) == sha1(b"x" * 1000).digest()


def test_a_damaged_chunk_is_noticed(spark):
    df = spark.createDataFrame([(*ROWS[4], "z")], SCHEMA)
    bad = warc.write(df).selectExpr("archive", "page_id", "copy", "chunk", "IF(chunk = 2, CAST(repeat('q', 65536) AS BINARY), data) AS data", "running_sha1")
    with pytest.raises(Exception, match="does not match"):
        warc.read(bad).collect()


@pytest.mark.parametrize("lost", ["chunk = last", "chunk = 2", "chunk >= 2", "chunk = 0"])
@pytest.mark.parametrize("page", [4, 5, 6])
def test_a_cut_off_record_is_noticed(spark, lost, page):
    df = spark.createDataFrame([(4, "u", "x" * 300_000, "z"), (5, "u", "y" * 300_000, "z"), (6, "u", "z" * 300_000, "z")], SCHEMA)
    whole = warc.write(df).selectExpr("*", "max(chunk) OVER (PARTITION BY page_id) AS last").coalesce(1)
    with pytest.raises(Exception, match="cut off|has no record"):
        warc.read(whole.where(f"NOT (page_id = {page} AND {lost})").drop("last")).collect()


def test_a_chunk_too_many_is_noticed(spark):
    whole = warc.write(spark.createDataFrame([(4, "u", "abc", "z")], SCHEMA))
    again = whole.unionByName(whole.where("chunk = 2").selectExpr("archive", "page_id", "copy", "3L AS chunk", "data", "running_sha1"))
    with pytest.raises(Exception, match="has no record"):
        warc.read(again).collect()


def test_empty(spark):
    assert run(spark.createDataFrame([], SCHEMA)) == []


def test_query(spark):
    d = "/root/testdata/sf0.001"
    rows = [(r.page_id, r.url, r.html) for r in spark.read.parquet(f"{d}/pages.parquet").collect()]
    got = sorted([(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in QUERIES["op5_chunked_warc"](spark, d).collect()], key=str)
    assert got == want(rows)
