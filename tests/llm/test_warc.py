"""Round trips, framing piece by piece, and damaged archives."""

import gzip
import hashlib
import io

import duckdb
import pytest

from verify import compare
from vulnwave.llm import warc


def archive(*records):
    return b"".join(records)


def one(page=1, url="http://a/", payload=b"<p>x</p>", refers=None):
    return warc.record(page, url, payload, warc.sha1_base32(payload), refers)


def test_a_record_is_one_gzip_member():
    raw = gzip.decompress(one())
    head, _, rest = raw.partition(b"\r\n\r\n")
    assert head.startswith(b"WARC/1.1\r\nWARC-Type: response\r\n") and rest.endswith(b"<p>x</p>\r\n\r\n")
    assert b"Content-Length: %d" % (len(rest) - 4) in head


@pytest.mark.parametrize("piece", [1, 7, 100, 1 << 16])
def test_reading_in_pieces(piece, monkeypatch):
    monkeypatch.setattr(warc, "PIECE", piece)
    payloads = [b"", b"\r\n\r\n", b"WARC/1.1\r\n\r\n" * 50, bytes(range(256)) * 300]
    data = archive(*[one(i, payload=p) for i, p in enumerate(payloads)], one(9, payload=b"zz", refers=3))
    monkeypatch.setattr(warc.Members.__init__, "__defaults__", (piece,))
    found = list(warc.records(io.BytesIO(data)))
    assert [r.payload for r in found[:-1]] == payloads and not any(r.error for r in found)
    assert [r.payload_digest for r in found[:-1]] == [warc.sha1_base32(p) for p in payloads]
    last = found[-1]
    assert last.header("WARC-Type") == "revisit" and last.header("WARC-Refers-To") == "<urn:page:3>" and last.http["content-length"] == "2"


def test_pieces_are_bounded():
    members = warc.Members(io.BytesIO(one(payload=b"a" * 5_000_000)))
    assert members.more() and max(map(len, members.member())) <= warc.PIECE


def test_damage_is_reported():
    good, data = one(1), one(2, payload=b"abc" * 100)
    first, cut = list(warc.records(io.BytesIO(archive(good, data[:-20]))))
    assert first.error is None and "ends within" in cut.error
    assert "gzip" in list(warc.records(io.BytesIO(good + b"garbage")))[1].error
    raw = gzip.decompress(data)
    assert list(warc.records(io.BytesIO(gzip.compress(raw.replace(b"abcabc", b"abdabc", 1)))))[0].error == "block digest, payload digest"
    assert "shorter" in list(warc.records(io.BytesIO(gzip.compress(raw[:-50]))))[0].error
    assert "Content-Length" in list(warc.records(io.BytesIO(gzip.compress(b"WARC/1.1\r\nA: b\r\n\r\n"))))[0].error
    assert "version" in list(warc.records(io.BytesIO(gzip.compress(b"HTTP/1.1 200\r\n\r\n"))))[0].error
    assert list(warc.records(io.BytesIO(gzip.compress(raw + b"more"))))[0].error == "record end"
    assert list(warc.records(io.BytesIO(b""))) == []


def test_reading_goes_on_after_a_bad_record():
    bad = [b"HTTP/1.1 200\r\n\r\n" + b"x" * 300_000, b"WARC/1.1\r\nA: b\r\n\r\n", b"WARC/1.1\r\nContent-Length: 9\r\n\r\nabc", b"no end", b""]
    for piece in bad:
        a, b, c = list(warc.records(io.BytesIO(archive(one(1), gzip.compress(piece), one(2)))))
        assert (a.error, c.error) == (None, None) and b.error and not b.headers
        assert (a.header("WARC-Record-ID"), c.header("WARC-Record-ID")) == ("<urn:page:1>", "<urn:page:2>")
    cut = gzip.compress(b"HTTP/1.1 200\r\n\r\n" + bytes(range(256)) * 9)[:-9]
    first, last = list(warc.records(io.BytesIO(archive(one(1), cut))))
    assert first.error is None and "ends within" in last.error


def test_urls_of_any_length(spark):
    pages = spark.createDataFrame([(1, "u", "<a>"), (2, "http://x/" + "é " * 600_000, "<b>"), (3, "v", "<c>")], "page_id long, url string, html string")
    assert len(same_as_sql(spark, pages)) == 3


def same_as_sql(spark, pages):
    df = warc.round_trip(spark, pages)
    cols = sorted(df.columns)
    got = [tuple(r) for r in df.select(*cols).collect()]
    con = duckdb.connect()
    con.register("pages", pages.select("page_id", "html").toArrow())
    assert compare(got, con.sql(warc.SQL).project(", ".join(cols)).fetchall()) is None
    return got


def test_pages(spark, sf_dir):
    assert len(same_as_sql(spark, spark.read.parquet(f"{sf_dir}/pages.parquet"))) >= 50


def test_odd_rows(spark):
    rows = [(1, None, "<a>"), (None, "u\r\nX: y", "<a>"), (3, "http://é/ b", None), (2, "z", ""), (2, "z", ""), (None, None, "q"), (None, None, "q")]
    rows += [(-4, "n", "<a>"), (5, "long", "é" * 300_000)]
    pages = spark.createDataFrame([(*r, "p", b"c") for r in rows], "page_id long, url string, html string, payload string, digest binary")
    got = same_as_sql(spark, pages)
    assert len(got) == 9
    assert warc.round_trip(spark, pages.limit(0)).count() == 0


def test_archives_hold_the_payloads(spark, tmp_path):
    pages = spark.createDataFrame([(i, f"http://x/{i}", f"page {i % 3}") for i in range(10)], "page_id long, url string, html string")
    found = warc.read(warc.write(pages, f"file://{tmp_path}/w")).where("record_type = 'response'").collect()
    assert sorted(r["payload"] for r in found) == [b"page 0", b"page 1", b"page 2"]
    assert all(r["payload_digest"] == warc.base64.b32encode(hashlib.sha1(r["payload"]).digest()).decode() for r in found)
