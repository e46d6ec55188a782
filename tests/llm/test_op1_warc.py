import base64
import hashlib

from seqspark.llm import warc

SCHEMA = "page_id long, url string, html string, part int, body string"


def report(spark, rows, tmp_path, **sizes):
    df = spark.createDataFrame(rows, SCHEMA)
    path = str(tmp_path / "archive")
    warc.write_archives(df, path, **sizes)
    return warc.read_pages(spark, path)


def test_round_trip_with_segments_revisits_and_odd_rows(spark, tmp_path):
    long = "ä€😀\r\n\r\nWARC/1.1\r\n" * 500
    rows = [(5, "http://a", "<p>x</p>", 1, "z"), (3, "http://b", "<p>x</p>", 1, "z"), (3, "http://b", "<p>x</p>", 1, "z"), (7, None, None, 1, "z"), (8, "u v\r\n", "", 1, "z"), (9, "http://c", long, None, None), (None, "http://d", "<p>x</p>", 1, "z")]
    records = report(spark, rows, tmp_path, chunk_bytes=100, segment_bytes=1000).cache()
    out = sorted((tuple(r) for r in warc.page_report(records).drop("n_segments").collect()), key=str)
    sha = lambda s: base64.b32encode(hashlib.sha1(s.encode()).digest()).decode()
    x = (8, sha("<p>x</p>"))
    want = [(3, *x, "response", None), (3, *x, "revisit", 3), (5, *x, "revisit", 3), (None, *x, "revisit", 3), (7, 0, sha(""), "response", None), (8, 0, sha(""), "revisit", 7), (9, len(long.encode()), sha(long), "response", None)]
    assert out == sorted(want, key=str)
    assert records.where("warc_type = 'response' AND n_segments > 10").first()["payload"] == long.encode()


def test_missing_segment_and_wrong_total_are_incomplete(spark):
    row = lambda o, k, total, block: (f"{o}:{k}", o, "response" if k == 1 else "continuation", None, None, None, k, total, block)
    whole = b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n3\r\nabc\r\n0\r\n\r\n"
    rows = [row("<a>", 2, len(whole), whole[50:]), row("<a>", 1, None, whole[:50]), row("<b>", 1, None, whole), row("<c>", 1, None, whole[:50]), row("<c>", 2, 999, whole[50:]), row("<d>", 1, None, whole[:9]), row("<d>", 3, len(whole), whole[9:])]
    got = {r["record_id"]: (r["complete"], r["payload"]) for r in warc.decode_records(warc.reassemble(spark.createDataFrame(rows, warc.SEGMENT))).collect()}
    assert got == {"<a>": (True, bytearray(b"abc")), "<b>": (False, None), "<c>": (False, None), "<d>": (False, None)}


def test_empty_table(spark, tmp_path):
    assert warc.page_report(report(spark, [], tmp_path)).collect() == []


def test_dechunk():
    assert warc.dechunk(b"0\r\n\r\n") == b""
    assert warc.dechunk(b"A;x=1\r\n0123456789\r\n0\r\n\r\n") == b"0123456789"
    assert warc.dechunk(b"5\r\nabc\r\n0\r\n\r\n") is None and warc.dechunk(b"zz\r\n") is None and warc.dechunk(b"") is None
