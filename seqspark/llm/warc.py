"""WARC archives: write page records in segments, read them back, put segments together.

A record longer than segment_bytes is split the way the WARC format has it: a first record with
WARC-Segment-Number 1 and continuation records that carry WARC-Segment-Origin-ID, their number
and, in the last one, WARC-Segment-Total-Length. Response bodies use chunked transfer framing.

Defined results for odd rows: a null html is an empty payload; equal payloads (empty ones too)
have one response, the row with the smallest page_id (null ids last, ties by place in the input);
repeated rows stay rows of their own; other columns of pages are ignored; an empty table gives an
archive without records and an empty result. A record with a missing or repeated segment, a wrong
total length or broken chunk framing keeps its row, with complete = false and a null payload.
"""

from __future__ import annotations

import zlib

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seqspark.llm.common import cut

#: Bytes of one chunk of a response body, of one segment, and records of one archive file.
CHUNK_BYTES, SEGMENT_BYTES, FILE_RECORDS = 8192, 65536, 8192

CRLF = "\r\n"
SEGMENT = T.StructType(
    [
        T.StructField("record_id", T.StringType()),
        T.StructField("origin_id", T.StringType()),
        T.StructField("warc_type", T.StringType()),
        T.StructField("target_uri", T.StringType()),
        T.StructField("refers_to", T.StringType()),
        T.StructField("payload_digest", T.StringType()),
        T.StructField("segment_number", T.IntegerType()),
        T.StructField("total_length", T.LongType()),
        T.StructField("block", T.BinaryType()),
    ]
)
RECORD = "record_id string, warc_type string, target_uri string, refers_to string, payload_digest string, complete boolean, n_segments int, content_length long, payload binary"


def base32_sha1(payload: Column) -> Column:
    """SHA-1 in upper-case base 32, without a prefix."""
    hexed = F.sha1(payload)
    groups = [F.lpad(F.conv(F.substring(hexed, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*groups), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def mark_revisits(pages: DataFrame) -> DataFrame:
    """pages(page_id, url, html) as (page_id, url, body, record_id, payload_digest, refers_to);
    refers_to is the response's record id for revisits, else null.

    Only digests that occur twice meet in the join. Their table is written first, so both join
    sides are plain exchanges and a payload that a third of all pages share is split by Spark's
    adaptive skew join.
    """
    rows = pages.select(
        "page_id",
        F.col("url").cast("string").alias("url"),
        F.coalesce(F.col("html").cast("binary"), F.lit(b"").cast("binary")).alias("body"),
        F.monotonically_increasing_id().alias("place"),
    )
    rows = rows.select("*", base32_sha1(F.col("body")).alias("payload_digest"))
    key = F.struct(F.col("page_id").isNull().alias("none"), "page_id", "place")
    first = rows.groupBy("payload_digest").agg(F.count("*").alias("n"), F.min(key).alias("first")).where("n > 1")
    first = cut(first.select("payload_digest", "first.page_id", "first.place").withColumnsRenamed({"page_id": "first_id", "place": "first_place"}), "digests")
    urn = lambda page, place: F.concat(F.lit("<urn:page:"), F.coalesce(page.cast("string"), F.lit("null")), F.lit(":"), place.cast("string"), F.lit(">"))
    joined = rows.join(first, "payload_digest", "left")
    return joined.select(
        "page_id", "url", "body", "payload_digest",
        urn(F.col("page_id"), F.col("place")).alias("record_id"),
        F.when(F.col("first_place") != F.col("place"), urn(F.col("first_id"), F.col("first_place"))).alias("refers_to"),
    )


def archive_lines(marked: DataFrame, chunk_bytes: int = CHUNK_BYTES, segment_bytes: int = SEGMENT_BYTES) -> DataFrame:
    """One row (value) per WARC record, segments included, ready for the text writer."""
    chunks = F.expr(
        f"""concat(array_join(transform(
              CASE WHEN octet_length(body) > 0 THEN sequence(0, (octet_length(body) - 1) div {chunk_bytes}) ELSE CAST(array() AS array<bigint>) END,
              i -> concat(lower(hex(least({chunk_bytes}, octet_length(body) - i * {chunk_bytes}))), '\\r\\n',
                          CAST(substring(body, CAST(i * {chunk_bytes} + 1 AS int), {chunk_bytes}) AS string), '\\r\\n')), ''), '0\\r\\n\\r\\n')"""
    )
    head = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
    block = F.when(
        F.col("refers_to").isNull(), F.concat(F.lit(head + "Transfer-Encoding: chunked\r\n\r\n"), chunks)
    ).otherwise(F.concat(F.lit(head + "Content-Length: "), F.octet_length("body").cast("string"), F.lit("\r\n\r\n")))
    rows = marked.select("*", block.cast("binary").alias("block"))
    rows = rows.select("*", F.octet_length("block").alias("total"), F.expr(f"CAST((octet_length(block) - 1) div {segment_bytes} + 1 AS int)").alias("parts"))
    rows = rows.select("*", F.explode(F.sequence(F.lit(1), F.col("parts"))).alias("part"))
    piece = F.expr(f"substring(block, (part - 1) * {segment_bytes} + 1, {segment_bytes})")
    rows = rows.select("record_id", "refers_to", "payload_digest", "url", "total", "parts", "part", piece.alias("piece"))

    def line(name: str, value: Column, when: Column | None = None) -> Column:
        text = F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))
        return text if when is None else F.when(when, text).otherwise("")

    later, split = F.col("part") > 1, F.col("parts") > 1
    kind = F.when(later, "continuation").when(F.col("refers_to").isNotNull(), "revisit").otherwise("response")
    own_id = F.when(later, F.concat(F.expr("substring(record_id, 1, length(record_id) - 1)"), F.lit(":"), F.col("part").cast("string"), F.lit(">"))).otherwise(F.col("record_id"))
    return rows.select(
        F.concat(
            F.lit("WARC/1.1" + CRLF),
            line("WARC-Type", kind),
            line("WARC-Record-ID", own_id),
            F.lit("WARC-Date: 2024-01-01T00:00:00Z" + CRLF),
            line("WARC-Target-URI", F.regexp_replace("url", r"[\x00-\x20]", "%20"), F.col("url").isNotNull()),
            line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest")), ~later),
            line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), F.col("refers_to").isNotNull()),
            line("WARC-Refers-To", F.col("refers_to"), F.col("refers_to").isNotNull()),
            line("WARC-Segment-Origin-ID", F.col("record_id"), later),
            line("WARC-Segment-Number", F.col("part").cast("string"), split),
            line("WARC-Segment-Total-Length", F.col("total").cast("string"), split & (F.col("part") == F.col("parts"))),
            F.lit("Content-Type: application/http;msgtype=response" + CRLF),
            line("Content-Length", F.octet_length("piece").cast("string")),
            F.lit(CRLF),
            F.col("piece").cast("string"),
        ).alias("value")
    )


def write_archives(pages: DataFrame, path: str, **sizes: int) -> None:
    """Write pages(page_id, url, html) as WARC files (gzip) under path. A record ends with two
    line ends, which are the text writer's separator."""
    lines = archive_lines(mark_revisits(pages), **sizes)
    lines.write.option("lineSep", CRLF * 2).option("compression", "gzip").option("maxRecordsPerFile", FILE_RECORDS).text(path)


class _Reader:
    """Bytes of one archive file, plain or gzip (any number of members), a piece at a time."""

    def __init__(self, data: bytes) -> None:
        self.data, self.at, self.buffer, self.pos = memoryview(data), 0, b"", 0
        self.zipped = bytes(self.data[:2]) == b"\x1f\x8b"
        self.inflate = zlib.decompressobj(31) if self.zipped else None

    def _more(self) -> bool:
        if self.at >= len(self.data):
            return False
        raw = self.data[self.at : self.at + (1 << 20)]
        self.at += len(raw)
        out = raw if not self.zipped else self.inflate.decompress(raw)
        if self.zipped and self.inflate.eof:
            self.at -= len(self.inflate.unused_data)
            self.inflate = zlib.decompressobj(31)
        self.buffer, self.pos = self.buffer[self.pos :] + bytes(out), 0
        return True

    def until(self, mark: bytes) -> bytes | None:
        seen = self.pos
        while (end := self.buffer.find(mark, seen)) < 0:
            seen = max(0, len(self.buffer) - self.pos - len(mark))
            if not self._more():
                return None
        out, self.pos = self.buffer[self.pos : end], end + len(mark)
        return out

    def take(self, n: int) -> bytes:
        while len(self.buffer) - self.pos < n and self._more():
            pass
        out, self.pos = self.buffer[self.pos : self.pos + n], self.pos + n
        return out


def parse_archive(data: bytes):
    """Yield SEGMENT tuples of one archive file; lengths, not separators, bound the records."""
    reader = _Reader(data)
    while (head := reader.until(b"\r\n\r\n")) is not None:
        if not head.strip(b"\r\n"):  # what ends the record before
            continue
        lines = head.lstrip(b"\r\n").decode("utf-8", "replace").split(CRLF)
        if not lines[0].startswith("WARC/"):
            return
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        block = reader.take(int(fields.get("content-length", 0)))
        number, total = fields.get("warc-segment-number"), fields.get("warc-segment-total-length")
        record = fields.get("warc-record-id")
        yield (
            record, fields.get("warc-segment-origin-id", record), fields.get("warc-type"), fields.get("warc-target-uri"), fields.get("warc-refers-to"),
            fields.get("warc-payload-digest"), int(number) if number else None, int(total) if total else None, block,
        )


def dechunk(body: bytes) -> bytes | None:
    """The payload of a body in chunked transfer framing; None where the framing is broken."""
    out, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        if end < 0:
            return None
        try:
            size = int(body[at:end].split(b";")[0], 16)
        except ValueError:
            return None
        at = end + 2
        if size == 0:
            return b"".join(out)
        if size < 0 or body[at + size : at + size + 2] != b"\r\n":
            return None
        out.append(body[at : at + size])
        at += size + 2


def decode_http(block: bytes | None) -> tuple[int | None, bytes | None]:
    """(declared content length, payload) of an HTTP response; None where it is not whole."""
    head, mark, body = (block or b"").partition(b"\r\n\r\n")
    if not mark:
        return None, None
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(b":") for x in head.split(b"\r\n")[1:])}
    payload = dechunk(body) if fields.get(b"transfer-encoding", b"").lower() == b"chunked" else body
    length = int(fields[b"content-length"]) if b"content-length" in fields else None if payload is None else len(payload)
    return length, payload


def read_segments(spark: SparkSession, path: str) -> DataFrame:
    """Every WARC record under path, segments apart."""

    def parse(batches):
        names = SEGMENT.names
        for pdf in batches:
            for data in pdf["content"]:
                rows, size = [], 0
                for row in parse_archive(data):
                    rows.append(row)
                    size += len(row[-1])
                    if size > 1 << 24:
                        yield _typed(pd.DataFrame(rows, columns=names))
                        rows, size = [], 0
                yield _typed(pd.DataFrame(rows, columns=names))

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(parse, SEGMENT)


def _typed(pdf: pd.DataFrame) -> pd.DataFrame:
    return pdf.astype({"segment_number": "Int32", "total_length": "Int64"})


def reassemble(segments: DataFrame) -> DataFrame:
    """Whole records: segments grouped by origin id, in order of their number, lengths checked.

    Records that were never split take no part in the grouping. A group holds the segments of one
    record, so its size is that of the record.
    """
    whole = segments.where("segment_number IS NULL").select(
        "record_id", "warc_type", "target_uri", "refers_to", "payload_digest", F.lit(True).alias("complete"), F.lit(1).alias("n_segments"), "block"
    )
    first = lambda c: F.max(F.when(F.col("segment_number") == 1, F.col(c))).alias(c)
    grouped = (
        segments.where("segment_number IS NOT NULL")
        .groupBy(F.col("origin_id").alias("record_id"))
        .agg(
            *(first(c) for c in ("warc_type", "target_uri", "refers_to", "payload_digest")),
            F.max("total_length").alias("total"),
            F.array_sort(F.collect_list(F.struct("segment_number", "block"))).alias("parts"),
        )
    )
    numbers = F.transform("parts", lambda p: p["segment_number"])
    joined = F.array_join(F.transform("parts", lambda p: p["block"].cast("string")), "").cast("binary")
    grouped = grouped.select("*", numbers.alias("numbers"), joined.alias("joined"))
    complete = (F.col("numbers") == F.sequence(F.lit(1), F.size("parts"))) & (F.octet_length("joined") == F.col("total"))
    return whole.unionByName(
        grouped.select(
            "record_id", "warc_type", "target_uri", "refers_to", "payload_digest",
            F.coalesce(complete, F.lit(False)).alias("complete"), F.size("parts").alias("n_segments"), F.col("joined").alias("block"),
        )
    )


def decode_records(records: DataFrame) -> DataFrame:
    """records of reassemble() with the payload instead of the HTTP block, see RECORD."""

    def decode(batches):
        for pdf in batches:
            both = [decode_http(b) if ok else (None, None) for b, ok in zip(pdf["block"], pdf["complete"], strict=True)]
            pdf["content_length"] = pd.array([x for x, _ in both], dtype="Int64")
            pdf["payload"] = [x for _, x in both]
            pdf["complete"] = [x is not None for _, x in both]
            yield pdf.drop(columns="block")

    return records.mapInPandas(decode, RECORD)


def page_report(records: DataFrame) -> DataFrame:
    """Per record: page_id, payload_bytes, payload_digest, record_type, refers_to, n_segments.

    The digest of a response is computed from its decoded payload; a revisit has none, so its
    digest and length are those that its headers declare.
    """
    page = lambda c: F.regexp_extract(c, r"^<urn:page:(-?\d+):", 1)
    number = lambda c: F.when(page(c) != "", page(c).cast("long"))
    revisit = F.col("warc_type") == "revisit"
    return records.select(
        number("record_id").alias("page_id"),
        F.when(revisit, F.col("content_length")).otherwise(F.octet_length("payload").cast("long")).alias("payload_bytes"),
        F.when(revisit, F.regexp_replace("payload_digest", "^sha1:", "")).otherwise(base32_sha1(F.col("payload"))).alias("payload_digest"),
        F.col("warc_type").alias("record_type"),
        number("refers_to").alias("refers_to"),
        "n_segments",
    )


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    return decode_records(reassemble(read_segments(spark, path)))
