"""WARC archives: writing with segments and chunked framing, and reading back.

A page becomes one WARC/1.1 record whose block is an HTTP response in chunked transfer framing. A
block longer than ``segment`` bytes is split: the first part is the record itself, the others are
``continuation`` records that name it in WARC-Segment-Origin-ID and carry a segment number; the last
also has WARC-Segment-Total-Length. A page whose payload another record has already is a
``revisit`` without the payload, which names the page of that record and the payload's digest.

Spark's text writer writes the files: a record is one value, and the two line ends that must follow
it are the separator. Files thus pass through the output committer and any Hadoop file system.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import scratch, stored, tidy

END = b"\r\n\r\n"
#: Longest block of a record, of a chunk in its framing, and the number of records in a file.
SEGMENT, CHUNK, RECORDS = 32_768, 4096, 1024
#: Payloads from this size on are written once.
LEAST = 1000
_OK = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked" + END
_URI = re.compile(rb"<urn:x-page:(-?\d*):(-?\d+)>")


def chunked(payload: bytes, size: int = CHUNK) -> bytes:
    """Chunked transfer framing of ``payload``."""
    parts = [b"%x\r\n%b\r\n" % (len(p := payload[i : i + size]), p) for i in range(0, len(payload), size)]
    return b"".join([*parts, b"0\r\n\r\n"])


def dechunked(body: bytes) -> bytes:
    """The payload of a chunked body. Extensions and trailers are skipped; a cut or wrong frame raises ValueError."""
    out, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        if end < 0:
            raise ValueError("a chunk has no size")
        size = int(body[at:end].split(b";")[0].strip(), 16)
        at = end + 2
        if size == 0:
            if not (body.startswith(b"\r\n", at) or body.find(END, at) >= 0):
                raise ValueError("the last chunk has no end")
            return b"".join(out)
        out.append(body[at : at + size])
        at += size
        if len(out[-1]) != size or body[at : at + 2] != b"\r\n":
            raise ValueError("a chunk is cut")
        at += 2


def _line(value: str | None) -> bytes:
    """A header's value: no line ends."""
    return re.sub(r"[\r\n]+", " ", value or "").encode()


def _record_id(page_id: int | None, row: int) -> bytes:
    return b"<urn:x-page:%b:%d>" % (b"" if page_id is None else b"%d" % page_id, row)


def records(page_id: int | None, row: int, url: str | None, payload: bytes, digest: str, refers_to: bytes, segment: int = SEGMENT) -> list[bytes]:
    """The record of a page and its continuations, each without the END that follows it. ``refers_to``: id of the record that a revisit refers to, else empty."""
    uri, revisit = _record_id(page_id, row), bool(refers_to)
    block = _OK + (b"" if revisit else chunked(payload))
    parts = [block[i : i + segment] for i in range(0, len(block), segment)]
    out = []
    for i, part in enumerate(parts):
        head = [b"WARC/1.1", b"WARC-Type: " + (b"continuation" if i else b"revisit" if revisit else b"response")]
        head.append(b"WARC-Record-ID: " + (b"<urn:x-page-segment:%d:%d>" % (row, i + 1) if i else uri))
        head += [b"WARC-Date: 1970-01-01T00:00:00Z", b"WARC-Target-URI: " + _line(url)]
        if not i:
            head += [b"WARC-Payload-Digest: sha1:" + digest.encode(), b"Content-Type: application/http; msgtype=response", b"WARC-Identified-Payload-Length: %d" % len(payload)]
        if revisit:
            head += [b"WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", b"WARC-Refers-To: " + refers_to]
        if len(parts) > 1:
            head.append(b"WARC-Segment-Number: %d" % (i + 1))
            if i:
                head.append(b"WARC-Segment-Origin-ID: " + uri)
            if i == len(parts) - 1:
                head.append(b"WARC-Segment-Total-Length: %d" % len(block))
        head.append(b"Content-Length: %d" % len(part))
        out.append(b"\r\n".join(head) + END + part)
    return out


def write_archives(pages: DataFrame, path: str, least: int = LEAST, segment: int = SEGMENT, per_file: int = RECORDS) -> None:
    """Write ``pages`` (page_id, url, html; other columns are ignored) as WARC files in ``path``, each one gzip member.

    A null html is an empty payload; a very long one, of up to the two gigabytes of a row, is many segments. Of equal payloads of ``least`` bytes or more, the one with the
    largest page_id is a response and the others refer to it; rows that share that page_id are all
    responses, as are payloads without any page_id. An empty table gives no records.
    """
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload")).withColumn("digest", F.sha1("payload")).withColumn("row", F.monotonically_increasing_id())
    # Stored, so that a row has one number wherever it is named, and is digested once.
    rows = stored(rows, f"{scratch(pages.sparkSession)}/rows")
    copies = rows.where(F.octet_length("payload") >= least).groupBy("digest").agg(F.max(F.struct("page_id", "row")).alias("kept"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    kept = F.when(F.octet_length("payload") >= least, F.col("kept"))
    known = rows.join(copies, "digest", "left").select("page_id", "url", "payload", "digest", kept["page_id"].alias("kept"), "row", kept["row"].alias("kept_row"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out, size = [], 0
            for page_id, url, data, digest, kept, row, kept_row in zip(*(b.column(i) for i in range(7)), strict=True):
                i, k = page_id.as_py(), kept.as_py()
                out += records(i, row.as_py(), url.as_py(), data.as_py(), digest.as_py(), b"" if k is None or i == k else _record_id(k, kept_row.as_py()), segment)
                size += len(out[-1])
                if size > 1 << 24:
                    yield pa.RecordBatch.from_pydict({"record": pa.array(out, pa.binary())})
                    out, size = [], 0
            yield pa.RecordBatch.from_pydict({"record": pa.array(out, pa.binary())})

    written = known.mapInArrow(tidy(run), "record binary").select(F.col("record").cast("string").alias("value"))
    written.write.option("lineSep", END.decode()).option("compression", "gzip").option("maxRecordsPerFile", per_file).text(path)


def parse_archive(data: bytes) -> Iterator[tuple[dict[bytes, bytes], bytes]]:
    """Header fields (names in lower case) and block of each record; gzip is undone. What isn't WARC raises ValueError."""
    if data[:2] == b"\x1f\x8b":
        import zlib

        parts = []
        while data:
            d = zlib.decompressobj(31)
            parts.append(d.decompress(data))
            data = d.unused_data
        data = b"".join(parts)
    at = 0
    while at < len(data):
        end = data.find(END, at)
        lines = data[at:end].split(b"\r\n")
        if end < 0 or not lines[0].startswith(b"WARC/"):
            raise ValueError("not a WARC record")
        head = {k.strip().lower(): v.strip() for k, _, v in (x.partition(b":") for x in lines[1:])}
        start, size = end + 4, int(head[b"content-length"])
        block = data[start : start + size]
        if len(block) != size or data[start + size : start + size + 4] != END:
            raise ValueError("a record is cut")
        yield head, block
        at = start + size + 4


_SEGMENT = pa.schema([("origin", pa.binary()), ("number", pa.int32()), ("total", pa.int64()), ("type", pa.string()), ("url", pa.string()), ("digest", pa.string()), ("length", pa.int64()), ("refers_to", pa.int64()), ("block", pa.binary())])
_SEGMENT_DDL = "origin binary, number int, total long, type string, url string, digest string, length long, refers_to long, block binary"
_PAGE_DDL = "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long"
_PAGE = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for content in b.column(0):
            rows: dict[str, list] = {k: [] for k in _SEGMENT.names}
            for head, block in parse_archive(content.as_py()):
                get = head.get
                refers = _URI.fullmatch(get(b"warc-refers-to", b""))
                whole = {"origin": get(b"warc-segment-origin-id", get(b"warc-record-id")), "number": int(get(b"warc-segment-number", b"0")), "total": int(t) if (t := get(b"warc-segment-total-length")) else None, "type": get(b"warc-type").decode(), "url": get(b"warc-target-uri", b"").decode(), "digest": get(b"warc-payload-digest", b"").decode().removeprefix("sha1:"), "length": int(get(b"warc-identified-payload-length", b"0")), "refers_to": int(refers[1]) if refers else None, "block": block}
                for k, v in whole.items():
                    rows[k].append(v)
            yield pa.RecordBatch.from_pydict(rows, schema=_SEGMENT)


def _payload(origin: bytes, kind: str, block: bytes, digest: str) -> bytes:
    head, _, body = block.partition(END)
    data = dechunked(body) if b"transfer-encoding: chunked" in head.lower() and kind != "revisit" else body
    if kind != "revisit" and hashlib.sha1(data).hexdigest() != digest:
        raise ValueError(f"{origin!r}: the payload doesn't have its digest")
    return data


def _pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Segments in order (origin, type, url, digest, length, refers_to, blocks, total) to pages. A null total is that of a record that isn't segmented."""
    for b in batches:
        rows: dict[str, list] = {k: [] for k in _PAGE.names}
        for origin, kind, url, digest, length, refers_to, blocks, total in zip(*(b.column(i) for i in range(8)), strict=True):
            o, block = origin.as_py(), b"".join(memoryview(x.as_buffer()) for x in blocks.values)
            if total.is_valid and total.as_py() != len(block):
                raise ValueError(f"{o!r}: segments don't have their total length")
            page_id = m[1] if (m := _URI.fullmatch(o)) else b""
            data = _payload(o, kind.as_py(), block, digest.as_py())
            size = length.as_py() if kind.as_py() == "revisit" else len(data)
            for k, v in zip(_PAGE.names, (int(page_id) if page_id else None, url.as_py(), data, size, digest.as_py(), kind.as_py(), refers_to.as_py()), strict=True):
                rows[k].append(v)
        yield pa.RecordBatch.from_pydict(rows, schema=_PAGE)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """A row for each record of the archives in ``path``: page_id, url, payload, payload_bytes, payload_digest, record_type, refers_to.

    Segments are grouped by their origin, put in order of their numbers, and joined; gaps, a missing
    end, a wrong total length or digest raise. A revisit has no payload of its own, but an empty
    one; its payload_bytes is the length that its record states.
    """
    files = spark.read.format("binaryFile").load(path).select("content")
    segments = files.mapInArrow(tidy(_segments), _SEGMENT_DDL)
    alone = segments.where("number = 0").select("origin", "type", "url", "digest", "length", "refers_to", F.array("block").alias("blocks"), F.lit(None).cast("long").alias("total"))
    part = F.struct("number", "total", "type", "url", "digest", "length", "refers_to", "block")
    grouped = segments.where("number > 0").groupBy("origin").agg(F.sort_array(F.collect_list(part)).alias("parts"))
    first, last, n = F.col("parts")[0], F.element_at("parts", -1), F.size("parts")
    numbers = F.transform("parts", lambda p: p["number"])
    right = (first["number"] == 1) & (numbers == F.sequence(F.lit(1), n)) & last["total"].isNotNull()
    blocks = F.when(right, F.transform("parts", lambda p: p["block"])).otherwise(F.raise_error(F.lit("a segment is missing")).cast("array<binary>"))
    joined = grouped.select("origin", *(first[k].alias(k) for k in ("type", "url", "digest", "length", "refers_to")), blocks.alias("blocks"), last["total"].alias("total"))
    whole = alone.unionByName(joined)
    return whole.mapInArrow(tidy(_pages), _PAGE_DDL)


def resolve_revisits(read: DataFrame) -> DataFrame:
    """``read_archives`` rows with each revisit's payload taken from the record that it refers to."""
    kept = read.where("record_type = 'response'").groupBy(F.col("page_id").alias("refers_to"), "payload_digest").agg(F.first("payload").alias("_payload"))
    return read.join(kept, ["refers_to", "payload_digest"], "left").withColumn("payload", F.coalesce("_payload", "payload")).select(*_PAGE.names)


def warc_query(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Archive ``pages``, read the archives back, and describe each page by what was read."""
    path = scratch(spark) + "/warc"
    write_archives(pages, path)
    return read_archives(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
