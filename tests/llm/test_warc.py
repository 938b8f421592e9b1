"""WARC archives: what is read back against what was written."""

import glob
import hashlib

import pytest

from lumenfold.llm import warc
from lumenfold.llm.common import table

LONG = "".join(f"<p>é {i}\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\n0\r\n\r\n</p>" for i in range(9000))
PAGES = [
    (1, "http://a/1", "<html>short</html>", "x"), (2, "http://a/2", None, "x"), (3, None, "", "x"), (4, "http://a\r\nX: y", "<html>short</html>", "x"),
    (5, "http://a/5", LONG, "x"), (6, "http://a/6", LONG, "x"), (9, "http://a/9", LONG, "x"), (7, "u", "b" * 999, "x"), (8, "u", "b" * 999, "x"),
    (10, "u", "c" * 1000, "x"), (11, "u", "c" * 1000, "x"), (12, "u", "é" * 500, "x"), (13, "u", "é" * 500, "x"), (13, "u", "é" * 500, "x"), (None, "u", "é" * 500, "x"), (None, "u", "alone" * 400, "x"),
]


def plain(rows):
    out = []
    for i, _, html, *_ in rows:
        p = (html or "").encode()
        same = [j for j, _, h, *_ in rows if (h or "").encode() == p and j is not None]
        kept = max(same) if same and len(p) >= 1000 else i
        out.append((i, len(p), hashlib.sha1(p).hexdigest(), "response" if i == kept else "revisit", None if i == kept else kept))
    return sorted(out, key=str)


def test_query_equals_plain(spark, sf):
    rows = [(r["page_id"], r["url"], r["html"]) for r in table(spark, sf, "pages").collect()]
    assert sorted((tuple(r) for r in warc.warc_query(spark, table(spark, sf, "pages")).collect()), key=str) == plain(rows)


@pytest.mark.parametrize("segment", [200, 5000])
def test_segments_and_revisits(spark, tmp_path, segment):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string, digest string").repartition(3)
    path = f"file://{tmp_path}/w"
    warc.write_archives(pages, path, segment=segment, per_file=50)
    assert len(glob.glob(f"{tmp_path}/w/*.gz")) > 2
    read = warc.read_archives(spark, path)
    assert sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in read.collect()), key=str) == plain(PAGES)
    heads = [h for f in glob.glob(f"{tmp_path}/w/*.gz") for h, _ in warc.parse_archive(open(f, "rb").read())]
    ids = {h[b"warc-record-id"]: h for h in heads}
    refers = [h for h in heads if h[b"warc-type"] == b"revisit"]
    assert len(refers) > 3 and all(ids[h[b"warc-refers-to"]][b"warc-payload-digest"] == h[b"warc-payload-digest"] and ids[h[b"warc-refers-to"]][b"warc-type"] == b"response" for h in refers)
    whole = sorted(((r["page_id"], bytes(r["payload"]).decode()) for r in warc.resolve_revisits(read).collect()), key=str)
    assert whole == sorted(((i, h or "") for i, _, h, _ in PAGES), key=str)


def test_lost_segment_raises(spark, tmp_path):
    path = f"{tmp_path}/w"
    warc.write_archives(spark.createDataFrame([(5, "u", LONG)], "page_id long, url string, html string"), f"file://{path}", segment=100_000, per_file=1)
    files = sorted(glob.glob(f"{path}/*.gz"))
    assert len(files) > 3
    import os

    os.remove(files[1])
    with pytest.raises(Exception, match="segment is missing"):
        warc.read_archives(spark, f"file://{path}").collect()


def test_framing():
    for n in (0, 1, 4095, 4096, 4097, 20000):
        p = bytes(i % 251 for i in range(n))
        assert warc.dechunked(warc.chunked(p)) == p
    assert warc.dechunked(b"5;ext=1\r\nhello\r\n0\r\nTrailer: x\r\n\r\n") == b"hello"
    for bad in (b"", b"5\r\nhel", b"5\r\nhelloXX0\r\n\r\n", b"0\r\n"):
        with pytest.raises(ValueError):
            warc.dechunked(bad)


def test_no_rows(spark, tmp_path):
    none = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.warc_query(spark, none).count() == 0
