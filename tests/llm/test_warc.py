"""Archives: written and read back, hand-made ones by the standard gzip module, and broken ones."""

import gzip
import hashlib
import io
from collections import Counter

import pytest

from ledgerflow.llm import warc


def pages_of(spark, rows):
    return spark.createDataFrame([(*r, b"x", "s", "r", 1) for r in rows], "page_id long, url string, html string, payload binary, sha string, record_type string, keeper int")


def rows_of(df):
    return Counter(tuple(r) for r in df.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect())


def plain(rows):
    data = [(i, (h or "").encode()) for i, _, h in rows]
    out = Counter()
    for i, b in data:
        ids = [j for j, o in data if o == b and j is not None]
        keeper = max(ids) if len(b) >= 1000 and ids and sum(o == b for _, o in data) > 1 else None
        revisit = keeper is not None and i != keeper
        out[i, len(b), hashlib.sha1(b).hexdigest(), "revisit" if revisit else "response", keeper if revisit else None] += 1
    return out


def test_odd_pages_round_trip(spark):
    big, huge = "<p>é漢😀\r\n\r\n</p>" * 100, "z" * 3_000_000
    rows = [(1, "http://a/ b\r\nX: y", big), (2, None, big), (7, "u", big), (None, "u", big), (7, "again", big), (3, "", None), (4, "u", ""), (5, "u", "short"), (6, "u", "short")]
    rows += [(8, "u", "a" * 999), (9, "u", "a" * 999), (10, "u", "a" * 1000), (11, "u", "a" * 1000), (12, "u", huge), (13, "u", huge), (None, "u", "n" * 1000), (None, "u", "n" * 1000)]
    assert rows_of(warc.round_trip(pages_of(spark, rows))) == plain(rows)


def test_hot_payload(spark):
    rows = [(i, "u", "same " * 300 if i % 3 == 0 else f"page {i} " * 200) for i in range(900)]
    assert rows_of(warc.round_trip(pages_of(spark, rows).repartition(7))) == plain(rows)


def test_empty_table(spark):
    assert warc.round_trip(pages_of(spark, [])).count() == 0


def test_files_are_plain_archives(spark, tmp_path):
    rows = [(i, f"http://h/{i}", "x" * 1500 if i < 3 else f"page {i} " * 50) for i in range(40)]
    files = warc.write(warc.with_types(pages_of(spark, rows)).repartition(2), f"file://{tmp_path}", file_bytes=2000)
    listed = files.collect()
    assert len(listed) > 2 and sum(r["records"] for r in listed) == 40
    text = b"".join(gzip.open(r["file"].removeprefix("file://")).read() for r in listed)
    assert text.count(b"WARC/1.1\r\n") == 40 and text.count(b"WARC-Type: revisit\r\n") == 2 and b"WARC-Target-URI: http://h/39\r\n" in text
    back = {r["page_id"]: r for r in warc.read(files).collect()}
    assert {i: back[i]["payload"] for i in back if back[i]["record_type"] == "response"} == {i: h.encode() for i, _, h in rows if i not in (0, 1)}
    assert back[0]["payload"] is None and back[0]["payload_bytes"] == 1500
    for r in back.values():  # the place of every record is where its member starts
        with open(r["file"].removeprefix("file://"), "rb") as f:
            f.seek(r["offset"])
            assert next(warc.read_stream(f))["record_id"] == r["record_id"]


def record(block, kind="resource", extra=b"", length=None, tail=b"\r\n\r\n", content=b"text/plain"):
    n = len(block) if length is None else length
    return gzip.compress(b"WARC/1.0\r\nWARC-Type: " + kind.encode() + b"\r\nContent-Type: " + content + b"\r\n" + extra + b"Content-Length: %d\r\n\r\n" % n + block + tail)


def test_other_record_types_and_folded_fields():
    digest = b"WARC-Block-Digest: sha1:" + hashlib.sha1(b"abc").hexdigest().encode() + b"\r\n"
    data = record(b"software: x\r\n", "warcinfo") + record(b"abc", extra=digest + b"WARC-Target-URI:\r\n http://folded\r\n") + record(b"") + record(b"q" * 500_000, extra=b"WARC-Block-Digest: md5:00\r\n")
    got = list(warc.read_stream(io.BytesIO(data)))
    assert [r["payload_bytes"] for r in got] == [13, 3, 0, 500_000] and got[1]["target_uri"].strip() == "http://folded"
    assert list(warc.read_stream(io.BytesIO(b""))) == []


@pytest.mark.parametrize(
    "data,says",
    [
        (record(b"abc", length=9), "do not end|shorter"),
        (record(b"abc", length=2), "do not end together"),
        (record(b"abc", tail=b""), "do not end together"),
        (record(b"abc", extra=b"WARC-Block-Digest: sha1:" + b"A" * 32 + b"\r\n"), "block differs"),
        (record(b"abc", extra=b"WARC-Payload-Digest: sha1:" + b"0" * 40 + b"\r\n"), "payload differs"),
        (record(b"HTTP/1.1 200 OK\r\nno end", "response", content=b"application/http"), "head does not end"),
        (record(b"abc")[:-20], "cut off"),
        (gzip.compress(b"hello\r\n\r\n"), "not a WARC record"),
        (b"plain text", "not a gzip member"),
        (gzip.compress(b"WARC/1.0\r\nContent-Length: x\r\n\r\n"), "Content-Length"),
        (record(b"ok") + b"\0junk", "at byte [1-9]"),
    ],
)
def test_broken_archives(data, says):
    with pytest.raises(ValueError, match=says):
        list(warc.read_stream(io.BytesIO(data)))


def test_broken_file_fails_the_job(spark, tmp_path):
    (tmp_path / "bad.warc.gz").write_bytes(record(b"abc")[:-9])
    files = spark.createDataFrame([(f"file://{tmp_path}/bad.warc.gz",)], "file string")
    with pytest.raises(Exception, match="bad.warc.gz at byte 0"):
        warc.read(files).collect()


def test_revisit_without_response_raises(spark):
    rows = [("f", 0, "revisit", "<a>", None, "<gone>", 1, 5, "d")]
    with pytest.raises(Exception, match="no response for"):
        warc.resolved(spark.createDataFrame(rows, warc.FIELDS)).collect()
