"""Web archives: pages written as WARC records, one gzip member each, and a sequential reader
that inflates, frames and verifies them piece by piece."""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerflow.sources.readers import materialise, scratch_dir

# Fixed values of the format.
VERSION = b"WARC/1.1"
PROFILE = b"http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
GZIP = 31  # window bits of a gzip member
END = b"\r\n\r\n"

DATE = "2000-01-01T00:00:00Z"  # the given pages have no time of their own
LEAST_SHARED = 1000
FILE_BYTES = 512 << 20
CHUNK = 1 << 16
HEAD_LIMIT = 1 << 20
BATCH_RECORDS, BATCH_BYTES = 1000, 8 << 20
READ_TASKS = 10_000

FIELDS = "file string, offset long, record_type string, record_id string, target_uri string, refers_to_id string, page_id long, payload_bytes long, payload_digest string"


def _filesystem(uri: str):
    return pyarrow.fs.FileSystem.from_uri(uri.replace("s3a://", "s3://", 1))


def with_types(pages: DataFrame, least_shared: int = LEAST_SHARED) -> DataFrame:
    """(page_id, url, payload binary, sha1 string, record_type, key, refers_key) of (page_id, url,
    html). Of the pages with one payload of at least ``least_shared`` bytes the one with the
    largest page_id is the response and others revisit it; all smaller ones are responses.

    Payloads meet as digests, counted per task first; only those that occur twice are joined
    back, so a page's text is moved only where these are too many to broadcast. Rows that repeat
    the largest page_id are responses too; a null page_id counts as the smallest, and pages
    that all lack an id are responses. Null html is empty."""
    payload = F.coalesce("html", F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("sha", F.sha2("payload", 256))
    large = rows.filter(F.octet_length("payload") >= least_shared)
    shared = large.groupBy("sha").agg(F.max("page_id").alias("keeper"), F.count("*").alias("rows")).filter("rows > 1 and keeper is not null")
    joined = rows.join(materialise(shared.select(F.col("sha").alias("of"), "keeper")), F.col("sha") == F.col("of"), "left")
    revisit = F.col("keeper").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("keeper"))

    def key(page):
        return F.md5(F.concat_ws(":", F.coalesce(F.col(page).cast("string"), F.lit("null")), "sha"))

    return joined.select(
        "page_id", "url", "payload", F.sha1("payload").alias("sha1"), F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        key("page_id").alias("key"), F.when(revisit, key("keeper")).alias("refers_key"),
    )


def write(records: DataFrame, folder: str, file_bytes: int = FILE_BYTES, date: str = DATE) -> DataFrame:
    """Archives of ``with_types`` rows in a folder that all machines share; returns the table of
    its files (file, records, bytes).

    Every task writes files of about ``file_bytes`` under names of its own and reports them once
    they are closed. Only reported files belong to the archive: what a lost executor or a second
    attempt left behind is never read."""

    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _filesystem(folder)
        fs.create_dir(root, recursive=True)
        out, done = None, []
        for batch in batches:
            for row in zip(*(batch.column(i) for i in range(batch.num_columns))):
                if out is None:
                    name, count, size = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = fs.open_output_stream(f"{root}/{name}", compression=None)
                member = _member(*(v.as_py() for v in row), date)
                out.write(member)
                count, size = count + 1, size + len(member)
                if size >= file_bytes:
                    out.close()
                    out = done.append((f"{folder}/{name}", count, size))
        if out is not None:
            out.close()
            done.append((f"{folder}/{name}", count, size))
        yield pa.RecordBatch.from_pylist([dict(zip(("file", "records", "bytes"), d)) for d in done], pa.schema([("file", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())]))

    columns = records.select("page_id", "url", "payload", "sha1", "record_type", "key", "refers_key")
    return materialise(columns.mapInArrow(written, "file string, records long, bytes long"))


def _sha1(digest: bytes) -> bytes:
    return b"sha1:" + base64.b32encode(digest)


def _urn(key: str) -> bytes:
    return f"<urn:uuid:{uuid.UUID(hex=key)}>".encode()


def _member(page_id, url, payload, sha1, record_type, key, refers_key, date) -> bytes:
    """One record as a gzip member. A revisit has the head of the answer only; that head keeps the
    payload's length."""
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d" % len(payload) + END
    body = payload if record_type == "response" else b""
    block = hashlib.sha1(head)
    block.update(body)
    fields = [(b"WARC-Type", record_type.encode()), (b"WARC-Record-ID", _urn(key)), (b"WARC-Date", date.encode())]
    if url is not None:
        fields.append((b"WARC-Target-URI", "".join(c if c > " " else f"%{ord(c):02X}" for c in url).encode()))
    fields += [(b"WARC-Payload-Digest", _sha1(bytes.fromhex(sha1))), (b"WARC-Block-Digest", _sha1(block.digest()))]
    if refers_key is not None:
        fields += [(b"WARC-Profile", PROFILE), (b"WARC-Refers-To", _urn(refers_key))]
    if page_id is not None:
        fields.append((b"Page-Id", b"%d" % page_id))
    fields += [(b"Content-Type", b"application/http;msgtype=response"), (b"Content-Length", b"%d" % (len(head) + len(body)))]
    gzip = zlib.compressobj(6, zlib.DEFLATED, GZIP)
    top = VERSION + b"\r\n" + b"".join(k + b": " + v + b"\r\n" for k, v in fields) + b"\r\n"
    return b"".join([gzip.compress(top + head), gzip.compress(body), gzip.compress(END), gzip.flush()])


class Member:
    """The bytes of one gzip member, inflated in pieces of at most CHUNK bytes."""

    def __init__(self, source: Source):
        self.source, self.inflate, self.held = source, zlib.decompressobj(GZIP), b""

    def more(self) -> bytes:
        """The next piece, empty at the member's end."""
        while not self.inflate.eof:
            data = self.inflate.unconsumed_tail or self.source.take()
            try:
                out = self.inflate.decompress(data, CHUNK)
            except zlib.error as e:
                raise ValueError(f"not a gzip member: {e}") from None
            if self.inflate.eof:
                self.source.give_back(self.inflate.unused_data)
            if out:
                return out
            if not data and not self.inflate.eof:
                raise ValueError("a member is cut off")
        return b""

    def until_blank(self, limit: int) -> bytes:
        """What comes before an empty line, within ``limit`` bytes; the line is passed over."""
        held = self.held
        while (at := held.find(END)) < 0 or at > limit:
            if len(held) > limit or not (piece := self.more()):
                raise ValueError("a head does not end")
            held += piece
        self.held = held[at + len(END) :]
        return held[:at]

    def pieces(self, length: int) -> Iterator[bytes]:
        """The next ``length`` bytes in pieces."""
        while length:
            piece = self.held or self.more()
            if not piece:
                raise ValueError("a block is shorter than its Content-Length")
            self.held = piece[length:]
            yield piece[:length]
            length -= min(len(piece), length)

    def ended(self) -> bool:
        """Whether nothing but the two line ends that close a record is left."""
        rest = self.held
        while len(rest) <= len(END) and (piece := self.more()):
            rest += piece
        return rest == END


class Source:
    """A stream of compressed bytes with its position; ``give_back`` undoes the end of a read."""

    def __init__(self, stream):
        self.stream, self.rest, self.at = stream, b"", 0

    def take(self) -> bytes:
        data, self.rest = self.rest or self.stream.read(CHUNK), b""
        self.at += len(data)
        return data

    def give_back(self, data: bytes) -> None:
        self.rest, self.at = data, self.at - len(data)

    def ended(self) -> bool:
        self.give_back(self.take())
        return not self.rest


def _fields(lines: list[bytes]) -> dict[str, str]:
    out: dict[str, str] = {}
    last = None
    for line in lines:
        if line[:1] in (b" ", b"\t") and last:  # goes on from the line before
            out[last] += " " + line.strip().decode("utf-8", "replace")
            continue
        name, colon, value = line.partition(b":")
        if not colon:
            raise ValueError(f"no colon in the field {line[:80]!r}")
        last = name.strip().lower().decode("utf-8", "replace")
        out[last] = value.strip().decode("utf-8", "replace")
    return out


def _length(fields: dict[str, str]) -> int:
    value = fields.get("content-length", "")
    if not value.isascii() or not value.isdigit():
        raise ValueError(f"no usable Content-Length: {value!r}")
    return int(value)


def _stated(value: str) -> str | None:
    """Hex of a digest field in base 32 or hex; null for algorithms other than SHA-1."""
    kind, _, text = value.partition(":")
    if kind.lower() != "sha1":
        return None
    return text.lower() if len(text) == 40 else base64.b32decode(text.upper()).hex()


def read_record(member: Member, keep: bool = True) -> dict:
    """The fields of one record and its payload: what follows the HTTP head in an answer or
    request, else the block. Raises ValueError where framing or a digest does not hold."""
    lines = member.until_blank(HEAD_LIMIT).split(b"\r\n")
    if not lines[0].startswith(b"WARC/"):
        raise ValueError(f"not a WARC record: {lines[0][:80]!r}")
    fields = _fields(lines[1:])
    length, kind = _length(fields), fields.get("warc-type", "")
    http = fields.get("content-type", "").startswith("application/http")
    block, payload, kept, size, head = hashlib.sha1(), hashlib.sha1(), [], 0, b"" if http else None
    inside = None
    for piece in member.pieces(length):
        block.update(piece)
        if head is not None:
            head += piece
            at = head.find(END)
            if at < 0:
                if len(head) > HEAD_LIMIT:
                    raise ValueError("an HTTP head does not end")
                continue
            inside, piece, head = _fields(head[:at].split(b"\r\n")[1:]), head[at + len(END) :], None
        payload.update(piece)
        size += len(piece)
        if keep:
            kept.append(piece)
    if head:
        raise ValueError("an HTTP head does not end")
    if not member.ended():
        raise ValueError("the record and its member do not end together")
    digest = payload.hexdigest()
    stated = {k: _stated(fields[k]) for k in ("warc-block-digest", "warc-payload-digest") if k in fields}
    if stated.get("warc-block-digest") not in (None, block.hexdigest()):
        raise ValueError("the block differs from its digest")
    if kind == "revisit":
        digest = stated.get("warc-payload-digest")
        size = _length(inside) if inside and "content-length" in inside else None
    elif stated.get("warc-payload-digest") not in (None, digest):
        raise ValueError("the payload differs from its digest")
    page = fields.get("page-id")
    return {
        "record_type": kind, "record_id": fields.get("warc-record-id"), "target_uri": fields.get("warc-target-uri"),
        "refers_to_id": fields.get("warc-refers-to"), "page_id": None if page is None else int(page), "payload_bytes": size,
        "payload_digest": digest, "payload": b"".join(kept) if keep and kind != "revisit" else None,
    }


def read_stream(stream, keep: bool = True) -> Iterator[dict]:
    """Records of a stream in their order, each with the place of its member."""
    source = Source(stream)
    while not source.ended():
        at = source.at
        try:
            yield {"offset": at, **read_record(Member(source), keep)}
        except ValueError as e:
            raise ValueError(f"at byte {at}: {e}") from None


def read(files: DataFrame, payload: bool = True) -> DataFrame:
    """The records of archives (file): place, type, ids, length and hex SHA-1 of the payload, and
    the payload itself if asked for (null for revisits).

    A task reads its files one after the other, and of a file no more than one piece and one
    payload are in memory. A file that is cut off, framed wrongly or at odds with its digests
    fails the job with file and byte. An empty file has no records."""
    kinds = {"string": pa.string(), "long": pa.int64()}
    schema = pa.schema([(n, kinds[k]) for n, k in (f.split() for f in FIELDS.split(", "))] + ([("payload", pa.binary())] if payload else []))

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for batch in batches:
            for file in batch.column(0).to_pylist():
                fs, path = _filesystem(file)
                with fs.open_input_stream(path, compression=None) as stream:
                    try:
                        for record in read_stream(stream, payload):
                            rows.append({"file": file, **record})
                            size += len(record["payload"] or b"")
                            if len(rows) >= BATCH_RECORDS or size >= BATCH_BYTES:
                                yield pa.RecordBatch.from_pylist(rows, schema)
                                rows, size = [], 0
                    except ValueError as e:
                        raise ValueError(f"{file} {e}") from None
        yield pa.RecordBatch.from_pylist(rows, schema)

    spread = files.select("file").repartition(min(READ_TASKS, max(1, files.count())))
    return spread.mapInArrow(records, FIELDS + (", payload binary" if payload else ""))


def resolved(records: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to): for revisits the page_id of
    the response they name. A revisit whose response is absent or has another payload raises."""
    columns = [c for c in records.columns if c != "payload"]
    rows = materialise(records.select(*columns))
    named = rows.filter("refers_to_id is not null").select(F.col("refers_to_id").alias("id")).distinct()
    found = rows.filter("record_type = 'response'").join(named, F.col("record_id") == F.col("id"), "left_semi")
    found = found.groupBy("record_id").agg(F.max("page_id").alias("refers_to"), F.min("payload_digest").alias("digest"), F.min("payload_bytes").alias("bytes"))
    joined = rows.join(found.withColumnRenamed("record_id", "found"), F.col("refers_to_id") == F.col("found"), "left")
    odd = (F.col("record_type") == "revisit") & ~(F.col("digest").eqNullSafe(F.col("payload_digest")) & F.col("bytes").eqNullSafe(F.col("payload_bytes")))
    refers_to = F.when(odd, F.raise_error(F.concat(F.lit("no response for "), F.coalesce("record_id", F.lit("?")))).cast("long")).otherwise(F.col("refers_to"))
    return joined.select("page_id", "payload_bytes", "payload_digest", "record_type", refers_to.alias("refers_to"))


def round_trip(pages: DataFrame) -> DataFrame:
    """Pages (page_id, url, html) archived in the shared folder and read back. See ``with_types`` for
    nulls, ties and repeated rows; url null or with spaces and control characters (escaped) is
    fine; an empty table gives no rows; other columns are not read."""
    folder = f"{scratch_dir(pages.sparkSession)}/ledgerflow-warc-{uuid.uuid4().hex}"
    return resolved(read(write(with_types(pages), folder), payload=False))


SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
sized AS (SELECT *, octet_length(encode(html)) AS n FROM p),
kept AS (SELECT *, CASE WHEN n >= {LEAST_SHARED} THEN max(page_id) OVER (PARTITION BY html) END AS keeper FROM sized)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, sha1(html) AS payload_digest,
       CASE WHEN keeper IS NOT NULL AND page_id IS DISTINCT FROM keeper THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN keeper IS NOT NULL AND page_id IS DISTINCT FROM keeper THEN keeper END AS refers_to
FROM kept
"""
