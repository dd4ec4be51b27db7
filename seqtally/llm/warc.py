"""WARC archives: a writer with revisit records and a reader that salvages damaged files.

The reader checks every record (member checksum, version line, lengths, digests). When a
check fails it searches for the next gzip member or version line that begins a valid record,
goes on there, and logs the bytes between as a quarantined gap.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path

DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MAGIC = b"\x1f\x8b\x08"
VERSION = re.compile(rb"WARC/1\.[01]\r\n")
#: Where a record can begin: a gzip member or a version line.
BEGIN = re.compile(rb"\x1f\x8b\x08|WARC/1\.[01]\r\n")
#: An archive is closed when it has grown to this size.
ROLL_BYTES = 64 << 20
READ_BYTES = 1 << 20
RECORD = (
    "file string, offset long, length long, type string, record_id string, uri string, refers_to string, "
    "payload_digest string, payload_bytes long, payload binary, gap_reason string"
)


def digest_column(payload: Column) -> Column:
    """Base32 SHA-1 of a binary column."""
    # 40 hex digits are 8 groups of 20 bits, and so 8 groups of 4 base32 digits
    def digits(hexed: Column) -> Column:
        groups = [F.lpad(F.conv(F.substring(hexed, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]
        return F.translate(F.concat(*groups), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")

    # the digest is a variable of the lambda, so it is taken once however many digits read it
    return F.get(F.transform(F.array(F.sha1(payload)), digits), F.lit(0))


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def place_of(path: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a URI; plain paths and `file:` are the local file system."""
    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(path)


# --- writing ---------------------------------------------------------------------------------


def record_bytes(kind: str, record_id: str, uri: str, block: bytes, extra: list[tuple[str, str]]) -> bytes:
    clean = lambda v: re.sub(r"[\r\n]+", " ", v)  # noqa: E731  a header holds one line
    head = [("WARC-Type", kind), ("WARC-Record-ID", record_id), ("WARC-Date", DATE), ("WARC-Target-URI", clean(uri)), *extra]
    head += [("WARC-Block-Digest", "sha1:" + sha1_base32(block)), ("Content-Length", str(len(block)))]
    lines = "".join(f"{k}: {v}\r\n" for k, v in head if v)
    return b"WARC/1.1\r\n" + lines.encode() + b"\r\n" + block + b"\r\n\r\n"


def member(data: bytes, level: int = 1) -> bytes:
    """One gzip member."""
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def page_record(page: str, url: str, payload: bytes, digest: str, refers_to: str | None) -> bytes:
    """A response, or a revisit of `refers_to` whose block is the HTTP head alone."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    extra = [("Content-Type", "application/http; msgtype=response"), ("WARC-Payload-Digest", "sha1:" + digest)]
    if refers_to is None:
        return record_bytes("response", f"<urn:page:{page}>", url, head + payload, extra)
    extra += [("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<urn:page:{refers_to}>")]
    return record_bytes("revisit", f"<urn:page:{page}>", url, head, extra)


def with_revisits(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """page_id, url, payload, digest and refers_to (page_id of the response, null for responses).

    Only digests that occur more than once are joined, so a payload of many pages costs one
    row there however many they are.
    """
    payload = F.encode(F.coalesce(F.col("html"), F.lit("")), "UTF-8")
    rows = pages.select("page_id", F.coalesce("url", F.lit("")).alias("url"), payload.alias("payload"))
    rows = rows.withColumn("digest", digest_column(F.col("payload")))
    long = F.length("payload") >= min_bytes
    twice = rows.where(long).groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.max("page_id").alias("first"))
    joined = rows.join(twice.where("n > 1").select("digest", "first"), "digest", "left")
    other = long & F.col("first").isNotNull() & ~F.col("first").eqNullSafe(F.col("page_id"))
    return joined.select("page_id", "url", "payload", "digest", F.when(other, F.col("first")).alias("refers_to"))


def write_archives(pages: DataFrame, folder: str, min_bytes: int = 0, roll_bytes: int = ROLL_BYTES) -> DataFrame:
    """Write one record per page below `folder`; returns (file, n_records, bytes), one row per archive.

    A task writes files of names of its own and reports them when they are closed, so files of
    a task that was lost or ran twice are not in the list and are not read.
    """

    def write(batches):
        target, base = place_of(folder)
        target.create_dir(base, recursive=True)
        out, name, n, size, done = None, "", 0, 0, []

        def close():
            if out is not None:
                out.close()
                done.append((f"{folder}/{name}", n, size))

        for batch in batches:
            cols = [batch.column(i).to_pylist() for i in range(5)]
            for page, url, payload, digest, ref in zip(*cols):
                if out is None or size >= roll_bytes:
                    close()
                    name, n = f"pages-{uuid.uuid4().hex}.warc.gz", 0
                    out = target.open_output_stream(f"{base}/{name}", compression=None)
                    info = record_bytes("warcinfo", f"<urn:uuid:{uuid.uuid4()}>", "", b"format: WARC File Format 1.1\r\n", [("Content-Type", "application/warc-fields")])
                    size = out.write(member(info)) or len(member(info))
                data = member(page_record("null" if page is None else str(page), url, payload, digest, None if ref is None else str(ref)))
                out.write(data)
                n, size = n + 1, size + len(data)
        close()
        yield pa.RecordBatch.from_arrays(
            [pa.array([d[0] for d in done], pa.string()), pa.array([d[1] for d in done], pa.int64()), pa.array([d[2] for d in done], pa.int64())],
            ["file", "n_records", "bytes"],
        )

    return with_revisits(pages, min_bytes).mapInArrow(write, "file string, n_records long, bytes long")


# --- reading ---------------------------------------------------------------------------------


class Window:
    """A stream seen through a buffer that can be asked for bytes at any later offset."""

    def __init__(self, stream):
        self.stream, self.start, self.buffer, self.over = stream, 0, bytearray(), False

    def drop(self, offset: int) -> None:
        """Forget what lies before `offset`."""
        del self.buffer[: max(0, offset - self.start)]
        self.start = max(self.start, offset)

    def has(self, end: int) -> bool:
        while not self.over and self.start + len(self.buffer) < end:
            got = self.stream.read(READ_BYTES)
            self.over = not got
            self.buffer += got
        return self.start + len(self.buffer) >= end

    def read(self, offset: int, n: int) -> bytes:
        self.has(offset + n)
        return bytes(self.buffer[offset - self.start : offset - self.start + n])

    def find(self, pattern: re.Pattern, offset: int) -> int:
        """Offset of the next match at or after `offset`, or the end; forgets what was searched."""
        while True:
            self.has(offset + READ_BYTES)
            if m := pattern.search(self.buffer, offset - self.start):
                return self.start + m.start()
            end = self.start + len(self.buffer)
            if self.over:
                return end
            offset = max(offset, end - 16)
            self.drop(offset)


@dataclass
class Record:
    offset: int
    length: int
    headers: dict[str, str] = field(default_factory=dict)
    block: bytes = b""
    reason: str = ""  # a quarantined gap if set


class Damaged(Exception):
    pass


def parse_record(data: bytes) -> tuple[dict[str, str], bytes, int]:
    """Headers, block and length of the record at the beginning of `data`, checked."""
    if not VERSION.match(data):
        raise Damaged("no version line")
    end = data.find(b"\r\n\r\n")
    if end < 0:
        raise Damaged("headers do not end")
    headers = {}
    for line in data[:end].split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            raise Damaged("header without a colon")
        headers[name.strip().lower().decode("utf-8", "replace")] = value.strip().decode("utf-8", "replace")
    length = headers.get("content-length", "")
    if not length.isdigit():
        raise Damaged("no content length")
    stop = end + 4 + int(length)
    if len(data) < stop + 4 or data[stop : stop + 4] != b"\r\n\r\n":
        raise Damaged("block does not end where its length says")
    block = data[end + 4 : stop]
    if (want := headers.get("warc-block-digest", "")).startswith("sha1:") and want[5:] != sha1_base32(block):
        raise Damaged("block digest differs")
    if headers.get("warc-type") == "response" and (want := headers.get("warc-payload-digest", "")).startswith("sha1:"):
        if want[5:] != sha1_base32(payload_of(block)):
            raise Damaged("payload digest differs")
    return headers, block, stop + 4


def payload_of(block: bytes) -> bytes:
    return block[block.find(b"\r\n\r\n") + 4 :] if block.startswith(b"HTTP/") else block


def _member_at(w: Window, at: int) -> tuple[bytes, int]:
    """Content and compressed length of the gzip member at `at`."""
    if w.read(at, 3) != MAGIC:
        raise Damaged("no gzip member")
    z, out, pos = zlib.decompressobj(31), [], at
    try:
        while not z.eof:
            chunk = w.read(pos, READ_BYTES)
            if not chunk:
                raise Damaged("member is cut short")
            out.append(z.decompress(chunk))
            pos += len(chunk)
            if len(out) == 1 and len(out[0]) >= 5 and not out[0].startswith(b"WARC/"):
                raise Damaged("no version line")
    except zlib.error as e:
        raise Damaged(f"member fails: {e}") from None
    return b"".join(out), pos - len(z.unused_data) - at


def _plain_at(w: Window, at: int) -> tuple[bytes, int]:
    """The plain record at `at` as far as its own length claims."""
    size = 4096
    while (end := (head := w.read(at, size)).find(b"\r\n\r\n")) < 0 and len(head) == size and size < 1 << 20:
        size *= 2
    m = re.search(rb"(?i)\r\ncontent-length:[ \t]*(\d{1,12})[ \t]*\r\n", head[: end + 2] if end >= 0 else b"")
    if not VERSION.match(head) or not m:
        raise Damaged("no version line" if not VERSION.match(head) else "no content length")
    total = end + 4 + int(m[1]) + 4
    if not w.has(at + total):
        raise Damaged("record is cut short")
    return w.read(at, total), total


def salvage(stream) -> Iterator[Record]:
    """Records of an archive (gzip members or plain) and the gaps between them, in file order."""
    w = Window(stream)
    at = bad = 0
    reason = ""
    while w.has(at + 1):
        try:
            data, length = (_member_at if w.read(at, 3) == MAGIC else _plain_at)(w, at)
            headers, block, used = parse_record(data)
        except Damaged as e:
            reason = reason or str(e)
            at = w.find(BEGIN, at + 1)
            w.drop(at)
            continue
        if at > bad:
            yield Record(bad, at - bad, reason=reason or "bytes outside records")
        yield Record(at, length, headers, block)
        yield from _more(data, used, at)
        at = bad = at + length
        reason = ""
        w.drop(at)
    if at > bad:
        yield Record(bad, at - bad, reason=reason or "bytes outside records")


def _more(data: bytes, used: int, at: int) -> Iterator[Record]:
    """Records behind the first one of a member, and what damage lies between them.

    They share the member's offset; its length counts with the first record.
    """
    bad, reason = used, ""
    while used < len(data):
        try:
            headers, block, n = parse_record(data[used:])
        except Damaged as e:
            reason = reason or str(e)
            found = VERSION.search(data, used + 1)
            used = found.start() if found else len(data)
            continue
        if used > bad:
            yield Record(at, 0, reason=f"{used - bad} bytes inside a member: {reason}")
        yield Record(at, 0, headers, block)
        used = bad = used + n
        reason = ""
    if used > bad:
        yield Record(at, 0, reason=f"{used - bad} bytes inside a member: {reason}")


def read_archives(files: DataFrame, keep_payload: bool = True) -> DataFrame:
    """Records and quarantined gaps of the archives named in the column `file`.

    One row per record (offset, length, type, record_id, uri, refers_to, payload_digest,
    payload_bytes, payload) or gap (gap_reason set, the rest null). A file is one task's work
    and is streamed, one record in memory at a time. A revisit has the digest and length of
    the payload it stands for. An empty file has no rows; a file that is all damage is one gap.
    Records of a member that holds several share its offset, and its length counts with the
    first. A column `n_records` says how many responses and revisits the writer put into a
    file; where it is there, a file that gives another number is an error.
    """
    spark = files.sparkSession
    told = "n_records" in files.columns
    named = files.select("file", F.col("n_records") if told else F.lit(None).cast("long").alias("n_records"))

    def read(batches):
        for batch in batches:
            for path, wanted in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                place, inner = place_of(path)
                rows, held, pages = [], 0, 0
                with place.open_input_stream(inner, compression=None) as stream:
                    for r in salvage(stream):
                        rows.append(_row(path, r, keep_payload))
                        held += len(r.block)
                        pages += r.headers.get("warc-type") in ("response", "revisit")
                        if held > READ_BYTES * 8 or len(rows) >= 5000:
                            yield _batch(rows)
                            rows, held = [], 0
                yield _batch(rows)
                if wanted is not None and pages != wanted:
                    raise RuntimeError(f"{path} holds {pages} of the {wanted} records written to it")

    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return named.repartition(n, "file").mapInArrow(read, RECORD)


def _row(path: str, r: Record, keep: bool) -> tuple:
    if r.reason:
        return (path, r.offset, r.length, None, None, None, None, None, None, None, r.reason)
    h = r.headers
    digest = h.get("warc-payload-digest", "").removeprefix("sha1:") or None
    payload = payload_of(r.block)
    size = len(payload)
    if h.get("warc-type") == "revisit":
        m = re.search(rb"(?i)\r\ncontent-length: *(\d+)", r.block)
        size = int(m[1]) if m else None
    kind = h.get("warc-type")
    body = payload if keep and kind == "response" else None
    return (path, r.offset, r.length, kind, h.get("warc-record-id"), h.get("warc-target-uri"), h.get("warc-refers-to"), digest, size, body, None)


_TYPES = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.binary(), pa.string()]
_NAMES = [c.split()[0] for c in RECORD.split(", ")]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(_TYPES)], _NAMES)


def archived_pages(spark: SparkSession, pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Write `pages` (page_id, url, html) as archives and read them back.

    Returns page_id, payload_bytes, payload_digest, record_type and refers_to per page. A null
    html is an empty payload, and empty payloads are equal payloads too. Of equal payloads the
    largest page_id is the response; rows that repeat it are responses as well. A null page_id
    reads back as null. An empty table gives no archive and no rows.
    """
    folder = folder or scratch_path(spark, "warc")
    listed = write_archives(pages.select("page_id", "url", "html"), folder).select("file", "n_records")
    path = scratch_path(spark, "warc-list")
    listed.write.parquet(path)
    records = read_archives(spark.read.schema("file string, n_records long").parquet(path), keep_payload=False)
    number = lambda c: F.regexp_extract(c, "urn:page:(-?\\d+)", 1)
    as_id = lambda c: F.when(number(c) != "", number(c)).cast(pages.schema["page_id"].dataType)
    return records.where("type in ('response', 'revisit')").select(
        as_id(F.col("record_id")).alias("page_id"),
        "payload_bytes",
        "payload_digest",
        F.col("type").alias("record_type"),
        as_id(F.col("refers_to")).alias("refers_to"),
    )
