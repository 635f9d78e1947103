"""WARC archives: one gzip member per record, written by Spark's text writer, and a salvage reader.

Writing. Spark writes raw bytes through its text sink (a binary cast to string keeps its bytes),
with its own committer, so tasks may be lost and repeated and any file system that Spark knows
will do. The sink ends each row with a line separator; a gzip member of less than 16 MiB ends with a
zero byte (the top byte of its length), so the separator is that byte and the row is the member
without it. A longer record is followed by an empty member, which ends so too.

Reading. Members are checked (gzip checksum, version line, lengths, block digest). After a failed
check the reader looks for the next place where a whole record stands, a gzip member or a plain
version line, goes on there and logs the bytes between as a gap.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

VERSION = b"WARC/1.1"
MAGIC = b"\x1f\x8b\x08"
CHUNK = 1 << 16
VERSION_LINE = re.compile(r"WARC/\d+\.\d+")
FIELD = re.compile(r"([!#$%&'*+.^_`|~0-9A-Za-z-]+):([^\x00-\x08\x0a-\x1f\x7f]*)")
ONCE = frozenset(["content-length", "warc-record-id", "warc-type", "warc-date", "warc-block-digest"])
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORDS_PER_FILE = 10_000
EMPTY_MEMBER = gzip.compress(b"", 1, mtime=0)


def digest(data: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _header(value: str) -> str:
    """A header value on one line: white space and controls percent-encoded."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", value)


def record(kind: str, record_id: str, date: str, block: bytes, uri: str | None = None,
           extra: tuple[tuple[str, str], ...] = (), content_type: str = "application/http; msgtype=response") -> bytes:
    """The bytes of one record."""
    fields = [("WARC-Type", kind), ("WARC-Record-ID", f"<{record_id}>"), ("WARC-Date", date)]
    if uri is not None:
        fields.append(("WARC-Target-URI", _header(uri)))
    fields += [*extra, ("WARC-Block-Digest", f"sha1:{digest(block)}"), ("Content-Type", content_type),
               ("Content-Length", str(len(block)))]
    head = "".join(f"{k}: {v}\r\n" for k, v in fields).encode("utf-8", "surrogatepass")
    return VERSION + b"\r\n" + head + b"\r\n" + block + b"\r\n\r\n"


def member(data: bytes, level: int = 3) -> bytes:
    """A gzip member, followed by an empty one if it wouldn't end with a zero byte."""
    out = gzip.compress(data, level, mtime=0)
    return out if out[-1:] == b"\0" else out + EMPTY_MEMBER


def page_records(date: str, level: int):
    """Rows (page_id, url, html, first) as rows (value) of gzip members without their last byte."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        info = member(record("warcinfo", "urn:archive", date, b"format: WARC File Format 1.1\r\n",
                             content_type="application/warc-fields"), level)
        for b in batches:
            out, held = ([info[:-1]], 0) if info else ([], 0)
            info = None
            for page, url, html, first in zip(*(b.column(k) for k in range(4))):
                page, url, first = page.as_py(), url.as_py(), first.as_py()
                payload = (html.as_py() or "").encode("utf-8", "surrogatepass")
                http = (f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
                        f"Content-Length: {len(payload)}\r\n\r\n").encode()
                mine = ("WARC-Payload-Digest", f"sha1:{digest(payload)}")
                name = "urn:page:" + ("" if page is None else str(page))
                if first is None or first == page:
                    data = record("response", name, date, http + payload, url, (mine,))
                else:
                    data = record("revisit", name, date, http, url, (
                        mine, ("WARC-Refers-To", f"<urn:page:{first}>"), ("WARC-Profile", PROFILE)))
                out.append(member(data, level)[:-1])
                held += len(out[-1])
                if held > 1 << 23:
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["value"])
                    out, held = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["value"])
    return run


def write_pages(pages: DataFrame, path: str, page_id: str = "page_id", url: str = "url", html: str = "html",
                least_bytes: int = 0, date: str = "2024-01-01T00:00:00Z", level: int = 3) -> None:
    """Archives of a table of pages under ``path``, one record per row.

    Of rows with equal payloads (the UTF-8 html; null: empty) of at least ``least_bytes`` those
    with the smallest id are responses and the others revisits of it; shorter ones are all
    responses. Repeated rows of the smallest id are all responses. Rows with a null id are
    revisits if a row with an id has their payload, else responses. A null url leaves its
    header out. An empty table gives archives without records. Other columns are ignored.
    """
    p = pages.select(F.col(page_id).alias("page"), F.col(url).alias("url"), F.col(html).alias("html"))
    p = p.withColumn("sha", F.unhex(F.sha1(F.coalesce("html", F.lit("")))))
    length = F.octet_length(F.coalesce("html", F.lit("")))
    shared = (p.select("page", "sha", length.alias("n")).groupBy("sha", "n")
              .agg(F.min("page").alias("first"), F.count("*").alias("rows"))
              .filter((F.col("rows") > 1) & (F.col("n") >= least_bytes)).select("sha", "first"))
    known = p.join(shared, "sha", "left").select("page", "url", "html", "first")
    (known.mapInArrow(page_records(date, level), "value binary")
     .select(F.col("value").cast("string").alias("value"))
     .write.option("lineSep", "\0").option("maxRecordsPerFile", RECORDS_PER_FILE).text(path))


class Broken(ValueError):
    """A record that fails a check; ``end`` is where it ends if that is known."""

    def __init__(self, reason: str, end: int | None = None):
        super().__init__(reason)
        self.end = end


def _parse(data, at: int, alone: bool) -> tuple[dict[str, str], bytes, int]:
    """(headers, block, end) of the record at ``at``; ``alone``: nothing may follow it."""
    stop = data.find(b"\r\n\r\n", at)
    if data[at:at + 5] != b"WARC/" or stop < 0:
        raise Broken("no version line or end of headers")
    try:
        lines = bytes(data[at:stop]).decode("utf-8", "surrogatepass").split("\r\n")
    except UnicodeDecodeError:
        raise Broken("headers aren't text") from None
    if not VERSION_LINE.fullmatch(lines[0]):
        raise Broken("version line")
    head: dict[str, str] = {}
    for line in lines[1:]:
        m = FIELD.fullmatch(line)
        if not m:
            raise Broken("header line")
        key = m[1].lower()
        if key in head and key in ONCE:
            raise Broken(f"two headers {key}")
        head[key] = m[2].strip()
    size = head.get("content-length", "")
    if not size.isdigit():
        raise Broken("no content length")
    begin = stop + 4
    end = begin + int(size)
    if bytes(data[end:end + 4]) != b"\r\n\r\n":
        raise Broken("length and end of the block disagree")
    block = bytes(data[begin:end])
    kind, _, want = head.get("warc-block-digest", "").partition(":")
    if kind.lower() == "sha1" and want.upper() != digest(block):
        raise Broken("block digest", None if alone else end + 4)
    if alone and len(data) != end + 4:
        raise Broken("bytes after the record")
    return head, block, end + 4


def _unzip(view: memoryview, at: int) -> tuple[bytes, int]:
    """(contents, end) of the gzip member at ``at``."""
    z, out, pos = zlib.decompressobj(31), [], at
    try:
        while not z.eof and pos < len(view):
            piece = view[pos:pos + CHUNK]
            out.append(z.decompress(piece))
            pos += len(piece)
    except zlib.error as e:
        raise Broken(f"gzip: {e}") from None
    if not z.eof:
        raise Broken("gzip: cut off")
    return b"".join(out), pos - len(z.unused_data)


def salvage(data: bytes) -> Iterator[tuple[int, int, dict[str, str] | None, bytes | None, str | None]]:
    """(offset, end, headers, block, None) of each whole record and (offset, end, None, None,
    reason) of each gap, in order; together they cover all bytes but for empty members."""
    view = memoryview(data)

    def whole(at: int):
        if data[at:at + 3] == MAGIC:
            inner, end = _unzip(view, at)
            if not inner:
                return None, None, end
            try:
                head, block, _ = _parse(inner, 0, True)
            except Broken as e:
                raise Broken(str(e), end) from None
            return head, block, end
        return _parse(data, at, False)

    at, start, why = 0, None, None  # start: of an open gap
    magic = version = -2

    while at < len(data):
        try:
            head, block, end = whole(at)
        except Broken as e:
            if start is None:
                start, why = at, str(e)
                if e.end is not None:  # the frame is sound, its contents aren't
                    yield start, e.end, None, None, why
                    at, start = e.end, None
                    continue
            # the next place where a record may begin
            if magic != -1 and magic <= at:
                magic = data.find(MAGIC, at + 1)
            if version != -1 and version <= at:
                version = data.find(b"WARC/", at + 1)
            places = [x for x in (magic, version) if x > at]
            at = min(places, default=len(data))
            continue
        if start is not None:
            yield start, at, None, None, why
            start = None
        if head is not None:
            yield at, end, head, block, None
        at = end
    if start is not None:
        yield start, len(data), None, None, why


FOUND = ("archive string, offset bigint, length bigint, gap string, record_id string, record_type string, uri string, "
         "refers_to string, payload_bytes bigint, payload_digest string, declared_digest string")


def _read(payloads: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, content in zip(b.column(0), b.column(1)):
                rows: list[tuple] = []
                held = 0
                for at, end, head, block, gap in salvage(content.as_py()):
                    if head is None:
                        rows.append((name.as_py(), at, end - at, gap) + (None,) * (8 if payloads else 7))
                    else:
                        payload, size = block, None
                        if "application/http" in head.get("content-type", ""):
                            http, _, payload = block.partition(b"\r\n\r\n")
                            said = re.search(rb"(?im)^content-length:\s*(\d+)", http)
                            size = int(said[1]) if said else None
                        declared = head.get("warc-payload-digest", "").removeprefix("sha1:") or None
                        kind = head.get("warc-type")
                        again = kind == "revisit"
                        row = (name.as_py(), at, end - at, None, head.get("warc-record-id", "").strip("<>"), kind,
                               head.get("warc-target-uri"), head.get("warc-refers-to", "").strip("<>") or None,
                               size if again else len(payload), declared if again else digest(payload), declared)
                        rows.append(row + (None if again else payload,) if payloads else row)
                        held += len(payload) if payloads else 0
                    if len(rows) >= 4096 or held > 1 << 23:
                        yield batch(rows)
                        rows, held = [], 0
                if rows:
                    yield batch(rows)

    kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.string(),
             pa.int64(), pa.string(), pa.string()] + [pa.binary()] * payloads
    names = [x.split()[0] for x in FOUND.split(", ")] + ["payload"] * payloads

    def batch(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)
    return run


def read_archives(spark: SparkSession, path: str, payloads: bool = False) -> DataFrame:
    """One row per record and per gap of all archives under ``path``, gzip members or plain.

    ``gap`` is null for a record and else says why the bytes from ``offset`` on, ``length`` of
    them, were set aside. payload_digest is worked out from the payload (a revisit: as declared);
    declared_digest is what the header says. An archive is held whole by its task, so archives
    should stay well below the executor's memory (2 GB is Spark's own limit); no file is empty of
    rows but one of no bytes.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(_read(payloads), FOUND + (", payload binary" if payloads else ""))


def gaps(found: DataFrame) -> DataFrame:
    """The quarantine log: (archive, offset, length, reason)."""
    return found.filter("gap is not null").select("archive", "offset", "length", F.col("gap").alias("reason"))


def page_of(urn: str) -> Column:
    """The page id of a record id that write_pages gave (null if it has none)."""
    return F.expr("try_cast(nullif(replace({0}, 'urn:page:', ''), '') as bigint)".format(urn))
