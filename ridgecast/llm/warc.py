"""WARC (10): a converter from the older ARC format, in both its header versions, to WARC/1.1.

Archives are bytes from end to end: files below the shared folder, one archive a file, written gzipped by Spark's text
writer from strings that are never decoded, and read as binary files, gzipped or plain. A record's length is the one its
header declares; nothing is searched for in payloads.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridgecast.llm import tables
from ridgecast.llm.text import chunks
from ridgecast.session import cut_lineage, stored_folder

#: Bytes of records after which an archive is closed.
ARCHIVE = 4 * 1024 * 1024
#: The fields of a header line, by version.
FIELDS = {
    "1": ("URL", "IP-address", "Archive-date", "Content-type", "Archive-length"),
    "2": ("URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length"),
}
DATE = "20260101000000"
NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")

GZIP = b"\x1f\x8b"

_blank = re.compile(r"[\s%]")
_wild = re.compile("[\udc80-\udcff]")
_head = re.compile(rb"\r?\n\r?\n")
_date = re.compile(r"\d{8,17}")


def digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _safe(url: str | None) -> str:
    """A URL that fits in a header line: white space and percent signs are percent-encoded."""
    return _blank.sub(lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), url or "") or "-"


def response(payload: bytes, page_id: int | None, mime: str = "text/html; charset=utf-8") -> bytes:
    mark = "" if page_id is None else f"X-Page-Id: {page_id}\r\n"
    return f"HTTP/1.1 200 OK\r\nContent-Type: {mime}\r\n{mark}Content-Length: {len(payload)}\r\n\r\n".encode() + payload


def http_parts(block: bytes) -> tuple[dict[str, str], bytes, bytes]:
    """Header fields by lower-case name, header bytes, payload of an HTTP response; lines may end without CR.

    A block that is no HTTP response has no header and is all payload; one without a blank line is all header.
    """
    if not block.startswith(b"HTTP/"):
        return {}, b"", block
    blank = _head.search(block)
    end = blank.end() if blank else len(block)
    lines = block[:end].decode("latin-1").split("\n")[1:]
    return {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines) if k}, block[:end], block[end:]


def arc_header(version: str, name: str) -> bytes:
    about = f"{version} 0 ridgecast\n{' '.join(FIELDS[version])}\n"
    values = [f"filedesc://{name}", "0.0.0.0", DATE, "text/plain"]
    if version == "2":
        values += ["200", "-", "-", "0", name]
    return f"{' '.join(values)} {len(about)}\n{about}\n".encode()


def arc_record(version: str, name: str, offset: int, url: str, block: bytes) -> bytes:
    values = [url, "0.0.0.0", DATE, "text/html"]
    if version == "2":
        values += ["200", digest(block), "-", str(offset), name]
    return f"{' '.join(values)} {len(block)}\n".encode() + block + b"\n"


def _line(raw: bytes) -> str:
    """A header line; bytes that are not UTF-8 are percent-encoded."""
    return _wild.sub(lambda m: f"%{ord(m[0]) - 0xDC00:02X}", raw.decode("utf-8", "surrogateescape")).rstrip("\r")


def _values(line: str, n: int) -> list[str]:
    """The ``n`` values of a header line, whose date tells where a URL or a content type with spaces ends."""
    parts = line.split(" ")
    when = next((k for k in range(2, len(parts)) if _date.fullmatch(parts[k])), None)
    if when is None:
        raise ValueError(f"no date in the ARC header {line!r}")
    return [" ".join(parts[: when - 1]), parts[when - 1], parts[when], *" ".join(parts[when + 1 :]).rsplit(" ", n - 4)]


def read_arc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields, block) of each record behind the version block, whose lines say what fields a header has."""
    end = data.index(b"\n")
    about = data[end + 1 : end + 1 + int(data[:end].rsplit(b" ", 1)[1])]
    version, _, names = about.partition(b"\n")
    fields = _line(names.split(b"\n")[0]).split() or list(FIELDS[version.split()[0].decode()])
    at = end + 1 + len(about)
    while at < len(data):
        if data[at : at + 1] in (b"\n", b"\r"):
            at += 1
            continue
        end = data.index(b"\n", at)
        header = dict(zip(fields, _values(_line(data[at:end]), len(fields)), strict=True))
        length = int(header["Archive-length"])
        yield header, data[end + 1 : end + 1 + length]
        at = end + 1 + length


def warc_record(fields: list[tuple[str, str]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in fields)
    return f"WARC/1.1\r\n{head}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"


def read_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    at = 0
    while (at := data.find(b"WARC/", at)) >= 0:
        end = data.index(b"\r\n\r\n", at) + 4
        header = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in data[at:end].decode("utf-8").split("\r\n")[1:]) if k}
        length = int(header["content-length"])
        yield header, data[end : end + length]
        at = end + length + 4


def _stored(archives: DataFrame, end: str) -> DataFrame:
    """Writes each row (one archive, binary, without its last ``end``) as a file of its own; gives the files' (path, content)."""
    spark = archives.sparkSession
    folder = stored_folder(spark)
    # the cast keeps the bytes as they are, and the writer puts them out as they are, followed by the line separator
    raw = archives.select(F.col("value").cast("string").alias("value"))
    raw.write.option("maxRecordsPerFile", 1).option("compression", "gzip").option("lineSep", end).text(folder)
    return spark.read.format("binaryFile").load(folder).select("path", "content")


def _binaries(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, bytes]]:
    for batch in batches:
        for k in range(batch.num_rows):
            content = batch.column(1)[k].as_py()
            if content.startswith(GZIP):
                content = gzip.decompress(content)
            if content:  # a first partition without rows is stored as an empty file
                yield batch.column(0)[k].as_py(), content


def arc_archives(pages: DataFrame) -> DataFrame:
    """Pages (page_id, url, html) as ARC files, of version 1 and 2 in turn. A null html is an empty payload."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[bytes] = []
        size = number = 0
        version = name = ""

        def archive() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([b"".join(held)[:-1]], pa.binary())], names=["value"])

        for piece, texts in chunks(batches, text="html"):
            for page_id, url, html in zip(piece.column(0).to_pylist(), piece.column(1).to_pylist(), texts, strict=True):
                if not held:
                    number += 1
                    version, name = str(2 - number % 2), f"pages-{number:06d}.arc"
                    held, size = [arc_header(version, name)], 0
                record = arc_record(version, name, size, _safe(url), response((html or "").encode("utf-8"), page_id))
                held.append(record)
                size += len(record)
                if size >= ARCHIVE:
                    yield archive()
                    held = []
        if held:
            yield archive()

    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), "html")
    return _stored(rows.mapInArrow(work, "value binary"), "\n")


RECORD = ("record_id string, page_id bigint, uri string, date string, ip string, kind string, content_type string, "
          "payload_bytes bigint, payload_digest string, block binary")
RECORD_TYPES = (pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary())
RECORD_NAMES = [x.split()[0] for x in RECORD.split(", ")]


def converted(archives: DataFrame) -> DataFrame:
    """ARC files (path, content), gzipped or plain, as rows of what a WARC record needs.

    The record id is named by file, place, date and digest, so a task that runs again gives the same one; the
    14-digit date becomes an ISO time; digests are bare base32 SHA-1 of the payload. A block that is an HTTP response
    makes a response, any other (DNS, FTP, headerless pages) a resource with the content type of its ARC header. The
    IP address is kept, unless it is the 0.0.0.0 that stands for none.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def table(rows: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*rows)) or [()] * len(RECORD_TYPES)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, RECORD_TYPES, strict=True)], names=RECORD_NAMES)

        for path, content in _binaries(batches):
            rows, size = [], 0
            for k, (header, block) in enumerate(read_arc(content)):
                fields, head, payload = http_parts(block)
                page = fields.get("x-page-id", "")
                d = header["Archive-date"]
                d += "00000101000000"[len(d) :]
                sha = digest(payload)
                name = f"{path}#{k} {header['URL']} {d} {sha}"
                ip, mime = header["IP-address"], header["Content-type"]
                rows.append((f"urn:uuid:{uuid.uuid5(NAMESPACE, name)}", int(page) if page.isdecimal() else None, header["URL"].replace(" ", "%20"),
                             f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z", None if ip in ("", "-", "0.0.0.0") else ip,
                             "response" if head else "resource", mime if "/" in mime else None, len(payload), sha, block))
                size += len(block)
                if size >= ARCHIVE:
                    yield table(rows)
                    rows, size = [], 0
            yield table(rows)

    return archives.mapInArrow(work, RECORD)


def deduplicated(records: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Adds ``refers_to`` (page) and ``refers_record`` of records that revisit an equal payload of ``min_bytes`` or more.

    Of equal payloads that of the smallest page_id is the response; rows that repeat its page_id are responses
    too. Decided on narrow rows, so blocks are shuffled by record, never by payload.
    """
    narrow = records.filter(F.col("payload_bytes") >= min_bytes).select("record_id", "page_id", "payload_digest")
    order = F.struct(F.col("page_id").isNull(), "page_id", "record_id")
    first = narrow.groupBy("payload_digest").agg(F.min(order).alias("f"))
    later = narrow.join(first, "payload_digest").filter("record_id != f.record_id and not (page_id <=> f.page_id and page_id is not null)")
    later = later.select("record_id", F.col("f.page_id").alias("refers_to"), F.col("f.record_id").alias("refers_record"))
    return records.join(tables.maybe_broadcast(cut_lineage(later), 160), "record_id", "left")


def warc_archives(records: DataFrame) -> DataFrame:
    """Records of ``deduplicated`` as WARC files, each behind a warcinfo record. Revisits keep the HTTP header only.

    The length of a revisit's payload is told in a field of its own, as old HTTP headers often lack it.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[bytes] = []
        size = 0

        def archive() -> pa.RecordBatch:
            info = [("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(NAMESPACE, held[0].hex())}>"),
                    ("WARC-Date", f"{DATE[:4]}-01-01T00:00:00Z"), ("Content-Type", "application/warc-fields")]
            whole = warc_record(info, b"format: WARC File Format 1.1\r\n") + b"".join(held)
            return pa.RecordBatch.from_arrays([pa.array([whole[:-4]], pa.binary())], names=["value"])

        for batch in batches:
            for name, uri, date, ip, kind, mime, length, sha, refers, target, block in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                fields = [("WARC-Type", kind if target is None else "revisit"), ("WARC-Record-ID", f"<{name}>"), ("WARC-Date", date), ("WARC-Target-URI", uri),
                          ("WARC-Payload-Digest", f"sha1:{sha}")]
                mime = "application/http; msgtype=response" if kind == "response" else mime
                fields += [] if mime is None else [("Content-Type", mime)]
                fields += [] if ip is None else [("WARC-IP-Address", ip)]
                if target is not None:
                    block = http_parts(block)[1]
                    fields += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", f"<{target}>")]
                    fields += [("X-Payload-Length", str(length))]
                    fields += [] if refers is None else [("X-Refers-To-Page", str(refers))]
                fields.append(("WARC-Block-Digest", f"sha1:{digest(block)}"))
                held.append(warc_record(fields, block))
                size += len(held[-1])
                if size >= ARCHIVE:
                    yield archive()
                    held, size = [], 0
        if held:
            yield archive()

    columns = ("record_id", "uri", "date", "ip", "kind", "content_type", "payload_bytes", "payload_digest", "refers_to", "refers_record", "block")
    return _stored(records.select(*columns).mapInArrow(work, "value binary"), "\r\n\r\n")


def read_pages(archives: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of each record of WARC files.

    Of a response or resource the payload is measured; of a revisit, which has none, its headers tell.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, content in _binaries(batches):
            rows = []
            for header, block in read_warc(content):
                kind = header["warc-type"]
                if kind == "warcinfo":
                    continue
                if digest(block) != header["warc-block-digest"].removeprefix("sha1:"):
                    raise ValueError(f"damaged record {header['warc-record-id']}")
                fields, _, payload = http_parts(block)
                page = fields.get("x-page-id", "")
                page = int(page) if page.isdecimal() else None
                if kind != "revisit":
                    rows.append((page, len(payload), digest(payload), kind, None))
                else:
                    refers = header.get("x-refers-to-page")
                    length = header.get("x-payload-length", fields.get("content-length"))
                    rows.append((page, length and int(length), header["warc-payload-digest"].removeprefix("sha1:"), kind, refers and int(refers)))
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
            columns = list(zip(*rows)) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)],
                                             names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    return archives.mapInArrow(work, "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint")


def convert(archives: DataFrame, min_bytes: int = 0) -> DataFrame:
    """ARC files to WARC files (path, content)."""
    return warc_archives(deduplicated(cut_lineage(converted(archives)), min_bytes))
