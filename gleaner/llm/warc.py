"""Operator 10: convert legacy ARC archives to WARC, with revisit records for repeated payloads.

An ARC file opens with a `filedesc:` record whose block names the version and the fields of all header lines; each
record is a header line, whose last field declares the length, and that many bytes. The converter reads the fields by
those names and makes up what WARC asks for: record identifiers, timestamps, types and digests.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, remove, scratch_path, table

#: The header lines that the two versions of the format define.
FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
#: An archive is closed once it holds this many bytes; a single larger record is an archive of its own.
ARCHIVE_BYTES = 8 << 20
#: Digests that occur more than once are broadcast up to this size, and joined by shuffle beyond it.
BROADCAST_BYTES = 64 << 20
CRLF = "\r\n"


def sha1_32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


@dataclass
class Capture:
    """One record of an ARC file."""

    version: int
    url: str
    ip: str
    date: str
    mime: str
    block: bytes


def arc_head(name: str, version: int, date: str) -> str:
    block = f"{version} 0 gleaner\n{FIELDS[version]}\n"
    return f"filedesc://{name} 0.0.0.0 {date} text/plain {len(block)}\n{block}"


def arc_line(version: int, url: str, date: str, offset: int, name: str, block: bytes) -> str:
    values = {
        "URL": re.sub(r"\s", lambda m: f"%{ord(m[0]):02X}", url) or "-",
        "IP-address": "0.0.0.0",
        "Archive-date": date,
        "Content-type": "text/html",
        "Result-code": "200",
        "Checksum": "-",
        "Location": "-",
        "Offset": str(offset),
        "Filename": name,
        "Archive-length": str(len(block)),
    }
    return " ".join(values[f] for f in FIELDS[version].split())


def file_row(members: list[bytes], level: int = 4) -> pa.RecordBatch:
    """One file as a row: each part a gzip member of its own, so that a reader can seek to it."""
    packed = []
    for m in members:
        z = zlib.compressobj(level, zlib.DEFLATED, 31)
        packed.append(z.compress(m) + z.flush())
    return pa.RecordBatch.from_arrays([pa.array([b"".join(packed)], pa.binary())], ["value"])


def write_files(files: DataFrame, path: str) -> None:
    """Write every row as a file of its bytes. The text writer ends each with a zero byte, which gzip readers take as padding."""
    out = files.select(F.col("value").cast("string")).write.option("maxRecordsPerFile", 1).option("compression", "none")
    out.option("lineSep", "\u0000").text(path)


def write_arcs(pages: DataFrame, path: str, date: str = "20240102030405", archive_bytes: int = ARCHIVE_BYTES) -> None:
    """Write pages (page_id, url, html: text or bytes) as gzipped ARC archives, versions 1 and 2 in turn."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, parts, size = TaskContext.get().partitionId(), 0, [], 0

        def archive() -> pa.RecordBatch:
            return file_row([b"".join(parts)])

        for batch in batches:
            for page, url, html in zip(*[batch.column(k) for k in range(3)], strict=True):
                version, name = 1 + (part + number) % 2, f"gleaner-{part}-{number}.arc"
                payload = html.as_py() or b""
                key = "" if page.as_py() is None else page.as_py()
                top = f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}X-Page-Id: {key}{CRLF}Content-Length: {len(payload)}{CRLF}{CRLF}"
                block = top.encode() + payload
                if not parts:
                    parts.append(arc_head(name, version, date).encode())
                parts.append(f"{arc_line(version, url.as_py() or '-', date, size, name, block)}\n".encode() + block + b"\n")
                size += len(block)
                if size >= archive_bytes:
                    yield archive()
                    number, parts, size = number + 1, [], 0
        if parts:
            yield archive()

    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("binary"))
    write_files(rows.mapInArrow(run, "value binary"), path)


def inflate(data: bytes, step: int = 1 << 14) -> bytes:
    """The bytes of a file that may be gzipped, in one or several members; zeros behind the last are padding."""
    if data[:2] != b"\x1f\x8b":
        return data
    out, at = [], 0
    while data[at : at + 2] == b"\x1f\x8b":
        z = zlib.decompressobj(31)
        while not z.eof and at < len(data):
            out.append(z.decompress(data[at : at + step]))
            at += step
        at = min(at, len(data)) - len(z.unused_data)
    return b"".join(out)


def read_arc(data: bytes) -> Iterator[Capture]:
    """The records of an ARC file, by its own field definition and the declared lengths; a malformed one is an error."""
    at, version, names = 0, 0, []
    while at < len(data):
        if data[at : at + 1] in (b"\n", b"\r"):
            at += 1
            continue
        end = data.find(b"\n", at)
        line = data[at : end if end >= 0 else len(data)].decode("utf-8", "replace").rstrip("\r")
        if line.startswith("filedesc:"):
            length = int(line.rsplit(" ", 1)[1])
            head, _, rest = data[end + 1 : end + 1 + length].partition(b"\n")
            version, names = int(head.split(b" ")[0]), rest.split(b"\n")[0].decode().split()
            if version not in FIELDS or names[-1:] != ["Archive-length"]:
                raise ValueError(f"unknown ARC version block {head!r}")
            at = end + 1 + length
            continue
        values = line.split(" ")
        if len(values) != len(names) or not values[-1].isdigit() or end < 0:
            raise ValueError(f"malformed ARC header {line[:200]!r}")
        f = dict(zip(names, values, strict=True))
        length = int(f["Archive-length"])
        block = data[end + 1 : end + 1 + length]
        if len(block) != length:
            raise ValueError(f"ARC record of {length} bytes ends after {len(block)}")
        yield Capture(version, f["URL"], f["IP-address"], f["Archive-date"], f["Content-type"], block)
        at = end + 1 + length


def split_http(block: bytes) -> tuple[bytes, bytes]:
    """The header part, blank line included, and the payload of an HTTP response; no header: all is payload."""
    if not block.startswith(b"HTTP/"):
        return b"", block
    top, line, payload = block.partition(b"\r\n\r\n")
    return top + line, payload


def captures(spark: SparkSession, path: str) -> DataFrame:
    """All ARC records: place, url, ip, date, mime, key, top (HTTP header), payload_bytes, digest, payload.

    Of the records of one archive with equal payloads only that with the largest key carries the payload, so that hot
    payloads move once for each archive and not once for each record.
    """
    names = ["file", "at", "url", "ip", "date", "mime", "key", "top", "payload_bytes", "digest", "payload"]
    types = [pa.string(), pa.int64(), *[pa.string()] * 4, pa.int64(), pa.binary(), pa.int64(), pa.string(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0), batch.column(1), strict=True):
                data = inflate(content.as_py())
                rows, best = [], {}
                for at, c in enumerate(read_arc(data)):
                    top, payload = split_http(c.block)
                    found = re.search(rb"(?im)^X-Page-Id: *(-?\d+)", top)
                    key, digest = int(found[1]) if found else None, sha1_32(payload)
                    rank = (key is not None, key or 0, at)
                    if digest not in best or rank > best[digest][0]:
                        best[digest] = (rank, at)
                    rows.append((name.as_py(), at, c.url, c.ip, c.date, c.mime, key, top, len(payload), digest, payload))
                keep = {at for _, at in best.values()}
                for k in range(0, len(rows), 256):
                    cut = [(*r[:10], r[10] if r[1] in keep else None) for r in rows[k : k + 256]]
                    yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*cut, strict=True), types, strict=True)], names)

    schema = "file string, at long, url string, ip string, date string, mime string, key long, top binary, payload_bytes long, digest string, payload binary"
    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, schema)


def warc_date(date: str) -> str:
    """An ARC date of 4 to 14 digits as a WARC date."""
    full = (date + "00000101000000"[len(date) :])[:14]
    return f"{full[:4]}-{full[4:6]}-{full[6:8]}T{full[8:10]}:{full[10:12]}:{full[12:14]}Z"


def record_id(*parts: object) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, '|'.join(map(str, parts)))}>"


def warc_record(r: dict) -> bytes:
    """The WARC record of a joined capture, with the two line ends that close it."""
    revisit = r["winner"] is not None and (r["winner"]["file"], r["winner"]["at"]) != (r["file"], r["at"])
    http = bool(r["top"])
    block = r["top"] if revisit else r["top"] + (r["payload"] or b"")
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response' if http else 'resource'}",
        f"WARC-Record-ID: {record_id(r['file'], r['at'], r['url'], r['date'])}",
        f"WARC-Date: {warc_date(r['date'])}",
        f"WARC-Target-URI: {r['url']}",
        f"WARC-IP-Address: {r['ip']}",
        f"WARC-Payload-Digest: sha1:{r['digest']}",
        f"WARC-Block-Digest: sha1:{sha1_32(block)}",
        f"X-Payload-Length: {r['payload_bytes']}",
        *([f"X-Record-Key: {r['key']}"] if r["key"] is not None else []),
    ]
    if revisit:
        w = r["winner"]
        head += [
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            f"WARC-Refers-To: {record_id(w['file'], w['at'], w['url'], w['date'])}",
            f"WARC-Refers-To-Target-URI: {w['url']}",
            f"WARC-Refers-To-Date: {warc_date(w['date'])}",
            *([f"X-Refers-To-Key: {w['key']}"] if w["key"] is not None else []),
        ]
    head += [f"Content-Type: {'application/http; msgtype=response' if http else r['mime']}", f"Content-Length: {len(block)}", "", ""]
    return CRLF.join(head).encode() + block + b"\r\n\r\n"


def warcinfo(*parts: object) -> bytes:
    """The record that opens an archive; the parts make its identifier."""
    info = f"format: WARC File Format 1.1{CRLF}software: gleaner{CRLF}"
    top = ["WARC/1.1", "WARC-Type: warcinfo", f"WARC-Record-ID: {record_id('warcinfo', *parts)}", "WARC-Date: 2024-01-01T00:00:00Z"]
    return CRLF.join([*top, "Content-Type: application/warc-fields", f"Content-Length: {len(info)}", "", info, CRLF]).encode()


def convert(spark: SparkSession, arc_path: str, warc_path: str, min_bytes: int = 0, archive_bytes: int = ARCHIVE_BYTES, broadcast_bytes: int = BROADCAST_BYTES) -> None:
    """Convert the ARC files under a path to gzipped WARC files under another.

    Of captures with equal payloads of at least `min_bytes` bytes, that with the largest key (the page number of the HTTP
    header; ties: the last in the last file; no key: smallest) is the response and the others are revisits without their
    payload. Shorter ones are responses all. The payload moves by shuffle only if the repeated digests are many.
    """
    rows = materialize(captures(spark, arc_path), "arc-captures")
    place = F.struct("key", "file", "at", "url", "date")
    repeated = rows.filter(F.col("payload_bytes") >= min_bytes).groupBy("digest").agg(F.count("*").alias("n"), F.max(place).alias("winner"))
    repeated = materialize(repeated.filter("n > 1").select("digest", "winner"), "arc-repeated")
    small = repeated.count() * 512 <= broadcast_bytes
    joined = rows.join(F.broadcast(repeated) if small else repeated, "digest", "left")
    joined = joined.withColumn("winner", F.when(F.col("payload_bytes") >= min_bytes, F.col("winner")))
    if min_bytes > 0:  # short ones keep their payload in every record: take it from the archive's own copy
        texts = rows.filter((F.col("payload_bytes") < min_bytes) & F.col("payload").isNotNull()).groupBy("digest").agg(F.first("payload").alias("_p"))
        joined = joined.join(texts, "digest", "left").withColumn("payload", F.coalesce("payload", "_p")).drop("_p")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, parts, size = TaskContext.get().partitionId(), 0, [], 0
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                for r in batch.slice(k, 256).to_pylist():
                    parts = parts or [warcinfo(warc_path, part, number)]
                    parts.append(warc_record(r))
                    size += len(parts[-1])
                    if size >= archive_bytes:
                        yield file_row(parts)
                        number, parts, size = number + 1, [], 0
        if parts:
            yield file_row(parts)

    write_files(joined.mapInArrow(run, "value binary"), warc_path)
    remove(spark, rows._scratch)


def read_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(fields, block) of every record of a WARC file, by the declared lengths; a malformed one is an error."""
    at = 0
    while at < len(data):
        end = data.find(b"\r\n\r\n", at)
        lines = data[at:end].decode("utf-8", "replace").split("\r\n")
        if end < 0 or not lines[0].startswith("WARC/"):
            raise ValueError(f"malformed WARC header at byte {at}")
        fields = dict(line.split(": ", 1) for line in lines[1:])
        length = int(fields["Content-Length"])
        block = data[end + 4 : end + 4 + length]
        if len(block) != length or data[end + 4 + length : end + 8 + length] != b"\r\n\r\n":
            raise ValueError(f"WARC record at byte {at} does not end after {length} bytes")
        yield fields, block
        at = end + 8 + length


def records(spark: SparkSession, path: str) -> DataFrame:
    """The records of all WARC files under a path: key, url, date, record_id, record_type, payload_bytes, payload_digest,
    refers_to (the key), payload (binary). Digests are computed from the payload where the record has it, and must be those declared."""
    names = ["key", "url", "date", "record_id", "record_type", "payload_bytes", "payload_digest", "refers_to", "payload"]
    types = [pa.int64(), *[pa.string()] * 4, pa.int64(), pa.string(), pa.int64(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                rows = []
                for f, block in read_warc(inflate(content.as_py())):
                    if f["WARC-Type"] == "warcinfo":
                        continue
                    digest, size, html = f["WARC-Payload-Digest"].removeprefix("sha1:"), int(f["X-Payload-Length"]), None
                    if f["WARC-Type"] != "revisit":
                        payload = split_http(block)[1]
                        if sha1_32(payload) != digest or len(payload) != size:
                            raise ValueError(f"payload of {f['WARC-Record-ID']} does not match its digest")
                        html = payload
                    key, to = f.get("X-Record-Key"), f.get("X-Refers-To-Key")
                    rows.append((key and int(key), f["WARC-Target-URI"], f["WARC-Date"], f["WARC-Record-ID"], f["WARC-Type"], size, digest, to and int(to), html))
                for k in range(0, len(rows), 256):
                    yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*rows[k : k + 256], strict=True), types, strict=True)], names)

    schema = "key long, url string, date string, record_id string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary"
    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, schema)


def archive_pages(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Pages through ARC archives into WARC archives and back: the records that `records` reads.

    A null or empty html is a payload of 0 bytes, a null url is written as `-`, a null page_id gives a record without a
    key (null again when read). Repeated rows are records of their own, one of them the response. White space in urls is
    percent-encoded. An empty table gives no records. Further columns are not read.
    """
    spark = pages.sparkSession
    arc, warc = scratch_path(spark, "arc"), scratch_path(spark, "warc")
    write_arcs(pages, arc)
    convert(spark, arc, warc, min_bytes)
    remove(spark, arc)
    return records(spark, warc)


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as a WARC record, written and read back."""
    out = archive_pages(table(spark, sf_dir, "pages"))
    return out.select(F.col("key").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")
