"""Web archives: writes legacy ARC files, converts them to WARC, reads WARC back.

Both formats are written by Spark's text sink, whose line separator is what ends a record (newline for ARC, two CRLF for
WARC), and parsed by declared lengths, never by content. A file holds at most FILE_RECORDS records, the first of which is its
header; it is read as one binary value, but unzipped and parsed a few megabytes at a time, so a task holds one packed file and
one record beside it.
ARC header lines are read by their version's field count. The converter makes record identifiers from file name, offset and
content, dates, types and digests; of records whose payloads are equal and of at least min_bytes, the one with the largest
page number (then the last in the archive) becomes the response and the others revisits of it.
Defined results: null html is an empty payload; null or blank urls are written as 'unknown:'; null page numbers sort first;
repeated rows are records of their own; payloads of any length may hold line ends and record-like text; extra columns are not
read, whatever their names; an empty table gives no records."""

from __future__ import annotations

import base64
import hashlib
import re
import urllib.parse
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.batches import drop_path, scratch, slices, small_batches

#: Field lists of the two ARC versions, and the profile of a revisit.
ARC_FIELDS = {1: "URL IP-address Archive-date Content-type Archive-length", 2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length"}
REVISIT = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
DATE, IP = "20240101000000", "0.0.0.0"
SAFE = "".join(chr(c) for c in range(33, 127))
#: Records of a file, its header included, and bytes that are unzipped at once.
FILE_RECORDS, STEP = 4096, 4 << 20


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def arc_url(url: str | None) -> str:
    """The url as one field: white space and characters beyond ASCII percent-encoded."""
    return urllib.parse.quote(url, safe=SAFE) if url and url.strip() else "unknown:"


def http_message(page_id: int | None, payload: bytes) -> bytes:
    own = f"X-Page-Id: {page_id}\r\n" if page_id is not None else ""
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n{own}Content-Length: {len(payload)}\r\n\r\n".encode() + payload


def arc_record(version: int, url: str, date: str, mime: str, body: bytes, file: str, offset: int) -> bytes:
    if version == 1:
        head = f"{url} {IP} {date} {mime} {len(body)}"
    else:
        head = f"{url} {IP} {date} {mime} 200 {hashlib.md5(body).hexdigest()} - {offset} {file} {len(body)}"
    return head.encode() + b"\n" + body


def arc_header(version: int, file: str, date: str = DATE) -> bytes:
    body = f"{version} 0 quern\n{ARC_FIELDS[version]}\n".encode()
    return f"filedesc://{file} {IP} {date} text/plain".encode() + (b" " if version == 1 else b" 200 - - 0 " + file.encode() + b" ") + f"{len(body)}\n".encode() + body


def _write(rows: DataFrame, path: str, end: str, file_records: int) -> None:
    """Each row of `value` is a record; the sink ends it and begins a file every file_records rows."""
    out = rows.select(F.col("value").cast("string")).write.option("lineSep", end).option("compression", "gzip")
    out.option("maxRecordsPerFile", file_records).text(path)


def write_arc(pages: DataFrame, path: str, key: str = "page_id", url: str = "url", html: str = "html", versions: tuple[int, ...] = (1, 2), file_records: int = FILE_RECORDS) -> None:
    """ARC files of file_records records, a header first; the versions take turns."""
    rows = small_batches(pages.select(F.col(key).cast("long").alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html")))

    def run(batches):
        from pyspark import TaskContext

        part, k, at, version, file = TaskContext.get().partitionId(), 0, 0, 1, ""
        for b in batches:
            for s in slices(b, "html"):
                out = []
                for i, u, h in zip(s.column("page_id").to_pylist(), s.column("url").to_pylist(), s.column("html").to_pylist()):
                    if k % file_records == 0:
                        n = k // file_records
                        version, file = versions[(part + n) % len(versions)], f"quern-{part:05d}-{n:05d}.arc"
                        out.append(arc_header(version, file))
                        k, at = k + 1, len(out[-1]) + 1
                    out.append(arc_record(version, arc_url(u), DATE, "text/html", http_message(i, (h or "").encode()), file, at))
                    k, at = k + 1, at + len(out[-1]) + 1
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["value"])

    _write(rows.mapInArrow(run, "value binary"), path, "\n", file_records)


class Bytes:
    """The content of a file, gzip members one after the other or plain, as a stream of which only what is in use is unzipped."""

    def __init__(self, content: bytes, step: int = STEP):
        self._left, self._step = memoryview(content), step
        self._zip = zlib.decompressobj(31) if content[:2] == b"\x1f\x8b" else None
        self._held, self._at, self.pos = b"", 0, 0

    def _more(self) -> bool:
        if self._zip is None:
            new, self._left = bytes(self._left[: self._step]), self._left[self._step :]
        else:
            new = self._zip.decompress(self._left, self._step)
            self._left = memoryview(self._zip.unconsumed_tail)
            if self._zip.eof:
                self._left = memoryview(self._zip.unused_data)
                self._zip = zlib.decompressobj(31)
            if not new and not len(self._left):
                return False
        if not new and self._zip is None:
            return False
        self._held, self._at = self._held[self._at :] + new, 0
        return True

    def until(self, mark: bytes) -> bytes | None:
        """The bytes to the next mark, without it; None if there is none (and nothing is taken)."""
        looked = self._at
        while (i := self._held.find(mark, looked)) < 0:
            looked = max(self._at, len(self._held) - len(mark) + 1) - self._at
            if not self._more():
                return None
        got = self._held[self._at : i]
        self.pos += i + len(mark) - self._at
        self._at = i + len(mark)
        return got

    def take(self, n: int) -> bytes:
        """The next n bytes, or what is left."""
        if len(self._held) - self._at < n:
            parts, have = [self._held[self._at :]], len(self._held) - self._at
            self._held, self._at = b"", 0
            while have < n and self._more():
                parts.append(self._held)
                have += len(self._held)
                self._held = b""
            self._held = b"".join(parts)
        got = self._held[self._at : self._at + n]
        self._at += len(got)
        self.pos += len(got)
        return got

    def ended(self) -> bool:
        while self._at == len(self._held):
            if not self._more():
                return True
        return False


def parse_arc(content: bytes, step: int = STEP):
    """(offset, url, ip, date, content type, body) of each record but the file's own; the version block names the fields."""
    data, fields = Bytes(content, step), None
    while not data.ended():
        pos = data.pos
        head = data.until(b"\n")
        if head is None:
            raise ValueError(f"ARC header line at {pos} does not end")
        line = head.decode("utf-8", "replace").rstrip("\r")
        if not line:
            continue
        parts = line.split(" ")
        n = int(parts[-1])
        body = data.take(n)
        if len(body) != n:
            raise ValueError(f"ARC record at {pos} declares {n} bytes, {len(body)} are left")
        if line.startswith("filedesc://"):
            version = int(body.split(b" ", 1)[0])
            fields = body.split(b"\n")[1].decode().split(" ")
            if version not in ARC_FIELDS or len(fields) != len(ARC_FIELDS[version].split(" ")):
                raise ValueError(f"unknown ARC version {version}")
        else:
            if fields is None or len(parts) != len(fields):
                raise ValueError(f"ARC header line at {pos} has {len(parts)} fields")
            of = dict(zip(fields, parts))
            yield pos, of["URL"], of["IP-address"], of["Archive-date"], of["Content-type"], body


def http_parts(body: bytes) -> tuple[bytes, bytes, dict[str, str]]:
    """(head with its blank line, payload, header fields by lower-case name); all payload if it's no HTTP message."""
    if not body.startswith(b"HTTP/"):
        return b"", body, {}
    cut = body.find(b"\r\n\r\n")
    head = body[: cut + 4] if cut >= 0 else body
    fields = {}
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        name, sep, value = line.partition(":")
        if sep:
            fields[name.strip().lower()] = value.strip()
    return head, body[len(head) :], fields


ARC_SCHEMA = "record_id string, page_id long, url string, ip string, date string, content_type string, body binary, payload_bytes long, payload_digest string"


def _files(spark: SparkSession, path: str) -> DataFrame:
    return small_batches(spark.read.format("binaryFile").load(path).where("length > 0").select("path", "content"))


def read_arc(spark: SparkSession, path: str, bodies: bool = True) -> DataFrame:
    """Records of ARC files. Identifiers are made from file name, offset and digest: the same whenever they are made."""

    def run(batches):
        names = [c.split(" ")[0] for c in ARC_SCHEMA.split(", ")]
        for b in batches:
            for i in range(b.num_rows):
                file = b.column("path")[i].as_py().rsplit("/", 1)[-1]
                rows, held = [], 0
                for at, url, ip, date, mime, body in parse_arc(b.column("content")[i].as_py()):
                    _, payload, fields = http_parts(body)
                    digest = base32_sha1(payload)
                    page = fields.get("x-page-id")
                    rid = str(uuid.uuid5(uuid.NAMESPACE_URL, f"{file}:{at}:{digest}:{url}"))
                    rows.append((rid, int(page) if page is not None else None, url, ip, date, mime, body if bodies else None, len(payload), digest))
                    held += len(body)
                    if held > 4 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), TYPES)], names)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), TYPES)], names)

    return _files(spark, path).mapInArrow(run, ARC_SCHEMA)


TYPES = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.binary(), pa.int64(), pa.string()]


def iso(date: str) -> str:
    return f"{date[:4]}-{date[4:6]}-{date[6:8]}T{date[8:10]}:{date[10:12]}:{date[12:14]}Z"


def warc_record(fields: list[tuple[str, str]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in [*fields, ("Content-Length", str(len(block)))])
    return b"WARC/1.0\r\n" + head.encode() + b"\r\n" + block


def arc_to_warc(spark: SparkSession, arc: str, warc: str, min_bytes: int = 0, file_records: int = FILE_RECORDS) -> None:
    """Convert. Digests alone are grouped; only groups of several go back to the records, by a join that skew can't hold up."""
    groups = read_arc(spark, arc, bodies=False).where(F.col("payload_bytes") >= min_bytes).groupBy("payload_digest", "payload_bytes").agg(F.count("*").alias("n"), F.max(F.struct("page_id", "record_id", "url", "date")).alias("first"))
    several = groups.where("n > 1").drop("n")
    rows = read_arc(spark, arc).join(several, ["payload_digest", "payload_bytes"], "left").select(
        "record_id", "page_id", "url", "ip", "date", "content_type", "body", "payload_bytes", "payload_digest",
        F.when(F.col("first.record_id") != F.col("record_id"), F.col("first.record_id")).alias("to_id"), F.col("first.url").alias("to_url"), F.col("first.date").alias("to_date"), F.col("first.page_id").alias("to_page"),
    )

    def run(batches):
        from pyspark import TaskContext

        k, part = 0, TaskContext.get().partitionId()
        for b in batches:
            for s in slices(b, "body"):
                out = []
                for r in s.to_pylist():
                    if k % file_records == 0:
                        info = b"software: quern\r\nformat: WARC File Format 1.0\r\n"
                        rid = uuid.uuid5(uuid.NAMESPACE_URL, f"warcinfo:{part}:{k}")
                        out.append(warc_record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{rid}>"), ("WARC-Date", iso(DATE)), ("Content-Type", "application/warc-fields")], info))
                        k += 1
                    k += 1
                    head, payload, _ = http_parts(r["body"])
                    revisit = r["to_id"] is not None
                    fields = [("WARC-Type", "revisit" if revisit else "response" if head else "resource"), ("WARC-Record-ID", f"<urn:uuid:{r['record_id']}>"), ("WARC-Date", iso(r["date"])), ("WARC-Target-URI", r["url"]), ("WARC-IP-Address", r["ip"]), ("WARC-Payload-Digest", f"sha1:{r['payload_digest']}")]
                    if revisit:
                        fields += [("WARC-Profile", REVISIT), ("WARC-Refers-To", f"<urn:uuid:{r['to_id']}>"), ("WARC-Refers-To-Target-URI", r["to_url"]), ("WARC-Refers-To-Date", iso(r["to_date"]))]
                        if r["to_page"] is not None:
                            fields.append(("X-Refers-To-Page-Id", str(r["to_page"])))
                    block = head if revisit else r["body"]
                    fields += [("Content-Type", "application/http; msgtype=response" if head else r["content_type"]), ("WARC-Block-Digest", f"sha1:{base32_sha1(block)}")]
                    out.append(warc_record(fields, block))
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["value"])

    _write(small_batches(rows).mapInArrow(run, "value binary"), warc, "\r\n\r\n", file_records)


def parse_warc(content: bytes, step: int = STEP):
    """(fields, block) of each record, by declared length."""
    data = Bytes(content, step)
    while not data.ended():
        pos = data.pos
        head = data.until(b"\r\n\r\n")
        if head is None or not head.startswith(b"WARC/"):
            raise ValueError(f"no WARC record at {pos}")
        fields = dict(line.split(": ", 1) for line in head.decode("utf-8", "replace").split("\r\n")[1:])
        n = int(fields["Content-Length"])
        block = data.take(n)
        if len(block) != n or data.take(4) != b"\r\n\r\n":
            raise ValueError(f"WARC record at {pos} does not end after {n} bytes")
        yield fields, block


WARC_SCHEMA = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, record_id string, url string, date string"


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Records but the files' own. A response's digest is made anew from its payload and must equal the declared one."""

    def run(batches):
        names = [c.split(" ")[0] for c in WARC_SCHEMA.split(", ")]
        types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string()]
        for b in batches:
            for i in range(b.num_rows):
                rows = []
                for f, block in parse_warc(b.column("content")[i].as_py()):
                    if f["WARC-Type"] == "warcinfo":
                        continue
                    _, payload, http = http_parts(block)
                    digest = f["WARC-Payload-Digest"].removeprefix("sha1:")
                    if f["WARC-Type"] == "revisit":
                        size = int(http["content-length"]) if "content-length" in http else None
                    else:
                        size = len(payload)
                        if base32_sha1(payload) != digest:
                            raise ValueError(f"{f['WARC-Record-ID']}: payload does not match its digest")
                    page, to = http.get("x-page-id"), f.get("X-Refers-To-Page-Id")
                    rows.append((int(page) if page is not None else None, size, digest, f["WARC-Type"], int(to) if to is not None else None, f["WARC-Record-ID"], f["WARC-Target-URI"], f["WARC-Date"]))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    return _files(spark, path).mapInArrow(run, WARC_SCHEMA)


def archive_pages(pages: DataFrame, min_bytes: int = 0, key: str = "page_id", url: str = "url", html: str = "html", file_records: int = FILE_RECORDS) -> DataFrame:
    """Write pages as ARC files, convert them to WARC, read the WARC files. The ARC files go when they are converted."""
    spark = pages.sparkSession
    arc, warc = scratch(spark, "arc"), scratch(spark, "warc")
    write_arc(pages, arc, key, url, html, file_records=file_records)
    arc_to_warc(spark, arc, warc, min_bytes, file_records)
    drop_path(spark, arc)
    return read_warc(spark, warc)
