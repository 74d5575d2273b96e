"""Legacy archives: ARC files of version 1 and 2, and their conversion to WARC.

An archive is one file of bounded size. A record is its header line, whose fields
depend on the version named at the start of the file, and as many bytes as that
line declares. Conversion keeps URL, address, time and content, and makes up the
rest: a record id from the record's own fields, block and payload digests, the
content type of a response, and a revisit where the same payload is kept
elsewhere.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialloom.llm.common import bounded_batches
from trialloom.session import scratch, settle

#: Bytes after which a new archive begins.
ARCHIVE_BYTES = 8 << 20
FIELDS = {
    1: ("url", "ip", "date", "type", "length"),
    2: ("url", "ip", "date", "type", "status", "checksum", "location", "offset", "filename", "length"),
}
_TITLES = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
_SAFE = "".join(chr(c) for c in range(33, 127))
_ID = "X-Page-Id"


@dataclass
class ArcRecord:
    version: int
    fields: dict[str, str]
    block: bytes

    def payload(self) -> bytes:
        """The body after the HTTP header, or the whole block if it has none."""
        if self.block.startswith(b"HTTP/"):
            head, gap, body = self.block.partition(b"\r\n\r\n")
            return body if gap else b""
        return self.block

    def http(self, name: str) -> str | None:
        head = self.block.partition(b"\r\n\r\n")[0] if self.block.startswith(b"HTTP/") else b""
        for line in head.split(b"\r\n")[1:]:
            key, _, value = line.partition(b":")
            if key.strip().lower() == name.lower().encode():
                return value.strip().decode("latin-1")
        return None


def version_block(name: str, version: int, date: str) -> bytes:
    body = f"{version} 0 trialloom\n{_TITLES[version]}\n".encode()
    fields = {"url": f"filedesc://{name}", "ip": "0.0.0.0", "date": date, "type": "text/plain", "status": "200",
              "checksum": "-", "location": "-", "offset": "0", "filename": name, "length": str(len(body))}
    return " ".join(fields[f] for f in FIELDS[version]).encode() + b"\n" + body + b"\n"


def arc_record(version: int, page_id: int | None, url: str | None, html: str | None, date: str, name: str,
               offset: int) -> bytes:
    """One record: a null URL is ``-``, a null page has an empty body and a null id a header ``-``."""
    body = (html or "").encode()
    block = (f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: {len(body)}\r\n"
             f"{_ID}: {'-' if page_id is None else page_id}\r\n\r\n").encode() + body
    fields = {"url": quote(url, safe=_SAFE) if url else "-", "ip": "0.0.0.0", "date": date, "type": "text/html",
              "status": "200", "checksum": hashlib.md5(body).hexdigest(), "location": "-", "offset": str(offset),
              "filename": name, "length": str(len(block))}
    return " ".join(fields[f] for f in FIELDS[version]).encode() + b"\n" + block + b"\n"


def read_arc(data: bytes) -> Iterator[ArcRecord]:
    """Records of an archive after its version block; a damaged header line or length raises ValueError."""
    at, version = 0, None
    while at < len(data):
        if data[at:at + 1] in (b"\n", b"\r"):
            at += 1
            continue
        end = data.find(b"\n", at)
        if end < 0:
            raise ValueError(f"header line without end at byte {at}")
        parts = data[at:end].decode("latin-1").rstrip("\r").split(" ")
        length = int(parts[-1])
        block = data[end + 1:end + 1 + length]
        if len(block) < length:
            raise ValueError(f"record at byte {at} declares {length} bytes, {len(block)} are left")
        at = end + 1 + length
        if version is None:
            if not parts[0].startswith("filedesc://"):
                raise ValueError("no version block")
            version = int(block.split(b" ", 1)[0])
            if version not in FIELDS:
                raise ValueError(f"unknown version {version}")
            continue
        if len(parts) != len(FIELDS[version]):
            raise ValueError(f"{len(parts)} fields in a header line of version {version}")
        yield ArcRecord(version, dict(zip(FIELDS[version], parts, strict=True)), block)


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(archive: str, ordinal: int, url: str, date: str) -> str:
    """Equal input, equal id: a UUID of archive, place, URL and time."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{archive} {ordinal} {url} {date}')}>"


def warc_date(date: str) -> str:
    """ARC's digits (14, or fewer as older writers left them) as a WARC time; unreadable ones are the epoch."""
    digits = re.sub(r"\D", "", date)
    digits = (digits + "00000101000000"[len(digits):])[:14] if len(digits) >= 4 else "19700101000000"
    y, mo, d, h, mi, s = digits[:4], digits[4:6], digits[6:8], digits[8:10], digits[10:12], digits[12:14]
    return f"{y}-{mo}-{d}T{h}:{mi}:{s}Z"


def warc_record(record: ArcRecord, archive: str, ordinal: int, refers: str | None = None) -> bytes:
    """A response, or a revisit of the page ``refers`` without the payload; ends before the closing blank lines."""
    url, date = record.fields["url"], record.fields["date"]
    payload = record.payload()
    block = record.block
    http = block.startswith(b"HTTP/")
    head = [("WARC-Type", "response" if refers is None else "revisit"), ("WARC-Record-ID", record_id(archive, ordinal, url, date)),
            ("WARC-Date", warc_date(date)), ("WARC-Target-URI", url), ("WARC-IP-Address", record.fields["ip"]),
            ("WARC-Payload-Digest", f"sha1:{base32_sha1(payload)}"), (f"WARC-{_ID}", record.http(_ID) or "-"),
            ("WARC-Payload-Length", str(len(payload)))]
    if refers is not None:
        block = block[:len(block) - len(payload)]
        head += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
                 ("WARC-Refers-To-Page", refers)]
    head += [("WARC-Block-Digest", f"sha1:{base32_sha1(block)}"),
             ("Content-Type", "application/http; msgtype=response" if http else record.fields["type"]),
             ("Content-Length", str(len(block)))]
    lines = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head) + "\r\n"
    return lines.encode() + block


def read_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header and block of each record, by declared lengths."""
    at = 0
    while at < len(data):
        end = data.find(b"\r\n\r\n", at)
        if end < 0 or not data.startswith(b"WARC/", at):
            raise ValueError(f"no record at byte {at}")
        head = dict(line.split(": ", 1) for line in data[at:end].decode().split("\r\n")[1:])
        size = int(head["Content-Length"])
        block = data[end + 4:end + 4 + size]
        at = end + 4 + size
        if len(block) < size or data[at:at + 4] != b"\r\n\r\n":
            raise ValueError(f"record ends early at byte {at}")
        at += 4
        yield head, block


def _write(rows: DataFrame, path: str, end: str) -> None:
    """Each row, a whole archive, becomes a compressed file of its own."""
    rows.select(F.col("archive").cast("string")).write.option("maxRecordsPerFile", 1).option("lineSep", end).option(
        "compression", "gzip").text(path)


def write_arc(pages: DataFrame, path: str, key: str = "page_id", url: str = "url", html: str = "html",
              date: str = "20240101000000", limit: int = ARCHIVE_BYTES) -> None:
    """Pack pages into ARC files of about ``limit`` bytes, versions 1 and 2 in turn; no shuffle."""
    bounded_batches(pages.sparkSession)

    def pack(batches):
        from pyspark import TaskContext

        n, held, size = 0, [], 0
        part = TaskContext.get().partitionId()
        for batch in batches:
            for page, link, text in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                version, name = 1 + n % 2, f"pages-{part}-{n}.arc"
                if not held:
                    held = [version_block(name, version, date)]
                    size = len(held[0])
                held.append(arc_record(version, page, link, text, date, name, size))
                size += len(held[-1])
                if size >= limit:
                    yield pa.RecordBatch.from_pydict({"archive": pa.array([b"".join(held)], pa.binary())})
                    n, held = n + 1, []
        if held:
            yield pa.RecordBatch.from_pydict({"archive": pa.array([b"".join(held)], pa.binary())})

    rows = pages.select(F.col(key).cast("long"), F.col(url).cast("string"), F.col(html).cast("string"))
    _write(rows.mapInArrow(pack, "archive binary"), path, "\n")


def _open(data: bytes) -> bytes:
    import zlib

    out = []
    while data[:2] == b"\x1f\x8b":  # one or more compressed members
        one = zlib.decompressobj(31)
        out.append(one.decompress(data))
        data = one.unused_data
    return b"".join(out) if out else data


def _files(spark, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "content")


def convert(spark, source: str, target: str, least: int = 0) -> None:
    """ARC files below ``source`` to WARC files below ``target``, file by file.

    Of records with equal payloads of ``least`` bytes or more, the one with the
    smallest page id stays a response and the others become revisits. A first
    pass takes digests only; the verdicts on a file's records join its content.
    """
    bounded_batches(spark)

    def digests(batches):
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows = [(path, k, r.http(_ID), base32_sha1(p := r.payload()), len(p))
                        for k, r in enumerate(read_arc(_open(content.as_py())))]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)],
                                                     ["path", "ordinal", "page", "digest", "size"])

    files = _files(spark, source)
    seen = settle(files.mapInArrow(digests, "path string, ordinal long, page string, digest string, size long"), "digests")
    rank = F.struct(F.expr("try_cast(page as bigint) is null").alias("none"),
                    F.expr("try_cast(page as bigint)").alias("id"), "path", "ordinal")
    ranked = seen.where(F.col("size") >= least).withColumn("rank", rank)
    heads = ranked.groupBy("digest", "size").agg(F.min("rank").alias("head"), F.count("*").alias("n")).where("n > 1")
    again = ranked.join(heads, ["digest", "size"]).where("rank <> head").groupBy("path").agg(
        F.map_from_entries(F.collect_list(F.struct("ordinal", F.coalesce(F.col("head.id").cast("string"), F.lit("-")))
                                          )).alias("again"))  # at most the records of one archive

    again = settle(again, "revisits")  # a table of known size: if it is small, the archives are not shuffled for it

    def rewrite(batches):
        for batch in batches:
            for path, content, verdict in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(),
                                              strict=True):
                refers = dict(verdict or [])
                name = path.rsplit("/", 1)[-1]
                records = [warc_record(r, name, k, refers.get(k)) for k, r in enumerate(read_arc(_open(content.as_py())))]
                if records:
                    yield pa.RecordBatch.from_pydict({"archive": pa.array([b"\r\n\r\n".join(records)], pa.binary())})

    _write(files.join(again, "path", "left").mapInArrow(rewrite, "archive binary"), target, "\r\n\r\n")


def read_back(spark, path: str) -> DataFrame:
    """(page_id, url, date, payload_bytes, payload_digest, record_type, refers_to) of WARC files below ``path``.

    A response's payload is digested anew and must agree with its header.
    """
    bounded_batches(spark)

    def read(batches):
        for batch in batches:
            for content in batch.column(0):
                rows = []
                for head, block in read_warc(_open(content.as_py())):
                    digest = head["WARC-Payload-Digest"].removeprefix("sha1:")
                    size = int(head["WARC-Payload-Length"])
                    if head["WARC-Type"] == "response":
                        payload = ArcRecord(1, {}, block).payload()
                        if (base32_sha1(payload), len(payload)) != (digest, size):
                            raise ValueError(f"payload of {head['WARC-Record-ID']} does not match its digest")
                    page, refers = head[f"WARC-{_ID}"], head.get("WARC-Refers-To-Page")
                    rows.append((None if page == "-" else int(page), head["WARC-Target-URI"], head["WARC-Date"], size,
                                 digest, head["WARC-Type"], None if refers in (None, "-") else int(refers)))
                kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64())
                columns = zip(*rows, strict=True) if rows else [[]] * len(kinds)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                    ["page_id", "url", "date", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    return _files(spark, path).select("content").mapInArrow(
        read, "page_id long, url string, date string, payload_bytes long, payload_digest string, record_type string, "
              "refers_to long")


def archive_pages(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", least: int = 0,
                  limit: int = ARCHIVE_BYTES) -> DataFrame:
    """Pages to ARC, ARC to WARC, and the WARC records read again, a row for each page.

    A null html counts as empty, a null url is ``-``; a null page id never is the
    response of a payload that a page with an id has too, and a revisit of such
    a response refers to null. Of rows alike one is the response. Other columns
    are not archived; an empty table gives no rows.
    """
    spark = pages.sparkSession
    source, target = scratch(spark, "arc"), scratch(spark, "warc")
    write_arc(pages, source, key, url, html, limit=limit)
    convert(spark, source, target, least)
    return read_back(spark, target)
