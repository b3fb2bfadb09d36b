"""WARC records in ZIP packages, written by tasks and read back by ranges.

A package holds ``archive/data.warc.gz`` (one gzip member a record), ``indexes/index.cdxj``
(one line a record with its place) and ``datapackage.json``, all stored without compression,
so that a record is found and read without unpacking: end record, ZIP64 locator and central
directory give the members, the local header gives a member's first byte, the index gives
the record's range within it.
"""

from __future__ import annotations

import base64
import hashlib
import json
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import attached, mapped, owned, scratch_path, small, text_bytes, written

#: Payload bytes after which a task begins its next package.
PACKAGE_BYTES = 64 << 20
#: Records after which a package closes, however small they are, and rows of a batch that are Python objects at once.
PACKAGE_RECORDS, ROWS = 100_000, 256
DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
DATE = "2024-01-01T00:00:00Z"
IDENTICAL = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def record_bytes(page_id, url: str | None, payload: bytes, digest: str, refers_to, revisit: bool) -> bytes:
    """One WARC/1.1 record.  A revisit holds the HTTP header alone, which still tells the payload's length."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    uri = "".join(c if " " < c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in url) if url else None
    fields = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", f"<urn:page:{'' if page_id is None else page_id}>"),
        ("WARC-Date", DATE),
        *([("WARC-Target-URI", uri)] if uri is not None else []),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        *([("WARC-Profile", IDENTICAL), ("WARC-Refers-To", f"<urn:page:{refers_to}>")] if revisit else []),
        ("Content-Type", "application/http;msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    return head.encode() + block + b"\r\n\r\n"


class PackageWriter:
    """Streams one package; only the index is held."""

    def __init__(self, uri: str, *, zip64: bool = False):
        store, path = _filesystem(uri)
        store.create_dir(path.rpartition("/")[0], recursive=True)
        self.uri, self.raw, self.index, self.at, self.payload = uri, store.open_output_stream(path), [], 0, 0
        self.zip = zipfile.ZipFile(self.raw, "w", zipfile.ZIP_STORED, allowZip64=True)
        self.zip64 = zip64
        self.data = self.zip.open(zipfile.ZipInfo(DATA), "w", force_zip64=True)

    def add(self, record: bytes, entry: dict, payload_size: int) -> None:
        pack = zlib.compressobj(1, zlib.DEFLATED, 31)
        member = pack.compress(record) + pack.flush()
        self.data.write(member)
        self.index.append(json.dumps(entry | {"offset": self.at, "length": len(member)}, separators=(",", ":")))
        self.at += len(member)
        self.payload += payload_size

    def close(self) -> dict:
        self.data.close()
        with self.zip.open(zipfile.ZipInfo(INDEX), "w", force_zip64=True) as out:
            out.write("".join(f"{x}\n" for x in self.index).encode())
        about = {"profile": "data-package", "resources": [{"path": DATA, "bytes": self.at}, {"path": INDEX, "records": len(self.index)}]}
        self.zip.writestr(zipfile.ZipInfo("datapackage.json"), json.dumps(about))
        self.zip.close()
        self.raw.close()
        return {"package": self.uri, "records": len(self.index), "data_bytes": self.at}


@dataclass(frozen=True)
class Member:
    name: str
    method: int
    size: int
    stored: int
    header_at: int


class PackageReader:
    """Range reader over any seekable file: nothing but directories and the ranges asked for is read."""

    def __init__(self, file, length: int):
        self.file, self.length = file, length
        self.members = {m.name: m for m in self._directory()}

    def range(self, at: int, size: int) -> bytes:
        if at < 0 or size < 0 or at + size > self.length:
            raise ValueError("range outside the package")
        self.file.seek(at)
        return self.file.read(size)

    def _directory(self) -> list[Member]:
        tail_at = max(0, self.length - 65_557)
        tail = self.range(tail_at, self.length - tail_at)
        end = tail.rfind(b"PK\5\6")
        while end >= 0 and end + 22 + int.from_bytes(tail[end + 20 : end + 22], "little") != len(tail):
            end = tail.rfind(b"PK\5\6", 0, end)  # the signature may stand in the comment
        if end < 0:
            raise ValueError("no end of central directory")
        count, size, at = struct.unpack("<10xHII", tail[end : end + 20])
        locator = self.range(tail_at + end - 20, 20) if tail_at + end >= 20 else b""
        if locator[:4] == b"PK\6\7":
            (record_at,) = struct.unpack("<8xQ4x", locator)
            record = self.range(record_at, 56)
            if record[:4] != b"PK\6\6":
                raise ValueError("no ZIP64 end record")
            count, size, at = struct.unpack("<32xQQQ", record)
        directory, place, found = self.range(at, size), 0, []
        for _ in range(count):
            if directory[place : place + 4] != b"PK\1\2":
                raise ValueError("damaged central directory")
            flags, method, stored, length, n_name, n_extra, n_note, header_at = struct.unpack("<8xHH8xIIHHH8xI", directory[place : place + 46])
            name = directory[place + 46 : place + 46 + n_name].decode("utf-8" if flags & 0x800 else "cp437")
            extra = directory[place + 46 + n_name : place + 46 + n_name + n_extra]
            wide, k = b"", 0
            while k + 4 <= len(extra):
                tag, n = struct.unpack("<HH", extra[k : k + 4])
                if tag == 1:
                    wide = extra[k + 4 : k + 4 + n]
                k += 4 + n
            values = []
            for value in (length, stored, header_at):  # 64-bit values stand in this order, each only if its field is full
                if value == 0xFFFFFFFF:
                    value, wide = int.from_bytes(wide[:8], "little"), wide[8:]
                values.append(value)
            found.append(Member(name, method, values[0], values[1], values[2]))
            place += 46 + n_name + n_extra + n_note
        return found

    def start(self, name: str) -> int:
        """The first byte of a stored member."""
        m = self.members[name]
        if m.method:
            raise ValueError(f"{name} isn't stored")
        head = self.range(m.header_at, 30)
        if head[:4] != b"PK\3\4":
            raise ValueError("no local header")
        n_name, n_extra = struct.unpack("<26xHH", head)
        return m.header_at + 30 + n_name + n_extra

    def read(self, name: str, at: int = 0, size: int | None = None) -> bytes:
        m = self.members[name]
        size = m.size - at if size is None else size
        if at + size > m.size:
            raise ValueError("range outside the member")
        return self.range(self.start(name) + at, size)


def parsed_record(raw: bytes) -> tuple[dict, bytes, bytes]:
    """(WARC fields, HTTP header, payload) of one record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError("no WARC record")
    fields = dict(line.split(": ", 1) for line in lines)
    size = int(fields["Content-Length"])
    if rest[size : size + 4] != b"\r\n\r\n":
        raise ValueError("record of another length")
    http, _, payload = rest[:size].partition(b"\r\n\r\n")
    return fields, http, payload


def _id_text(value) -> str | None:
    return None if value is None or value != value else str(int(value))


def written_packages(pages: DataFrame, to: str, *, min_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", package_bytes: int = PACKAGE_BYTES) -> DataFrame:
    """Writes every row as a record below the folder ``to``; returns the manifest (package, records, data_bytes).

    Of rows with equal payloads of at least ``min_bytes`` bytes, those with the smallest id
    are responses and the others revisit it.  Digests alone are grouped.  Each task writes
    packages of its own names; a package counts only if the manifest lists it, so files of
    lost tasks are never read.
    """
    html = F.coalesce(F.col(html_col), F.lit(""))
    sha, size = F.unhex(F.sha1(html)), text_bytes(html_col)
    digests = pages.select(F.col(id_col).alias("page_id"), sha.alias("sha"), size.alias("n_bytes"))
    firsts = digests.where(F.col("n_bytes") >= min_bytes).groupBy("sha", "n_bytes").agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("group_size")).where("group_size > 1 and first_id is not null")
    firsts = written(firsts, "repeated-pages")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), html.alias("html"), sha.alias("sha"), size.alias("n_bytes"))
    if small(firsts):
        rows = rows.join(F.broadcast(firsts), ["sha", "n_bytes"], "left")
    else:
        rows = attached(rows, firsts, ["sha", "n_bytes"], digests.count())
    rows = rows.select("page_id", "url", "html", "sha", F.when(F.col("page_id").eqNullSafe(F.col("first_id")), F.lit(None)).otherwise(F.col("first_id")).cast("long").alias("refers_to"))

    def write(batches: Iterator) -> Iterator[pd.DataFrame]:
        out = None
        for batch in (whole.slice(at, ROWS) for whole in batches for at in range(0, whole.num_rows, ROWS)):
            for page_id, url, body, sha1, refers_to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                out = out or PackageWriter(f"{to}/{uuid.uuid4().hex}.wacz")
                payload = body.encode()
                digest = base64.b32encode(sha1).decode()
                entry = {"url": url, "id": page_id}
                out.add(record_bytes(page_id, url, payload, digest, refers_to, refers_to is not None), entry, len(payload))
                if out.payload >= package_bytes or len(out.index) >= PACKAGE_RECORDS:
                    yield _row(out.close())
                    out = None
        if out:
            yield _row(out.close())

    return written(mapped(rows, write, "package string, records long, data_bytes long"), "manifest")


def _row(found: dict):
    import pyarrow as pa

    return pa.RecordBatch.from_pylist([found])


def read_packages(manifest: DataFrame) -> DataFrame:
    """Reads every record of the packages a manifest lists, by ranges, and checks its payload digest.

    Output: page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload
    (null for revisits).  Pruned columns cost nothing beyond the read.
    """

    def read(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for package in batch.column(0).to_pylist():
                store, path = _filesystem(package)
                with store.open_input_file(path) as file:
                    yield from _records(PackageReader(file, file.size()), pa)

    count = max(1, min(manifest.count(), 10_000))
    return mapped(manifest.select("package").repartition(count), read, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload string")


def _records(reader: PackageReader, pa) -> Iterator:
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]
    types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()]
    start, rows, held = reader.start(DATA), [], 0
    for line in reader.read(INDEX).splitlines():
        entry = json.loads(line)
        raw = zlib.decompress(reader.range(start + entry["offset"], entry["length"]), 31)
        fields, http, payload = parsed_record(raw)
        kind, digest = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha1:")
        if kind == "response":
            if base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
                raise ValueError(f"payload of {entry} doesn't have its digest")
            size = len(payload)
        else:
            size = int(next(x for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")).split(b":")[1])
        own, refers = (fields.get(k, "")[10:-1] or None for k in ("WARC-Record-ID", "WARC-Refers-To"))
        rows.append((own and int(own), entry["url"], size, digest, kind, refers and int(refers), payload.decode() if kind == "response" else None))
        held += len(payload)
        if held > 8 << 20 or len(rows) >= 2000:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types, strict=True)], names=names)
            rows, held = [], 0
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types, strict=True)], names=names)


def archived(pages: DataFrame, *, to: str | None = None, **options) -> DataFrame:
    """Writes ``pages`` as packages and reads them back: one row per page.

    A null html is an empty payload, which has the digest of no bytes and takes part in
    revisits like any other; a null url has no target field and stays null; a row without an
    id is a response unless a row with an id has its payload; repeated rows with the smallest
    id are all responses; an empty table writes nothing.  Other columns aren't read.
    """
    spark = pages.sparkSession
    folder = to or scratch_path(spark, "packages")
    index = written_packages(pages, folder, **options)
    if not to:
        owned(spark, folder)
    return read_packages(index)
