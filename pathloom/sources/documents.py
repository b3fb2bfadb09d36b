"""Texts of documents: plain files, DOCX, XLSX and PDF, within fixed bounds, with a cache table."""

from __future__ import annotations

import codecs
import io
import re
import time
import zipfile
import zlib
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import ascii_lower, extension
from . import pdf
from .scratch import stored
from .snapshot import SnapshotStore

MAX_FILE, MAX_ENTRIES, MAX_XML, MAX_TEXT, CACHE_ROWS = 20 << 20, 4096, 32 << 20, 8 << 20, 4096
CACHED = "path string, mtime long, size long, text string, error string, cached_at double"
#: Bytes of a file that a preview reads.
HEAD_BYTES = 64 << 10
#: Files whose texts a task hands on together.
FILES_AT_ONCE = 8
#: Bytes and rows of a batch that are Python objects at once.
SLICE_BYTES, SLICE_ROWS = 1 << 20, 256
PART = re.compile(r"word/(?:document|header\d*|footer\d*|footnotes|endnotes)\.xml")
BREAKS = {"tab": "\t", "br": "\n", "cr": "\n", "p": "\n"}
SHEET = re.compile(r"xl/worksheets/[^/]+\.xml")


class ExtractError(ValueError):
    pass


class _Local(dict):
    """Tags to names without their space."""

    def __missing__(self, tag: str) -> str:
        return self.setdefault(tag, tag.rpartition("}")[2])


class _Parts:
    """The XML parts of a package, opened within the bounds."""

    def __init__(self, data: bytes):
        if len(data) > MAX_FILE:
            raise ExtractError("file too large")
        try:
            self.zip = zipfile.ZipFile(io.BytesIO(data))
        except (zipfile.BadZipFile, ValueError) as e:
            raise ExtractError(f"not a package: {e}") from e
        if len(self.zip.infolist()) > MAX_ENTRIES:
            raise ExtractError("too many entries")
        self.left, self.local = MAX_XML, _Local()

    def names(self) -> list[str]:
        return [i.filename for i in self.zip.infolist()]

    def ends(self, name: str) -> Iterator[tuple[str, ElementTree.Element]]:
        """(local name, element) of a part's elements, as they end."""
        try:
            with self.zip.open(name) as f:
                body = f.read(self.left + 1)
        except (zipfile.BadZipFile, zlib.error, NotImplementedError, RuntimeError, EOFError) as e:
            raise ExtractError(f"{name}: {e}") from e
        self.left -= len(body)
        if self.left < 0:
            raise ExtractError("too much XML")
        if b"<!DOCTYPE" in body[:4096] or b"<!ENTITY" in body:
            raise ExtractError("entities aren't supported")
        try:
            for _, e in ElementTree.iterparse(io.BytesIO(body)):
                yield self.local[e.tag], e
        except ElementTree.ParseError as e:
            raise ExtractError(f"{name}: {e}") from e


def _bounded(text: str) -> str:
    if len(text.encode("utf-8", "surrogatepass")) > MAX_TEXT:
        raise ExtractError("too much text")
    return text


def docx_text(data: bytes) -> str:
    parts, out = _Parts(data), []
    for name in parts.names():
        if PART.fullmatch(name):
            for tag, e in parts.ends(name):
                if tag == "t":
                    out.append(e.text or "")
                elif tag in BREAKS:
                    out.append(BREAKS[tag])
    return _bounded("".join(out))


def _shared_strings(parts: _Parts) -> list[str]:
    out: list[str] = []
    if "xl/sharedStrings.xml" in parts.names():
        for tag, e in parts.ends("xl/sharedStrings.xml"):
            if tag == "si":
                out.append("".join([x.text or "" for x in e.iter() if parts.local[x.tag] == "t"]))
                e.clear()
    return out


def xlsx_text(data: bytes) -> str:
    parts = _Parts(data)
    shared, rows = _shared_strings(parts), []
    for name in parts.names():
        if not SHEET.fullmatch(name):
            continue
        cells: list[str] = []
        for tag, e in parts.ends(name):
            if tag == "c":
                value = "".join([x.text or "" for x in e.iter() if parts.local[x.tag] in ("v", "t")])
                if e.get("t") == "s":
                    if not value.isdigit() or int(value) >= len(shared):
                        raise ExtractError("no such shared string")
                    value = shared[int(value)]
                if value:
                    cells.append(value)
            elif tag == "row":
                if cells:
                    rows.append("\t".join(cells))
                cells = []
                e.clear()
    return _bounded("\n".join(rows))


def pdf_text(data: bytes) -> str:
    """The pages' texts in their order; encryption and filters that aren't known are errors."""
    if len(data) > MAX_FILE:
        raise ExtractError("file too large")
    if b"%PDF-" not in data[:1024]:
        raise ExtractError("not a PDF")
    if b"/Encrypt" in data:
        raise ExtractError("encrypted")
    try:
        return _bounded(pdf.text_of(data))
    except pdf.PdfError as e:
        raise ExtractError(str(e)) from e


EXTRACTORS = {"docx": docx_text, "xlsx": xlsx_text, "pdf": pdf_text}


def text_or_error(path: str, data: bytes) -> tuple[str | None, str | None]:
    """(text, error) of one file's bytes: extracted by extension, else UTF-8 or an error."""
    try:
        return EXTRACTORS.get(path.rpartition(".")[2].lower(), bytes.decode)(data), None
    except (ExtractError, UnicodeDecodeError, RecursionError) as e:
        return None, str(e) or type(e).__name__


def slices(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """``batch`` in pieces of few bytes of ``column``, of one row at least."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
    at = 0
    while at < len(sizes):
        end, held = at + 1, sizes[at]
        while end < len(sizes) and end - at < SLICE_ROWS and held + sizes[end] <= SLICE_BYTES:
            held, end = held + sizes[end], end + 1
        yield batch.slice(at, end - at)
        at = end


def extracted(files: DataFrame) -> DataFrame:
    """(the other columns, text, error) of ``files`` (path, content, ...).  A slice's files and texts are in memory, not a batch's."""
    rest = [f for f in files.schema if f.name != "content"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "content"):
                found = [text_or_error(path, data.as_py() or b"") for path, data in zip(part.column("path").to_pylist(), part.column("content"), strict=True)]
                columns = [part.column(f.name) for f in rest] + [pa.array(side, pa.string()) for side in zip(*found, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, names=[*(f.name for f in rest), "text", "error"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rest)
    return files.mapInArrow(run, f"{fields}, text string, error string")


def packed(texts: DataFrame, build: Callable[[str], bytes]) -> DataFrame:
    """(the other columns, content): texts as the files that ``build`` makes of them, slice by slice."""
    rest = [f for f in texts.schema if f.name != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                content = pa.array([build(t.as_py()) for t in part.column("text")], pa.binary())
                yield pa.RecordBatch.from_arrays([*(part.column(f.name) for f in rest), content], names=[*(f.name for f in rest), "content"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rest)
    return texts.mapInArrow(run, f"{fields}, content binary")


def read_texts(spark: SparkSession, rows: DataFrame, cache: TextCache | None = None) -> DataFrame:
    """(path, mtime, size, text, error) of the files that rows (path, mtime, size) name, on executors that see them; missing ones have no row.

    With a cache, documents that it knows are neither opened nor parsed, and what was parsed is
    added to it; plain texts are always read.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for a in range(0, len(batch), FILES_AT_ONCE):
                part, found = batch.iloc[a : a + FILES_AT_ONCE], []
                for path in part.path:  # one file's bytes at a time; they don't leave the task
                    try:
                        with open(path, "rb") as f:
                            found.append((True, *text_or_error(path, f.read(MAX_FILE + 1))))
                    except OSError:
                        found.append((False, None, None))
                there, texts, errors = zip(*found)
                yield part[["path", "mtime", "size"]].assign(text=texts, error=errors)[list(there)]

    def opened(files: DataFrame) -> DataFrame:
        return files.mapInPandas(run, "path string, mtime long, size long, text string, error string")

    rows = rows.select("path", "mtime", "size")
    if cache is None:
        return opened(rows)
    return cache.texts(rows.where(is_extracted()), opened).unionByName(opened(rows.where(~is_extracted())))


def with_cache(files: DataFrame, cache: DataFrame | None, extract=extracted, *, cache_rows: int = CACHE_ROWS) -> tuple[DataFrame, DataFrame]:
    """(texts, next cache): results, errors too, are kept by (path, mtime, size), the latest ``cache_rows`` of them."""
    key = ["path", "mtime", "size"]
    hits = None if cache is None else cache.join(files.select(*key), key, "left_semi")
    fresh = extract(files if cache is None else files.join(cache.select(*key), key, "left_anti")).select(*key, "text", "error").withColumn("cached_at", F.current_timestamp())
    texts = fresh if hits is None else fresh.unionByName(hits.select(*fresh.columns))
    every = fresh if cache is None else fresh.unionByName(cache.select(*fresh.columns))
    return texts.drop("cached_at"), every.orderBy(F.desc("cached_at"), "path").limit(cache_rows)


class TextCache:
    """Extracted texts and errors by (path, mtime, size), in a versioned table that grows by what is new."""

    def __init__(self, spark: SparkSession, root: str, *, most: int = CACHE_ROWS):
        self.spark, self.store, self.most = spark, SnapshotStore(spark, root), most

    def texts(self, files: DataFrame, extract: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """(path, mtime, size, text, error); only files that the cache doesn't know are extracted, once, and kept."""
        key = ["path", "mtime", "size"]
        known, manifest = self.store.load(), self.store.current()
        todo = files if known is None else files.join(known.select(*key), key, "left_anti")
        fresh = self.spark.read.schema(CACHED).parquet(stored(extract(todo).select(*key, "text", "error").withColumn("cached_at", F.lit(time.time())), "extracted"))
        if not fresh.isEmpty():
            every = fresh if known is None else fresh.unionByName(known.select(*fresh.columns))
            # one row a key, the newest ones; if another writer was first, its version stands and these are extracted again some day
            every = every.dropDuplicates(key)
            over = every.count() > self.most
            self.store.publish(every.orderBy(F.desc("cached_at"), "path").limit(self.most) if over else every, expected=manifest["version"] if manifest else 0, ordered=False)
        hits = fresh.limit(0) if known is None else known.select(*fresh.columns).join(files.select(*key), key, "left_semi")
        return fresh.unionByName(hits).drop("cached_at")


def read_heads(spark: SparkSession, rows: DataFrame, *, most: int = HEAD_BYTES) -> DataFrame:
    """(path, head, binary, whole) of the files that rows (path) name: at most ``most`` bytes of each are read, whatever its size.

    A head with a NUL is binary and shows nothing; a character that the cut splits is left out,
    other bytes that aren't UTF-8 are replaced; ``whole`` tells whether the head is all there is.
    Folders and missing files have no row.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for path in batch.path:
                try:
                    with open(path, "rb", buffering=0) as f:
                        data = b""
                        while len(data) <= most and (more := f.read(most + 1 - len(data))):
                            data += more
                except OSError:
                    continue
                head, binary = data[:most], b"\0" in data[:most]
                text = None if binary else codecs.getincrementaldecoder("utf-8")("replace").decode(head, final=len(data) <= most)
                out.append((path, text, binary, len(data) <= most))
            yield pd.DataFrame(out, columns=["path", "head", "binary", "whole"]).astype({"binary": "bool", "whole": "bool"})

    return rows.select("path").mapInPandas(run, "path string, head string, binary boolean, whole boolean")


def is_extracted(path: str = "path"):
    return ascii_lower(extension(F.col(path))).isin(*EXTRACTORS)
