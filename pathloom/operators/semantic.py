"""Semantic search: chunks, embedders, incremental builds, best chunk a document."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import ascii_lower, extension, is_dir, percent_label, snippet
from ..request import Filters
from .predicates import scoped

SEMANTIC_LIMIT, OVERFETCH, SNIPPETS = 100, 4, 24
CHUNK_CHARS, OVERLAP, MAX_CHUNKS, EMBED_BATCH, HASH_DIM, MAX_BYTES = 1000, 200, 256, 64, 64, 4 << 20
# Extensions that are embedded.
EXTENSIONS = "md txt org rst tex html htm markdown pdf docx xlsx".split()
CHUNK_TYPE = "array<struct<chunk_ix:int,line_start:int,text:string>>"


class Embedder(Protocol):
    """The one pluggable function: texts to vectors of one dimension."""

    dim: int

    def embed(self, texts: list[str]) -> np.ndarray: ...


def model_embedder() -> Embedder:
    raise RuntimeError("no embedding model is installed; pass an embedder")


def eligible() -> Column:
    return ascii_lower(extension(F.col("path"))).isin(*EXTENSIONS) & ~is_dir(F.col("path")) & (F.col("size") <= MAX_BYTES)


def cut_chunks(text: str, target: int = CHUNK_CHARS, overlap: int = OVERLAP) -> list[tuple[int, str]]:
    """(first line, text) of overlapping windows that end after a line break where the last quarter has one; blank ones are left out."""
    if target <= 0 or not text:
        return []
    lines = [m.end() for m in re.finditer("\n", text)]  # where lines begin, but for the first

    def end_of(start: int) -> int:
        if start + target >= len(text):
            return len(text)
        whole = bisect_right(lines, start + target)
        return lines[whole - 1] if whole and lines[whole - 1] > start + target * 3 // 4 else start + target

    windows = [(0, end_of(0))]
    while windows[-1][1] < len(text):
        start = max(windows[-1][1] - overlap, windows[-1][0] + 1)
        windows.append((start, end_of(start)))
    return [(1 + bisect_right(lines, a), text[a:b]) for a, b in windows if text[a:b].strip()]


def kept_chunks(count: int, most: int = MAX_CHUNKS) -> list[int]:
    """Evenly spread indices, first and last included."""
    return list(range(count)) if count <= most else [k * (count - 1) // (most - 1) for k in range(most)]


def sampled(chunks: DataFrame, most: int = MAX_CHUNKS, doc: str = "path") -> DataFrame:
    """The chunks of each document that ``kept_chunks`` names, by expressions on its chunk count."""
    counts = chunks.groupBy(doc).agg((F.max("chunk_ix") + 1).cast("long").alias("n_chunks"))
    rows = chunks.join(counts, doc)
    k = F.ceil(F.col("chunk_ix") * (most - 1) / (F.col("n_chunks") - 1))
    return rows.where((F.col("n_chunks") <= most) | (F.floor(k * (F.col("n_chunks") - 1) / (most - 1)) == F.col("chunk_ix"))).drop("n_chunks")


def chunked(texts: DataFrame, *, target: int = CHUNK_CHARS, overlap: int = OVERLAP, most: int = MAX_CHUNKS) -> DataFrame:
    """(the other columns, chunk_ix, line_start, text) of every chunk kept."""

    @F.pandas_udf(CHUNK_TYPE)
    def cut(bodies: pd.Series) -> pd.Series:
        out = []
        for body in bodies:
            found = cut_chunks(body or "", target, overlap)
            out.append([{"chunk_ix": k, "line_start": found[k][0], "text": found[k][1]} for k in kept_chunks(len(found), most)])
        return pd.Series(out)

    rest = [c for c in texts.columns if c != "text"]
    return texts.withColumn("c", F.explode(cut("text"))).select(*rest, "c.chunk_ix", "c.line_start", "c.text")


def _once(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is worked out once, however often ``then`` names it, inner functions included."""
    return F.transform(F.array(value), then)[0]


def hash_vector(text: Column, dim: int = HASH_DIM) -> Column:
    """Unit vector of word counts by hash, natively; a text is split and hashed once."""
    words = F.filter(F.split(ascii_lower(text), r"\s+"), lambda w: w != "")
    slots = F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(dim)))
    places = F.sequence(F.lit(0).cast("long"), F.lit(dim - 1).cast("long"))
    counts = _once(slots, lambda s: F.transform(places, lambda k: (F.size(s) - F.size(F.array_remove(s, k))).cast("double")))
    norm = lambda c: F.sqrt(F.aggregate(c, F.lit(0.0), lambda a, x: a + x * x))
    return _once(counts, lambda c: _once(norm(c), lambda n: F.transform(c, lambda x: F.when(n > 0, x / n).otherwise(0.0))))


def quantised(rows: DataFrame, column: str = "vec") -> DataFrame:
    """Vectors rounded to half precision, as they are stored; a batch's numbers at once."""

    def halved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = batch.column(column)
            with np.errstate(over="ignore"):
                values = pa.array(vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float16).astype(np.float32))
            ends = np.concatenate(([0], np.cumsum(vectors.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)))).astype(np.int32)
            rounded = pa.ListArray.from_arrays(pa.array(ends), values, mask=vectors.is_null())
            yield batch.set_column(batch.schema.get_field_index(column), column, rounded)

    fields = ", ".join(f"`{f.name}` {'array<float>' if f.name == column else f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(halved, fields)


def embedded(chunks: DataFrame, embedder: Embedder | None = None) -> DataFrame:
    """Adds ``vec``; without an embedder, the native hash one."""
    if embedder is None:
        return quantised(chunks.withColumn("vec", hash_vector(F.col("text"))))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for a in range(0, len(batch), EMBED_BATCH):
                part = batch.iloc[a : a + EMBED_BATCH]
                vectors = np.asarray(embedder.embed(part.text.tolist())).astype(np.float16).astype(np.float32)
                yield part.assign(vec=list(vectors))

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chunks.schema)
    return chunks.mapInPandas(run, f"{fields}, vec array<float>")


def split_for_build(files: DataFrame, prior: DataFrame) -> DataFrame:
    """Files with ``status``: reused if the prior build has them with equal time and size, else embedded."""
    known = prior.select("path", "mtime", "size").distinct().withColumn("known", F.lit(True))
    return files.join(known, ["path", "mtime", "size"], "left").withColumn("status", F.when(F.col("known"), "reused").otherwise("embedded")).drop("known")


def built(texts: DataFrame, prior: DataFrame | None = None, *, embedder: Embedder | None = None) -> tuple[DataFrame, DataFrame]:
    """(chunks with vectors, counts by status) of ``texts`` (path, mtime, size, text); unreadable or empty texts are skipped."""
    key = ["path", "mtime", "size"]
    files = texts.where(eligible())
    old = files.select(*key).join(prior, key, "left_semi") if prior is not None else files.select(*key).limit(0)
    todo = files.join(old, key, "left_anti")
    fresh = embedded(chunked(todo), embedder).drop("text")
    rows = fresh if prior is None else fresh.unionByName(prior.join(old, key, "left_semi").select(*fresh.columns))
    status = files.join(old.withColumn("known", F.lit(True)), key, "left").select(F.when(F.col("known"), "reused").when(~F.coalesce(F.col("text").rlike(r"[^\s\x1c-\x1f\x85\p{Z}]"), F.lit(False)), "skipped").otherwise("embedded").alias("status"))
    return rows, status.groupBy("status").count()


def similarity(vec: Column, query: list[float]) -> Column:
    q = F.array(*map(F.lit, query))
    return F.aggregate(F.zip_with(vec, q, lambda a, b: a.cast("double") * b), F.lit(0.0), lambda a, x: a + x)


def best_chunks(chunks: DataFrame, query: list[float], doc: str = "path") -> DataFrame:
    """(doc, line_start, score): each document's best chunk, the first of equal ones; vectors of another size give nothing."""
    rows = chunks.where(F.size("vec") == len(query)).withColumn("score", similarity(F.col("vec"), query))
    rows = rows.where(~F.isnan("score") & (F.abs("score") < float("inf")))
    best = F.max_by(F.struct("line_start", "score"), F.struct("score", -F.col("chunk_ix")))
    return rows.groupBy(doc).agg(best.alias("b")).select(doc, "b.line_start", "b.score")


def semantic_search(chunks: DataFrame, query: list[float], filters: Filters = Filters(), *, files: DataFrame | None = None, limit: int = SEMANTIC_LIMIT, prefilter: bool = False, doc: str = "path", order: list[Column] | None = None) -> DataFrame:
    """Ranked documents.  Filters apply after four times the limit was fetched, or with ``prefilter`` before."""
    found = best_chunks(chunks, query, doc)
    by = [F.desc("score"), *(order or [F.col(doc)])]
    if not filters.is_empty():
        if files is not None:
            found = found.join(files, doc)
        found = scoped(found, filters) if prefilter else scoped(found.orderBy(*by).limit(limit * OVERFETCH), filters)
    return found.orderBy(*by).limit(limit).withColumn("rank", F.row_number().over(Window.orderBy(*by)).cast("long"))


def labelled(ranked: DataFrame, texts: DataFrame | None = None) -> DataFrame:
    """Adds ``label``: a snippet for the first rows, else how near the row is."""
    label = percent_label(F.col("score"))
    if texts is None:
        return ranked.withColumn("label", label)
    rows = ranked.join(texts.select("path", "text"), "path", "left")
    return rows.withColumn("label", F.when(F.col("rank") <= SNIPPETS, F.coalesce(snippet(F.col("text"), F.col("line_start")), label)).otherwise(label)).drop("text")
