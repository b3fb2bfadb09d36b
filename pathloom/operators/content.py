"""Line search in texts: natively exploded lines, per-file cap, smart case."""

from __future__ import annotations

import re
import time
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..functions.columns import ascii_lower, extension, is_dir
from ..request import Filters, java_pattern
from ..sources.scratch import stored
from .predicates import scoped
from .rank import index_order

CONTENT_LIMIT, PER_FILE, MAX_BYTES, HEAD_BYTES = 1000, 20, 2 << 20, 64 << 10
#: Shares of the files after which a search with a limit looks whether it has enough.
SHARES = (1 / 64, 1 / 16, 1 / 4)
EXTRACTED = ("pdf", "docx", "xlsx")


def searchable(texts: DataFrame, max_bytes: int = MAX_BYTES) -> DataFrame:
    """Regular files within the size bound (documents whose text was extracted are exempt) without a NUL in their head; a later NUL ends their text."""
    small = (F.col("size") <= max_bytes) | ascii_lower(extension(F.col("path"))).isin(*EXTRACTED)
    fit = texts.where(~is_dir(F.col("path")) & small & F.col("text").isNotNull() & (F.locate("\0", F.substring("text", 1, HEAD_BYTES)) == 0))
    return fit.withColumn("text", F.substring_index("text", "\0", 1))


def whole_text_pattern(found: str) -> str | None:
    """A pattern that every text holding a matching line matches; None where that can't be told from the pattern."""
    flags = re.match(r"\(\?([a-zA-Z]+)\)|", found)
    rest = found[flags.end() :]
    return None if re.search(r"\(\?|\\[Az]|[*+?}]\+", rest) else f"(?{flags[1] or ''}m){rest}"


def _hits(texts: DataFrame, pattern: str, filters: Filters, per_file: int, max_bytes: int) -> DataFrame:
    """The other columns, line_number, line of matching lines, the first ``per_file`` of a file, in no order.

    Files are filtered before their texts are read, whole texts by the pattern (where it
    allows that) before they are split, and the cap cuts the array in place: no shuffle.
    """
    found = java_pattern(pattern)
    rows = searchable(scoped(texts, filters, always=False), max_bytes).where("text <> ''")  # no line in an empty text
    if whole := whole_text_pattern(found):
        ends = F.contains("text", F.lit("\r")) if "$" in found else F.lit(False)  # carriage returns go before lines are matched
        rows = rows.where(F.col("text").rlike(whole) | ends)
    body = F.when(F.endswith("text", F.lit("\n")), F.substring("text", F.lit(1), F.char_length("text") - 1)).otherwise(F.col("text"))
    body = F.when(F.contains(body, F.lit("\r")), F.regexp_replace(body, r"\r(?=\n|\z)", "")).otherwise(body)
    lines = F.transform(F.split(body, "\n"), lambda x, i: F.struct((i + 1).cast("long").alias("line_number"), x.alias("line")))
    hits = F.slice(F.filter(lines, lambda x: x.line.rlike(found)), 1, per_file)
    out = rows.select(*[c for c in rows.columns if c != "text"], F.explode(hits).alias("hit"))
    return out.select(*[c for c in rows.columns if c != "text"], F.col("hit.line_number").alias("line_number"), F.regexp_replace("hit.line", r"\s+$", "").alias("line"))


def grep(texts: DataFrame, pattern: str, filters: Filters = Filters(), *, per_file: int = PER_FILE, limit: int | None = None, max_bytes: int = MAX_BYTES) -> DataFrame:
    """(path, line_number, line) of matching lines, the first ``per_file`` of a file, in index order; with ``limit`` the first ones, found piece by piece."""
    if limit is not None:
        pieces = list(first_hits(texts, pattern, filters, per_file=per_file, limit=limit, max_bytes=max_bytes))
        return reduce(DataFrame.unionByName, (p.rows for p in pieces)).orderBy("place").select("path", "line_number", "line")
    found = _hits(texts, pattern, filters, per_file, max_bytes)
    # written before they are put in order: a range sort samples its input first, which would search all texts twice
    out = texts.sparkSession.read.schema(found.schema).parquet(stored(found, "hits"))
    return out.orderBy(*index_order(out), "line_number").select("path", "line_number", "line")


@dataclass
class Piece:
    """Hits of one stretch of the index (path, line_number, line, place), and how far the search is."""

    rows: DataFrame
    hits: int
    files_read: int
    files: int
    seconds: float


def _stretches(rows: DataFrame, shares: tuple[float, ...]) -> tuple[list[Column], int]:
    """Conditions that cut the index in stretches, first ones first, each a plain range of one column that scans can skip by; and the number of files."""
    by, ahead = ("ord", "<=") if "ord" in rows.columns else ("mtime", ">=")
    at = list(shares) if by == "ord" else [1 - s for s in shares]
    facts = rows.agg(F.percentile_approx(by, at, 1000).alias("at"), F.count(F.lit(1)).alias("n")).first()
    edges = sorted(set(facts.at or []), reverse=by == "mtime")
    out, done = [], F.lit(True)
    for edge in edges:
        out.append(done & F.expr(f"{by} {ahead} {edge}"))
        done = F.expr(f"{by} {'>' if ahead == '<=' else '<'} {edge}")
    return [*out, done | F.col(by).isNull()], facts.n


def first_hits(texts: DataFrame, pattern: str, filters: Filters = Filters(), *, per_file: int = PER_FILE, limit: int = CONTENT_LIMIT, max_bytes: int = MAX_BYTES, shares: tuple[float, ...] = SHARES) -> Iterator[Piece]:
    """The first ``limit`` hits in index order, piece by piece.

    The index is read in stretches, small ones first, and the search ends with the stretch that
    fills the limit: a common word costs a small share of the texts, a rare one a few jobs
    more.  Every piece is written once before it is handed out, so what a reader has seen
    stays.  A caller that stops asking starts no further job.
    """
    spark, began = texts.sparkSession, time.monotonic()
    stretches, files = _stretches(scoped(texts, filters, always=False).select(*(c for c in ("ord", "mtime") if c in texts.columns)), shares)
    hits = read = 0
    for stretch in stretches:
        seen = Observation()
        rows = _hits(texts.where(stretch).observe(seen, F.count(F.lit(1)).alias("files")), pattern, filters, per_file, max_bytes)
        order = [*index_order(rows), F.col("line_number")]
        best = rows.orderBy(*order).limit(limit - hits)
        best = best.select("path", "line_number", "line", (F.row_number().over(Window.orderBy(*order)) + hits).cast("long").alias("place"))
        piece = spark.read.schema(best.schema).parquet(stored(best, "hits"))
        hits, read = hits + piece.count(), read + seen.get["files"]
        yield Piece(piece, hits, read, files, time.monotonic() - began)
        if hits >= limit:
            return


def line_numbers(texts: DataFrame) -> DataFrame:
    """(path, line_number, line) of every line; a final line break opens no line."""
    rows = texts.select("path", F.posexplode(F.split(F.regexp_replace("text", r"\n\z", ""), "\n")).alias("at", "line"))
    return rows.select("path", (F.col("at") + 1).cast("long").alias("line_number"), "line")
