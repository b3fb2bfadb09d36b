"""Benchmark decontamination by winnowing.

A window is ``span`` consecutive words of an item (all of a shorter one).  Of the hashes of all
k-grams that lie in it, the smallest (of equal ones the last) is the window's fingerprint, so
equal windows have it at the same place: every shared span of ``span`` words has a fingerprint
in common, whatever surrounds it.  A document keeps its fingerprints that the benchmark has too,
and each of these hits is extended to the windows around it, which are compared word by word.
Shorter items have windows, k-grams and fingerprints of their own length.

Distinct windows of the benchmark go to the tasks in blocks of bounded size, a pass over the
documents each; hits that a pass finds travel beside the text.  Documents are never shuffled, only
what hits them: documents with the same hit windows share one list of items, made once.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import word_hash
from .shared import dropped, mapped, written

SPAN = 10
#: Windows whose index a task holds at once, and their bytes.
BLOCK_WINDOWS, BLOCK_BYTES = 250_000, 32 << 20
#: Bytes of texts that a task takes at once (longer texts come in pieces), and rows of a batch that are Python objects.
SLICE, ROWS = 1 << 20, 256
#: Bytes of window sets with their items' digests up to which they are broadcast.
SETS_BYTES = 16 << 20
WORD = re.compile(rb"[^ ]+")
#: Bytes outside words become spaces, A-Z small letters.
WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
STEP = np.uint64(0xC2B2AE3D27D4EB4F)


def gram_words(span: int) -> int:
    """Words of a k-gram; a window of ``span`` words holds span + 1 - k of them."""
    return (span + 1) // 2


@dataclass
class Words:
    """The words of texts laid end to end: bytes, where words begin and end, their hashes, the text of each, words before each text."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    text: np.ndarray
    first: np.ndarray


def words_of(texts: list[bytes]) -> Words:
    data = np.frombuffer(b" ".join(t.translate(WORDS) for t in texts) + b" ", dtype=np.uint8)
    starts, ends, hashes = word_hash.words(data)
    stops = np.cumsum([len(t) + 1 for t in texts])
    text = np.searchsorted(stops, starts, side="right")
    return Words(data, starts, ends, hashes, text, np.searchsorted(text, np.arange(len(texts) + 1)))


def range_sums(hashes: np.ndarray, count: int) -> np.ndarray:
    """A hash of every ``count`` consecutive ones, in their order."""
    with np.errstate(over="ignore"):
        out = np.zeros(max(0, len(hashes) - count + 1), dtype=np.uint64)
        for k in range(count):
            out = word_hash.mix(out * STEP + hashes[k : len(out) + k] + np.uint64(k))
        return out


def fingerprints(grams: np.ndarray, window: int) -> np.ndarray:
    """Where the smallest of every ``window`` consecutive hashes stands, the last one of equals."""
    n = max(0, len(grams) - window + 1)
    best, at = grams[:n].copy(), np.arange(n)
    for k in range(1, window):
        other = grams[k : n + k]
        low = other <= best
        best[low], at[low] = other[low], np.flatnonzero(low) + k
    return at


class Index:
    """The windows of one length in a block: their fingerprints' hashes, and hash, number and words of each."""

    def __init__(self, windows: list[bytes], numbers: np.ndarray, span: int):
        self.span, self.gram = span, gram_words(span)
        words = words_of(windows)
        found = range_sums(words.hashes, span)[words.first[:-1]] if windows else np.zeros(0, np.uint64)
        order = np.argsort(found, kind="stable")
        self.hashes, self.numbers = found[order], numbers[order]
        starts, ends = words.starts.reshape(-1, span), words.ends.reshape(-1, span)
        self.data, self.starts, self.ends = words.data, starts[order].astype(np.int32), ends[order].astype(np.int32)
        grams = range_sums(words.hashes, self.gram)
        per_window = grams[words.first[:-1, None] + np.arange(span + 1 - self.gram)[None]] if windows else np.zeros((0, 1), np.uint64)
        self.prints = np.unique(per_window.min(axis=1))

    def occurrences(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """(first word, window number) of every occurrence of a window within a text."""
        none = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if len(words.hashes) < self.span or not len(self.hashes):
            return none
        grams = range_sums(words.hashes, self.gram)
        at = fingerprints(grams, self.span + 1 - self.gram)
        kept = at[np.concatenate(([True], at[1:] != at[:-1]))]  # each fingerprint once: they never go back
        place = np.minimum(np.searchsorted(self.prints, grams[kept]), len(self.prints) - 1)
        hit = np.zeros(len(grams), dtype=bool)
        hit[kept[self.prints[place] == grams[kept]]] = True
        first = np.flatnonzero(hit[at])  # windows around the hits
        first = first[words.text[first] == words.text[first + self.span - 1]]
        if not len(first):
            return none
        with np.errstate(over="ignore"):
            found = np.zeros(len(first), dtype=np.uint64)
            for k in range(self.span):
                found = word_hash.mix(found * STEP + words.hashes[first + k] + np.uint64(k))
        low, high = np.searchsorted(self.hashes, found), np.searchsorted(self.hashes, found, side="right")
        # one candidate a window, more only where hashes of different windows collide
        pick = np.repeat(np.arange(len(first)), high - low)
        entry = np.arange(len(pick)) - np.repeat(np.cumsum(high - low) - (high - low), high - low) + low[pick]
        same = self._same(words, first[pick], entry)
        return first[pick][same], self.numbers[entry[same]]

    def _same(self, words: Words, first: np.ndarray, entry: np.ndarray) -> np.ndarray:
        """Whether the words are those of the entry, byte by byte."""
        good = np.ones(len(first), dtype=bool)
        for k in range(self.span):
            a, b = words.starts[first + k], self.starts[entry, k]
            size = words.ends[first + k] - a
            good &= size == self.ends[entry, k] - b
            here = np.flatnonzero(good)
            if not len(here):
                break
            size = size[here]
            base = np.cumsum(size) - size
            step = np.arange(int(size.sum())) - np.repeat(base, size)
            unlike = words.data[np.repeat(a[here], size) + step] != self.data[np.repeat(b[here], size) + step]
            good[here] = np.add.reduceat(unlike, base) == 0
        return good


def windows_of(benchmark: DataFrame, item_col: str, text_col: str, span: int) -> DataFrame:
    """(item, span, words): the windows of every item, words joined by spaces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()), strict=True):
                words = (text.as_py() or b"").translate(WORDS).split()
                size = min(span, len(words))
                for a in range(0, len(words) - size + 1 if size else 0, ROWS * ROWS):
                    part = [b" ".join(words[k : k + size]) for k in range(a, min(a + ROWS * ROWS, len(words) - size + 1))]
                    columns = [pa.array([item] * len(part), pa.string()), pa.array([size] * len(part), pa.int32()), pa.array(part, pa.binary())]
                    yield pa.RecordBatch.from_arrays(columns, names=["item", "span", "words"])

    rows = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(text_col).cast("string").alias("text"))
    return mapped(rows, run, "item string, span int, words binary").withColumn("words", F.col("words").cast("string"))


def pieces(text: bytes, span: int, size: int = SLICE) -> Iterator[tuple[bytes, int]]:
    """(bytes, how many of them are the piece's own): a text in pieces that end between words, each with the ``span`` - 1 words that follow it."""
    if len(text) <= size:
        yield text, len(text)
        return
    text, a = text.translate(WORDS), 0
    while a < len(text):
        b = text.find(b" ", a + size - 1)
        b = len(text) if b < 0 else b + 1
        after = [m.end() for m in islice(WORD.finditer(text, b), span - 1)]
        yield text[a : after[-1] if after else b], b - a
        a = b


def _slices(parts: list[tuple[int, bytes, int]]) -> Iterator[list[tuple[int, bytes, int]]]:
    a = 0
    while a < len(parts):
        b, size = a, 0
        while b < len(parts) and (b == a or size + len(parts[b][1]) < SLICE):
            size += len(parts[b][1]) + 1
            b += 1
        yield parts[a:b]
        a = b


def merged(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The union of ranges, as ranges apart from each other, in order."""
    order = np.argsort(starts, kind="stable")
    starts, reach = starts[order], np.maximum.accumulate(ends[order])
    new = np.concatenate(([True], starts[1:] > reach[:-1]))
    return starts[new], reach[np.concatenate((np.flatnonzero(new)[1:] - 1, [len(reach) - 1]))]


def looked_up(texts: list[bytes], indexes: list[Index]) -> tuple[list[int], dict[int, list[tuple[np.ndarray, np.ndarray, np.ndarray]]]]:
    """(words of each text, hits of each text that has any: first words, ends, window numbers)."""
    most = max(i.span for i in indexes)
    counts, hits = [0] * len(texts), {}
    for part in _slices([(k, *piece) for k, t in enumerate(texts) for piece in pieces(t, most)]):
        words = words_of([body for _, body, _ in part])
        begin = np.cumsum([0] + [len(body) + 1 for _, body, _ in part])[:-1]
        own = words.starts < (begin + [size for *_, size in part])[words.text]
        found = [i.occurrences(words) for i in indexes]
        first, number = (np.concatenate(x) for x in zip(*found))
        end = first + np.repeat([i.span for i in indexes], [len(x) for x, _ in found])
        text = words.text[first]
        hit = {int(k): np.flatnonzero((text == k) & own[first]) for k in np.unique(text)}
        for at, (k, *_) in enumerate(part):
            shift = counts[k] - words.first[at]
            if len(h := hit.get(at, ())):
                hits.setdefault(k, []).append((first[h] + shift, end[h] + shift, number[h]))
            counts[k] += int(own[words.first[at] : words.first[at + 1]].sum())
    return counts, hits


def passed(docs: DataFrame, indexes: list[Index], last: bool) -> DataFrame:
    """Documents after one block: their hit runs of words and hit windows grow; the last pass leaves the text behind."""
    shared = docs.sparkSession.sparkContext.broadcast(indexes)
    out = [c for c in docs.columns if not (last and c == "__text")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                batch = whole.slice(at, ROWS)
                counts, found = looked_up([t or b"" for t in batch.column("__text").cast(pa.binary()).to_pylist()], shared.value)
                runs, hits = (batch.column(c).to_pylist() for c in ("__runs", "__windows"))
                for k, parts in found.items():
                    first, end, number = map(np.concatenate, zip(*parts))
                    old = np.array(runs[k], dtype=np.int64).reshape(-1, 2)
                    runs[k] = np.stack(merged(np.concatenate((first, old[:, 0])), np.concatenate((end, old[:, 1]))), axis=1).ravel().tolist()
                    hits[k] = np.union1d(hits[k], number).astype(np.int64).tolist()
                lists = pa.list_(pa.int64())
                new = {"__n": pa.array(counts, pa.int64()), "__runs": pa.array(runs, lists), "__windows": pa.array(hits, lists)}
                yield pa.RecordBatch.from_arrays([new[c] if c in new else batch.column(c) for c in out], names=out)

    return mapped(docs, run, docs.select(*out).schema)


def marked(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", keep: list[str] = ("doc_id",), span: int = SPAN, block_windows: int = BLOCK_WINDOWS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``keep`` columns of every document with n_words, n_hit, runs, n_items, items_sha256, contaminated.

    ``runs`` lists the hit runs of words (first, end) in turn.  Null and empty texts have no
    words; null or wordless items have no windows.  Items with one id are one item, one without
    an id marks words but is not counted.  Repeated documents each get a row, an empty benchmark
    or table is no error, and other columns aren't read.
    """
    spark = docs.sparkSession
    windows = written(windows_of(benchmark, item_col, item_text, span), "windows")
    distinct = written(windows.groupBy("span", "words").agg(F.count(F.lit(1)).alias("uses")).select("span", "words", F.monotonically_increasing_id().alias("number")), "distinct-windows")
    count, size = distinct.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("words")), F.lit(0))).first()
    blocks = max(1, -(-count // block_windows), -(-size // block_bytes))
    hidden = [f"__keep{k}" for k in range(len(keep))]
    rows = docs.select(*(F.col(c).alias(h) for c, h in zip(keep, hidden)), F.col(text_col).cast("string").alias("__text"), F.lit(0).cast("long").alias("__n"), *(F.lit(None).cast("array<bigint>").alias(c) for c in ("__runs", "__windows")))
    rows = rows.withColumns({c: F.coalesce(c, F.array().cast("array<bigint>")) for c in ("__runs", "__windows")})
    before = None
    for k in range(blocks):
        own = distinct.where(F.pmod(F.xxhash64("words"), F.lit(blocks)) == k).toArrow()
        lengths, texts, numbers = own["span"].to_numpy(), own["words"].cast(pa.binary()).to_pylist(), own["number"].to_numpy()
        parts = [np.flatnonzero(lengths == s) for s in sorted({*lengths.tolist()} or {span})]
        indexes = [Index([texts[i] for i in p.tolist()], numbers[p], int(lengths[p[0]]) if len(p) else span) for p in parts]
        rows = written(passed(rows, indexes, k == blocks - 1), "hits")
        if before is not None:
            dropped(before)
        before = rows
    # one list of items for all documents with the same windows
    none = {"n_items": F.lit(0).cast("long"), "items_sha256": F.sha2(F.lit("").cast("binary"), 256)}
    clean, hit = rows.where(F.size("__windows") == 0), rows.where(F.size("__windows") > 0)
    sets = written(hit.select("__windows").distinct().withColumn("set", F.monotonically_increasing_id()), "window-sets")
    items = windows.where("item is not null").join(distinct, ["span", "words"]).select("number", "item").distinct()
    each = sets.select("set", F.explode("__windows").alias("number")).join(items, "number").select("set", "item").distinct()
    lists = each.groupBy("set").agg(F.array_sort(F.collect_list("item")).alias("items")).select("set", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"))
    lists = written(sets.join(lists, "set", "left").select("__windows", *(F.coalesce(c, v).alias(c) for c, v in none.items())), "window-items")
    size = lists.agg(F.sum(F.size("__windows") * 8 + 128)).first()[0] or 0
    found = hit.join(F.broadcast(lists) if size <= SETS_BYTES else lists, "__windows")
    out = found.unionByName(clean.withColumns(none))
    n_hit = F.aggregate(F.transform("__runs", lambda x, i: F.when(i % 2 == 0, -x).otherwise(x)), F.lit(0).cast("long"), lambda total, x: total + x)
    return out.select(*(F.col(h).alias(c) for h, c in zip(hidden, keep)), F.col("__n").alias("n_words"), n_hit.alias("n_hit"), "n_items", "items_sha256", (F.size("__runs") > 0).alias("contaminated"), F.col("__runs").alias("runs"))
