"""Removal of byte strings that a corpus holds earlier, by anchors and hash-compared suffix sorts.

A byte goes if a string of ``span`` bytes that covers it also starts earlier.  To compare all
positions of a corpus would move many times its size, so three passes narrow them:

1. Anchors.  Of the short grams in every window of ``span`` bytes the one with the least hash
   is an anchor, so equal windows hold equal anchors at equal places.  Some 4 % of positions
   are anchors; each travels with hashes of its gram and of all bytes that windows around it
   can reach (its context).
2. Of occurrences of a gram with equal contexts (126 bits: the gram's hash, and one of the
   context by prime moduli, so that no pattern of bytes collides by structure), all but the
   first are covered whole.  First occurrences of different contexts of one gram may still share some windows: contenders.
3. Contenders bring their context bytes together by gram.  Suffixes that begin at the anchor,
   and reversed ones that end before it, are sorted by hash comparisons; neighbours' common
   extensions split them into classes for every reach, and a window is a repeat if its pair
   of classes has an earlier member.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import word_hash
from .shared import dropped, freed, mapped, small, written
from .suffix_sort import sorted_strings

SPAN, GRAM = 100, 40
#: Bytes of text taken at once, rows of a batch that are Python objects at once, anchors sorted together, and anchors of a bucket, some of which a task reduces one after the other.
PIECE, ROWS, CHUNK, BUCKET, TASK_BUCKETS = 512 << 10, 256, 400_000, 120_000, 8
#: Contenders of one gram above which its windows are grouped one by one in an exchange of their own.
HOT_GRAM = 50_000
#: Contenders of whole grams that are compared at once.
SORTED_ROWS = 15_000
#: Bytes of all documents' runs, as packed, up to which these are broadcast to the texts instead of shuffling the texts.
BROADCAST_BYTES = 32 << 20

ANCHOR = np.dtype([("gram", "<u8"), ("context", "<u8"), ("row", "<i8"), ("pos", "<i4")])
SPOT = np.dtype([("pos", "<i4"), ("gram", "<i8")])
RUN = np.dtype([("row", "<i8"), ("start", "<i4"), ("end", "<i4")])


def _sliding(values: np.ndarray, width: int, pick: np.ufunc, fill: int) -> np.ndarray:
    """The pick (minimum or maximum) of every ``width`` neighbours, from running picks of blocks in both directions."""
    n = len(values)
    blocks = np.append(values, np.full(-n % width, fill, dtype=values.dtype)).reshape(-1, width)
    ahead = pick.accumulate(blocks, axis=1).ravel()
    back = pick.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return pick(back[: n - width + 1], ahead[width - 1 : n])


def anchors(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, span: int = SPAN, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(positions, gram hashes, context hashes) of the anchors of the texts data[starts:ends]."""
    n, reach, width = len(data), span - gram, span - gram + 1
    none = np.zeros(0, dtype=np.int64), *[np.zeros(0, dtype=np.uint64)] * 2
    if n < span:
        return none
    prefix = word_hash.prefix_hashes(data)
    at = np.arange(n - gram + 1)
    h = word_hash.range_hashes(prefix, at, at + gram)
    crossing = np.zeros(n - gram + 1, dtype=bool)
    for k in range(1, gram):  # grams that reach over the end of their text
        crossing[np.maximum(0, ends[ends - k < len(crossing)] - k)] = True
    top = np.iinfo(np.uint64).max
    h[crossing] = top
    if len(h) < width:
        return none
    least = _sliding(h, width, np.minimum, top)
    edge = np.zeros(width - 1, dtype=np.uint64)
    chosen = np.flatnonzero((_sliding(np.concatenate((edge, least, edge)), width, np.maximum, 0) == h) & ~crossing)
    text = np.searchsorted(starts, chosen, side="right") - 1
    low, high = np.maximum(starts[text], chosen - reach), np.minimum(ends[text], chosen + span)
    with np.errstate(over="ignore"):  # the same bytes with the anchor at another place are another context
        return chosen, h[chosen], word_hash.mix(word_hash.prime_hashes(data, low, high) + (chosen - low).astype(np.uint64) * word_hash.BASE)


def _pieces(texts: list[bytes], span: int) -> Iterator[tuple[list[int], list[int], list[int], list[int], bytes]]:
    """Texts joined to some MB; a longer text comes in pieces that overlap by what windows can reach.

    Gives (index of text, offset of piece, first and last kept position of piece, bytes).
    """
    margin = 2 * span
    held: tuple = ([], [], [], [], [])
    size = 0
    for k, text in enumerate(texts):
        if len(text) < span:
            continue
        for a in range(0, len(text), PIECE):
            b = min(len(text), a + PIECE)
            low, high = max(0, a - margin), min(len(text), b + margin)
            for into, value in zip(held, (k, low, a - low, b - low, text[low:high]), strict=True):
                into.append(value)
            size += high - low
            if size >= PIECE:
                yield (*held[:4], held[4])
                held, size = ([], [], [], [], []), 0
    if held[0]:
        yield (*held[:4], held[4])


def _merged_runs(rows: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Maximal runs of the given ones, by row."""
    order = np.lexsort((starts, rows))
    rows, starts, ends = rows[order], starts[order], ends[order]
    if not len(rows):
        return np.zeros(0, dtype=RUN)
    new_row = np.concatenate(([True], rows[1:] != rows[:-1]))
    shift = (np.cumsum(new_row) - 1) * (np.int64(1) << 33)  # rows side by side on one line
    reach = np.maximum.accumulate(ends + shift)
    head = np.concatenate(([True], (starts + shift)[1:] > reach[:-1]))
    at = np.flatnonzero(head)
    out = np.empty(len(at), dtype=RUN)
    out["row"], out["start"] = rows[at], starts[at]
    out["end"] = np.maximum.reduceat(ends, at)
    return out


def _frame(columns: list, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


FOUND = pa.schema([("contender", pa.bool_()), ("row", pa.int64()), ("start", pa.int32()), ("end", pa.int32()), ("gram", pa.int64())])
FOUND_SQL = "contender boolean, row long, start int, end int, gram long"


def _runs_frame(runs: np.ndarray) -> pa.RecordBatch:
    n = len(runs)
    return _frame([np.zeros(n, dtype=bool), runs["row"].copy(), runs["start"].copy(), runs["end"].copy(), np.zeros(n, dtype=np.int64)], FOUND)


def _covered(rows: np.ndarray, span: int, gram: int) -> np.ndarray:
    """Runs of all windows around the anchors ``rows``; ends may pass their texts'."""
    pos = rows["pos"].astype(np.int64)
    return _merged_runs(rows["row"], np.maximum(0, pos - (span - gram)), pos + span)


def ordered(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchors by gram, context and place; whether each is the first of its gram, and of its context."""
    rows = rows[np.lexsort((rows["pos"], rows["row"], rows["context"], rows["gram"]))]
    new_gram = np.concatenate(([True], rows["gram"][1:] != rows["gram"][:-1]))
    return rows, new_gram, new_gram | np.concatenate(([True], rows["context"][1:] != rows["context"][:-1]))


def anchor_findings(table: DataFrame, buckets: int, span: int, gram: int) -> DataFrame:
    """Passes 1 and 2: covered runs, and contenders with their gram."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        count, turn = 0, 0

        def emit() -> pa.RecordBatch:
            nonlocal turn
            rows = np.concatenate(held)
            rows, _, first = ordered(rows)
            runs = _covered(rows[~first], span, gram)
            rows = rows[first]  # one a chunk for each context, however often it occurs
            bucket = (rows["gram"] % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
            turn += 1
            out = [(k, False, rows[order[a:b]].tobytes()) for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])) if b > a]
            out += [((turn * 7919 + k) % buckets, True, runs[k : k + 200_000].tobytes()) for k in range(0, len(runs), 200_000)]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int32(), pa.bool_(), pa.binary()), strict=True)], names=["bucket", "done", "rows"])

        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                ids = batch.column(0).slice(at, ROWS).to_numpy()
                texts = [(t or "").encode() for t in batch.column(1).slice(at, ROWS).to_pylist()]
                for text, offset, low, high, parts in _pieces(texts, span):
                    sizes = np.array([len(p) for p in parts], dtype=np.int64)
                    ends = np.cumsum(sizes)
                    starts = ends - sizes
                    pos, *hashes = anchors(np.frombuffer(b"".join(parts), dtype=np.uint8), starts, ends, span, gram)
                    of = np.searchsorted(starts, pos, side="right") - 1
                    inside = pos - starts[of]
                    keep = (inside >= np.array(low)[of]) & (inside < np.array(high)[of])
                    rows = np.empty(int(keep.sum()), dtype=ANCHOR)
                    for name, values in zip(("gram", "context"), hashes, strict=True):
                        rows[name] = values[keep]
                    rows["row"] = ids[np.array(text)[of[keep]]]
                    rows["pos"] = (inside + np.array(offset)[of])[keep]
                    held.append(rows)
                    count += len(rows)
                    if count >= CHUNK:
                        yield emit()
                        held, count = [], 0
        if count:
            yield emit()

    def joined(held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        rows, new_gram, first = ordered(np.concatenate(held))
        yield _runs_frame(_covered(rows[~first], span, gram))
        group = np.cumsum(new_gram) - 1
        contexts = np.bincount(group, weights=first)
        rows = rows[first & (contexts[group] > 1)]  # a gram of one context has no contenders
        for a in range(0, len(rows), 200_000):
            x = rows[a : a + 200_000]
            yield _frame([np.ones(len(x), dtype=bool), x["row"].copy(), x["pos"].copy(), x["pos"].copy(), x["gram"].copy().view(np.int64)], FOUND)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, held = None, []
        for batch in batches:
            for key, done, rows in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                if key != bucket and held:
                    yield from joined(held)
                    held = []
                bucket = key
                if done:
                    yield _runs_frame(np.frombuffer(rows.as_buffer(), dtype=RUN))
                else:
                    held.append(np.frombuffer(rows.as_py(), dtype=ANCHOR))
        if held:
            yield from joined(held)

    parts = mapped(table, part, "bucket int, done boolean, rows binary").repartition(max(8, -(-buckets // TASK_BUCKETS)), "bucket")
    return mapped(parts.sortWithinPartitions("bucket"), meet, FOUND_SQL)


def _context_type(span: int, gram: int) -> np.dtype:
    reach = span - gram
    return np.dtype([("gram", "<u8"), ("row", "<i8"), ("pos", "<i4"), ("left", "u1"), ("right", "u1"), ("before", "u1", (reach,)), ("after", "u1", (span,))])


def repeated_windows(rows: np.ndarray, span: int, gram: int) -> np.ndarray:
    """Pass 3: runs covered by windows that an earlier one of the given contenders also has.

    ``before`` holds the bytes ahead of the anchor, nearest first; ``after`` those from its
    first byte on.
    """
    reach = span - gram
    rows = rows[np.lexsort((rows["pos"], rows["row"], rows["gram"]))]
    n = len(rows)
    if n < 2:
        return np.zeros(0, dtype=RUN)
    classes = []
    for field, sizes, most in (("before", rows["left"].astype(np.int64), reach), ("after", rows["right"].astype(np.int64), span)):
        order, common = sorted_strings(rows["gram"], np.ascontiguousarray(rows[field]).reshape(-1), np.arange(n, dtype=np.int64) * most, sizes)
        classes.append((order, common, sizes))
    rank = np.arange(n)  # rows stand in the order of their places within each gram
    repeat = np.zeros((reach + 1, n), dtype=bool)
    sides = []
    for order, common, sizes in classes:
        def at_depth(depth: int, order=order, common=common) -> np.ndarray:
            out = np.empty(n, dtype=np.int64)
            out[order] = np.cumsum(common < depth)
            return out
        sides.append((at_depth, sizes))
    for a in range(reach + 1):
        exists = np.flatnonzero((sides[0][1] >= a) & (sides[1][1] >= span - a))
        # depth 0 still tells grams apart: a group's first has -1
        key = sides[0][0](a)[exists] * (n + 1) + sides[1][0](span - a)[exists]
        _, first, inverse = np.unique(key, return_index=True, return_inverse=True)
        repeat[a, exists] = rank[exists] > rank[exists][first][inverse]
    # maximal runs of neighbouring window starts
    turned = np.pad(repeat, ((1, 1), (0, 0))).astype(np.int8)
    change = np.diff(turned, axis=0).T
    item, begin = np.nonzero(change == 1)
    _, end = np.nonzero(change == -1)
    pos = rows["pos"].astype(np.int64)[item]
    return _merged_runs(rows["row"][item], pos - (end - 1), pos - begin + span)


def _contexts(text: bytes, positions: np.ndarray, grams: np.ndarray, row: int, kind: np.dtype, span: int, gram: int) -> np.ndarray:
    reach = span - gram
    data = np.frombuffer(b"\0" * reach + text + b"\0" * span, dtype=np.uint8)
    out = np.empty(len(positions), dtype=kind)
    out["gram"], out["row"], out["pos"] = grams, row, positions
    out["left"], out["right"] = np.minimum(positions, reach), np.minimum(len(text) - positions, span)
    out["before"] = data[(positions + reach - 1)[:, None] - np.arange(reach)]
    out["after"] = data[(positions + reach)[:, None] + np.arange(span)]
    return out


def contender_runs(texts: DataFrame, buckets: int, span: int, gram: int) -> DataFrame:
    """Covered runs of contenders; ``texts`` holds row, text and spots (pos, gram)."""
    kind = _context_type(span, gram)

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        count = 0

        def emit() -> pa.RecordBatch:
            rows = np.concatenate(held)
            bucket = (word_hash.mix(rows["gram"]) % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
            out = [(k, rows[order[a:b]].tobytes()) for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])) if b > a]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int32(), pa.binary()), strict=True)], names=["bucket", "rows"])

        for batch in batches:
            for row, text, spots in zip(*(batch.column(k) for k in range(3)), strict=True):
                found = np.frombuffer(spots.as_buffer(), dtype=SPOT)
                rows = _contexts((text.as_py() or "").encode(), found["pos"].astype(np.int64), found["gram"].astype(np.uint64), row.as_py(), kind, span, gram)
                held.append(rows)
                count += len(rows)
                if count >= 100_000:
                    yield emit()
                    held, count = [], 0
        if count:
            yield emit()

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.frombuffer(x.as_py(), dtype=kind) for batch in batches for x in batch.column(1)]
        if held:
            rows = np.concatenate(held)
            held.clear()
            rows = rows[np.argsort(rows["gram"], kind="stable")]
            edges = np.flatnonzero(np.concatenate(([True], rows["gram"][1:] != rows["gram"][:-1], [True])))
            a = 0
            while a < len(edges) - 1:  # whole grams, some ten thousand rows at a time
                b = max(a + 1, int(np.searchsorted(edges, edges[a] + SORTED_ROWS, side="right")) - 1)
                yield _runs_frame(repeated_windows(rows[edges[a] : edges[b]], span, gram))
                a = b

    return mapped(mapped(texts, part, "bucket int, rows binary").repartition(buckets, "bucket"), meet, FOUND_SQL)


def hot_runs(texts: DataFrame, span: int, gram: int) -> DataFrame:
    """The same for grams with very many contenders: one row a window, whose first place is found by an aggregate."""
    reach = span - gram
    kind = _context_type(span, gram)
    schema = pa.schema([("window", pa.binary()), ("row", pa.int64()), ("start", pa.int32())])

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, text, spots in zip(*(batch.column(k) for k in range(3)), strict=True):
                body, found = (text.as_py() or "").encode(), np.frombuffer(spots.as_buffer(), dtype=SPOT)["pos"]
                starts = np.unique(np.concatenate([np.arange(max(0, p - reach), min(p, len(body) - span) + 1) for p in found.tolist()]))
                windows = [hashlib.blake2b(body[s : s + span], digest_size=16).digest() for s in starts.tolist()]
                yield _frame([windows, np.full(len(starts), row.as_py()), starts.astype(np.int32)], schema)

    windows = written(mapped(texts, part, "window binary, row long, start int"), "windows")
    least = windows.groupBy("window").agg(F.min("row").alias("first_row"), F.count(F.lit(1)).alias("times")).where("times > 1")
    at = windows.join(least, "window")
    start = at.where("row = first_row").groupBy("window").agg(F.min("start").alias("first_start"))
    later = at.join(start, "window").where("row > first_row or start > first_start")
    return later.select(F.lit(False).alias("contender"), "row", "start", (F.col("start") + span).cast("int").alias("end"), F.lit(0).cast("long").alias("gram"))


def _numbered(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame | None]:
    """(doc_id, row, text) with unique rows in the order of ids; ids themselves where they are unique longs."""
    id_type = docs.schema[id_col].dataType.simpleString()
    table = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    if id_type in ("bigint", "int"):
        ids = table.groupBy("doc_id").count()
        if not ids.where("count > 1 or doc_id is null").take(1):
            return table.withColumn("row", F.col("doc_id").cast("long")), None
    ordered = table.orderBy(F.col("doc_id").asc_nulls_last(), F.col("text").asc_nulls_first())
    held = written(ordered.withColumn("row", F.monotonically_increasing_id()), "numbered")
    return held, held


def _packed_spots(contenders: DataFrame) -> DataFrame:
    """(row, packed): places and grams of each row's contenders as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = []
            for spots in batch.column(1):
                rows = np.empty(len(spots.values), dtype=SPOT)
                rows["pos"], rows["gram"] = spots.values.field(0).to_numpy(), spots.values.field(1).to_numpy()
                packed.append(rows.tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(packed, pa.binary())], names=["row", "packed"])

    return mapped(contenders.groupBy("row").agg(F.collect_list(F.struct(F.col("start").alias("pos"), "gram"))), run, "row long, packed binary")


def _packed_runs(runs: DataFrame) -> DataFrame:
    """(row, packed): each row's maximal runs as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = []
            for found in batch.column(1):
                start, end = (found.values.field(k).to_numpy().astype(np.int64) for k in (0, 1))
                whole = _merged_runs(np.zeros(len(start), dtype=np.int64), start, end)
                packed.append(np.stack((whole["start"], whole["end"]), axis=1).astype("<i4").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(packed, pa.binary())], names=["row", "packed"])

    return mapped(runs.groupBy("row").agg(F.collect_list(F.struct("start", "end"))), run, "row long, packed binary")


def _with_runs(table: DataFrame, per_row: DataFrame, how: str) -> DataFrame:
    """Texts joined with the packed runs of a written table, which are broadcast if all their bytes are few."""
    total = per_row.agg(F.coalesce(F.sum(F.octet_length("packed") + 64), F.lit(0))).first()[0]
    return table.join(F.broadcast(per_row) if total <= BROADCAST_BYTES else per_row, "row", how)


def without_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", span: int = SPAN, gram: int = GRAM, hot_gram: int = HOT_GRAM, with_text: bool = False) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, on demand, kept (bytes) and spans.

    Strings are judged on the texts as they come, as UTF-8 bytes, and never cross documents.
    A null text counts as empty; texts shorter than ``span`` bytes keep everything; of equal
    documents the one with the smallest doc_id keeps everything that is new in it.  Rows
    without an id come last; rows with one doc_id follow each other by their texts, so of
    two equal rows one is removed whole; an empty table gives an empty result; other columns
    aren't read.
    """
    table, numbered = _numbered(docs, id_col, text_col)
    total = table.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    buckets = max(8, -(-total * 2 // ((span - gram + 2) * BUCKET)))
    found = written(anchor_findings(table.select("row", "text"), buckets, span, gram), "findings")
    freed(table.sparkSession)  # the anchors' shuffle files
    contenders, parts, spots = found.where("contender"), [found.where("not contender")], []
    often = written(contenders.groupBy("gram").count().where(F.col("count") > hot_gram).select("gram"), "hot-grams")
    if often.take(1):
        listed = F.broadcast(often) if small(often) else often
        spots.append(written(_packed_spots(contenders.join(listed, "gram")), "hot-spots"))
        parts.append(written(hot_runs(table.join(spots[-1], "row").select("row", "text", "packed"), span, gram), "hot-runs"))
        contenders = contenders.join(listed, "gram", "left_anti")
    count = contenders.count()
    spots.append(written(_packed_spots(contenders), "spots"))
    parts.append(written(contender_runs(table.join(spots[-1], "row").select("row", "text", "packed"), max(8, -(-count // 60_000)), span, gram), "contender-runs"))
    every = parts[0]
    for more in parts[1:]:
        every = every.unionByName(more)
    by_row = written(_packed_runs(every), "runs")
    freed(table.sparkSession)
    dropped(often, *spots)
    dropped(found, *parts[1:])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", *["kept", "spans"] * with_text]
        for batch in (whole.slice(at, ROWS) for whole in batches for at in range(0, whole.num_rows, ROWS)):
            out = []
            for text, runs in zip(batch.column(1).to_pylist(), batch.column(2), strict=True):
                body = (text or "").encode()
                if not runs.is_valid:
                    out.append((len(body), 0, 0, hashlib.sha256(body).hexdigest(), body, []))
                    continue
                whole = np.minimum(np.frombuffer(runs.as_buffer(), dtype="<i4").reshape(-1, 2), len(body)).tolist()
                kept, at, spans = [], 0, []
                for a, b in whole:
                    kept.append(body[at:a])
                    spans.append({"start": a, "end": b})
                    at = b
                kept.append(body[at:])
                rest = b"".join(kept)
                out.append((len(body), len(body) - len(rest), len(whole), hashlib.sha256(rest).hexdigest(), rest, spans))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))
            columns = [pa.array(c, t) for c, t in zip(zip(*out), kinds, strict=True)] if out else [pa.array([], t) for t in kinds]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns[: 4 + 2 * with_text]], names=names)

    kind = docs.schema[id_col].dataType.simpleString()
    joined = _with_runs(table, by_row, "left").select("doc_id", "text", "packed")
    return mapped(joined, cut, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string{', kept binary, spans array<struct<start:long,end:long>>' if with_text else ''}")
