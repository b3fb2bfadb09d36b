"""Exact Jaccard self-join of word-shingle sets in their metric space.

1. Points.  Equal sets are merged; what follows sees one representative of each.
2. Cells of elementary pivots.  Unrelated documents are at distance 1 from each other, so
   the first pivots are the smallest sets that lie nearer than that: single shingles, all of
   the corpus.  A set is as near to each of its own, {s}, as to any other, so ties go by rarity:
   home is the rarest.  A link leaves a set all but |x| - ceil(p |x|) of its shingles, so the
   window copies it into the cells of that many shingles, and one more, from the rarest on:
   linked sets meet in a cell.  Passages that many documents share are the farthest in that
   order and seldom reached.  Cells with the same members are merged.  Sets with few of
   these shingles in common have too few others left to be linked, which rules out most
   pairs before any whole set is fetched (``most_shared``).
3. Cells join recursively.  Twice a member is made pivot of its cell and compared with all
   others; those within the radius form one component with it, which settles them against
   each other, and a cell whose members are all in one component is done.  What stays open
   is split into Voronoi cells of sampled members with windows of the triangle inequality,
   down to exact comparisons (``metric_cells``).  An open cell too large for a task is dealt
   in blocks: the members outside its largest component meet each other and that component.
   Blocks with mostly the same members are made one first (``gathered``), so that a set isn't
   sent once for each cell that it shares with its near copies.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import metric_cells, word_hash
from .components import components
from .shared import attached, bucketed, dropped, freed, mapped, small, written

SHINGLE, PERCENT = 4, 85
#: Rarity is told by counts of all shingles in so many slots of their hashes (a table of 4 MB at
#: any size of corpus), merged in so many parts.  The order decides how many sets meet, never the result.
SLOT_BITS, SLOT_PARTS = 20, 64
#: Cell rows sorted together by a task, and about as many to a reducing partition.
CHUNK, BUCKET = 500_000, 400_000
#: Rounds in which a member is made pivot of its cell.
STARS = 2
#: Members and bytes of sets on one side of a block.
PART, PART_BYTES = 4000, 16 << 20
#: Times that blocks with members in common are made one.
MERGES = 2
#: Bytes of sets of the cells that a task gets, about.
TASK_BYTES = 24 << 20
STEPS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63], dtype=np.uint64)
SLICE = 256 << 10
#: Rows of a batch that are Python objects at once.
ROWS = 256


def window(n: int, percent: int = PERCENT) -> int:
    """Cells a set of ``n`` shingles is copied to: it shares at least ceil(percent n / 100) with any set it links with."""
    return n + 1 - -(-percent * n // 100)


def shingle_sets(texts: list[bytes], width: int = SHINGLE, seed: int = 0) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    data = np.frombuffer(b" ".join(texts) + b" ", dtype=np.uint8)
    starts, _, hashes = word_hash.words(data, lower=True)
    ends = np.cumsum(sizes + 1)
    cuts = np.searchsorted(starts, np.concatenate(([0], ends)))
    with np.errstate(over="ignore"):
        total = np.full(max(0, len(hashes) - width + 1), seed, dtype=np.uint64)
        for k in range(width):
            total += hashes[k : len(hashes) - width + 1 + k] * STEPS[k]
        total = word_hash.mix(total)
        out = []
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            if b - a >= width:
                out.append(np.unique(total[a : b - width + 1]))
            elif b > a:  # the whole sequence, told apart from longer shingles by its length
                out.append(word_hash.mix((hashes[a:b] * STEPS[: b - a]).sum(keepdims=True, dtype=np.uint64) + np.uint64(seed + b - a) * STEPS[4]))
            else:
                out.append(np.zeros(0, dtype=np.uint64))
    return out


def slot_of(found: np.ndarray) -> np.ndarray:
    """The slots of hashes, or of their upper halves."""
    return (found >> found.dtype.type(found.dtype.itemsize * 8 - SLOT_BITS)).astype(np.int64)


def pivots(found: np.ndarray, counts: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """The shingles whose cells a set goes to: the rarest by the corpus' counts, ties by hash."""
    return found[np.lexsort((found, counts[slot_of(found)]))[: window(len(found), percent)]]


def _slices(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    at = 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (end == at or size + len(texts[end]) <= SLICE):
            size += len(texts[end]) + 1
            end += 1
        yield at, end
        at = end


def _set_key(found: np.ndarray) -> tuple[int, int]:
    with np.errstate(over="ignore"):
        low = np.add.reduce(word_hash.mix(found ^ STEPS[0]), dtype=np.uint64)
        high = np.add.reduce(word_hash.mix(found + STEPS[4]), dtype=np.uint64)
        return int(word_hash.mix(np.array([low + np.uint64(len(found))])).view(np.int64)[0]), int(np.array([high]).view(np.int64)[0])


def slot_counts(docs: DataFrame, text_col: str, width: int, seed: int) -> np.ndarray:
    """How many sets of the corpus hold shingles of each slot: one table of fixed size a task, summed by parts."""
    size = 1 << SLOT_BITS
    part = size // SLOT_PARTS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, held, count = np.zeros(size, dtype=np.uint32), [], 0
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS):
                texts = [(t or "").encode() for t in batch.column(0).slice(start, ROWS).to_pylist()]
                for a, b in _slices(texts):
                    held += shingle_sets(texts[a:b], width, seed)
                    count += sum(map(len, held[a - b :]))
                    if count > size:
                        total += np.bincount(slot_of(np.concatenate(held)), minlength=size).astype(np.uint32)
                        held, count = [], 0
        if held:
            total += np.bincount(slot_of(np.concatenate(held)), minlength=size).astype(np.uint32)
        for k in range(SLOT_PARTS):
            piece = total[k * part : (k + 1) * part]
            if piece.any():
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([piece.tobytes()], pa.binary())], names=["part", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                sums[k] = sums.get(k, 0) + np.frombuffer(counts, dtype=np.uint32).astype(np.uint64)
        for k, counts in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([counts.tobytes()], pa.binary())], names=["part", "counts"])

    kind = "part int, counts binary"
    out = np.zeros(size, dtype=np.uint64)
    for row in mapped(mapped(docs.select(text_col), run, kind).repartition(SLOT_PARTS, "part"), add, kind).collect():  # SLOT_PARTS rows
        out[row.part * part : (row.part + 1) * part] = np.frombuffer(row.counts, dtype=np.uint64)
    return np.minimum(out, 0xFFFFFFFF).astype(np.uint32)


def signed(docs: DataFrame, shipped: Broadcast, id_col: str, text_col: str, width: int, percent: int, seed: int) -> DataFrame:
    """(doc_id, n, sid, more, near) of every row; equal sets have equal (sid, more).  A task lists each set's cells once."""
    table = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("__text"))
    kind = table.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        counts = shipped.value
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS):
                part = batch.slice(start, ROWS)
                texts = [(t or "").encode() for t in part.column(1).to_pylist()]
                ids = part.column(0)
                for a, b in _slices(texts):
                    rows = []
                    for k, found in enumerate(shingle_sets(texts[a:b], width, seed)):
                        key = _set_key(found)
                        fresh = len(found) and key not in seen and ids[a + k].is_valid
                        if fresh:
                            seen.add(key)
                        rows.append((len(found), *key, pivots(found, counts, percent).tobytes() if fresh else None))
                    columns = [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)]
                    yield pa.RecordBatch.from_arrays([ids.slice(a, b - a), *columns], names=["doc_id", "n", "sid", "more", "near"])

    return mapped(table, run, f"doc_id {kind}, n long, sid long, more long, near binary")


PLACE = np.dtype([("cell", "<u8"), ("sid", "<i8"), ("n", "<i4")])


def shared_cells(table: DataFrame, buckets: int) -> DataFrame:
    """(cell, sid, n) of every cell that more than one set lies in.

    A task sorts its rows.  Those of cells it finds repeated are emitted at once, and stand for
    themselves with one row each in the exchange, so a cell that a third of all documents
    lie in sends no more rows than there are chunks.
    """

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count, turn = [], 0, 0

        def emit() -> pa.RecordBatch:
            nonlocal turn
            rows = np.concatenate(held)
            rows = rows[np.lexsort((rows["sid"], rows["cell"]))]
            head = np.concatenate(([True], rows["cell"][1:] != rows["cell"][:-1]))
            run = np.cumsum(head) - 1
            many = np.bincount(run) > 1
            firsts = rows[head]
            bucket = (firsts["cell"] % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
            turn += 1
            out = [(k, False, firsts[order[a:b]].tobytes(), np.packbits(many[order[a:b]]).tobytes()) for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])) if b > a]
            local = rows[many[run]]
            out += [((turn * 7919 + k) % buckets, True, local[k : k + 200_000].tobytes(), b"") for k in range(0, len(local), 200_000)]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int32(), pa.bool_(), pa.binary(), pa.binary()), strict=True)], names=["bucket", "done", "rows", "many"])

        for batch in batches:
            for sid, n, near in zip(batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2), strict=True):
                cells = np.frombuffer(near.as_buffer(), dtype="<u8")
                rows = np.empty(len(cells), dtype=PLACE)
                rows["cell"], rows["sid"], rows["n"] = cells, sid, n
                held.append(rows)
                count += len(rows)
                if count >= CHUNK:
                    yield emit()
                    held, count = [], 0
        if held:
            yield emit()

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def frame(rows: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(rows["cell"].copy().view(np.int64)), pa.array(rows["sid"].copy()), pa.array(rows["n"].copy())], names=["cell", "sid", "n"])

        held, flags = [], []
        for batch in batches:
            for done, rows, many in zip(*(batch.column(k) for k in (1, 2, 3)), strict=True):
                rows = np.frombuffer(rows.as_buffer(), dtype=PLACE)
                if done.as_py():
                    yield frame(rows)
                else:
                    held.append(rows.copy())
                    flags.append(np.unpackbits(np.frombuffer(many.as_buffer(), dtype=np.uint8), count=len(rows)).astype(bool))
        if held:
            rows, many = np.concatenate(held), np.concatenate(flags)
            del held, flags
            order = np.argsort(rows["cell"], kind="stable")
            rows, many = rows[order], many[order]
            run = np.cumsum(np.concatenate(([True], rows["cell"][1:] != rows["cell"][:-1]))) - 1
            low, high = np.full(run[-1] + 1, np.iinfo(np.int64).max), np.full(run[-1] + 1, np.iinfo(np.int64).min)
            np.minimum.at(low, run, rows["sid"])
            np.maximum.at(high, run, rows["sid"])
            yield frame(rows[(low < high)[run] & ~many])

    parts = mapped(table.where("near is not null").select("sid", "n", "near"), part, "bucket int, done boolean, rows binary, many binary")
    return mapped(parts.repartition(buckets, "bucket"), meet, "cell long, sid long, n int").distinct()


def merged_cells(rows: DataFrame) -> DataFrame:
    """``rows`` without cells that have just the members of another cell."""
    names = rows.groupBy("cell").agg(F.bit_xor(F.xxhash64("sid")).alias("x"), F.bit_xor(F.xxhash64(F.lit("other"), "sid")).alias("y"), F.count(F.lit(1)).alias("group_size"))
    kept = written(names.groupBy("x", "y", "group_size").agg(F.min("cell").alias("cell")).select("cell", "group_size"), "cells")
    out = written(attached(rows, kept, ["cell"], rows.count(), how="inner").drop("group_size"), "members")
    dropped(kept)
    return out


def fetched_sets(docs: DataFrame, reps: DataFrame, id_col: str, text_col: str, width: int, seed: int) -> DataFrame:
    """(sid, n, body) of the sets whose representative documents are given; body: sorted hashes as bytes."""
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("__text")).join(F.broadcast(reps) if small(reps) else reps, "doc_id").select("__text", "sid", "more")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS):
                part = batch.slice(start, ROWS)
                bodies = [(t or "").encode() for t in part.column(0).to_pylist()]
                keys = list(zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True))
                for a, b in _slices(bodies):
                    found = [(key[0], len(s), s.tobytes()) for key, s in zip(keys[a:b], shingle_sets(bodies[a:b], width, seed), strict=True) if _set_key(s) == key]
                    if found:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), (pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["sid", "n", "body"])

    return mapped(texts, run, "sid long, n long, body binary")


def star_links(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b): the linked ones of the pairs (sid, pivot), compared exactly."""
    bodies = sets.select("sid", "body")
    both = pairs.join(bodies.withColumnRenamed("body", "own"), "sid").join(bodies.toDF("pivot", "body"), "pivot").select("sid", "pivot", "own", "body")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = []
            for own, body in zip(batch.column(2), batch.column(3), strict=True):
                a, b = (np.frombuffer(x.as_buffer(), dtype="<u8") for x in (own, body))
                few, many = (a, b) if len(a) <= len(b) else (b, a)
                shared = int((many[np.minimum(np.searchsorted(many, few), len(many) - 1)] == few).sum())
                near.append(100 * shared >= percent * (len(a) + len(b) - shared))
            yield batch.select([0, 1]).filter(pa.array(near, pa.bool_())).rename_columns(["a", "b"])

    return mapped(both, run, "a long, b long")


def rare_lists(table: DataFrame) -> DataFrame:
    """(sid, n, near): the rarest shingles by the upper halves of their hashes, enough to bound what sets share."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            halves = [(np.frombuffer(x.as_buffer(), dtype="<u8") >> np.uint64(32)).astype("<u4").tobytes() for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(halves, pa.binary())], names=["sid", "n", "near"])

    return mapped(table, run, "sid long, n long, near binary")


def last_key(near: np.ndarray, counts: np.ndarray) -> tuple[int, int]:
    """The place of the last listed shingle in the order of rarity; equal for different shingles only if the true order is unknown."""
    return int(counts[slot_of(near[-1:])][0]), int(near[-1])


def most_shared(near_x: np.ndarray, n: int, near_y: np.ndarray, m: int, counts: np.ndarray) -> int:
    """An upper bound of the shingles that two sets share, from their rarest ones.

    Up to the last one listed of the set whose list ends first, all that both have is in both
    lists; beyond it either has what remains.  Equal halves of different hashes only raise it.
    """
    x, y = last_key(near_x, counts), last_key(near_y, counts)
    both = min(np.isin(near_x, near_y).sum(), np.isin(near_y, near_x).sum())

    def rest(near: np.ndarray, size: int, last: tuple[int, int], other: np.ndarray, other_size: int) -> int:
        weight = counts[slot_of(other)]
        reached = int(((weight < last[0]) | (weight == last[0]) & (other < np.uint32(last[1]))).sum())
        return min(size - len(near), other_size - max(reached, int(both)))

    ends = [rest(near_x, n, x, near_y, m)] * (x <= y) + [rest(near_y, m, y, near_x, n)] * (y <= x)
    return int(both) + max(ends)


def plausible(pairs: DataFrame, lists: DataFrame, shipped: Broadcast, percent: int) -> DataFrame:
    """The pairs (sid, pivot) whose lists of rarest shingles allow a link."""
    both = pairs.join(lists, "sid").join(lists.toDF("pivot", "m", "pivot_near"), "pivot").select("sid", "pivot", "n", "m", "near", "pivot_near")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = shipped.value
        for batch in batches:
            keep = []
            for n, m, x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), batch.column(4), batch.column(5), strict=True):
                shared = most_shared(np.frombuffer(x.as_buffer(), dtype="<u4"), n, np.frombuffer(y.as_buffer(), dtype="<u4"), m, counts)
                keep.append(100 * shared >= percent * (n + m - shared))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return mapped(both, run, "sid long, pivot long")


def _sizes(members: DataFrame) -> DataFrame:
    """(cell, group_size, top, tops, rests, whole, dealt): the parts that ``_blocks`` deals a cell in, and the rows that makes."""
    by_comp = members.groupBy("cell", "comp").agg(F.count(F.lit(1)).alias("members"), F.sum("n").alias("shingles"))
    parts = lambda members, shingles: F.greatest(F.lit(1), F.ceil(members / PART), F.ceil(shingles * 8 / PART_BYTES)).cast("int")
    sizes = by_comp.groupBy("cell").agg(F.max_by(F.struct("comp", "members", "shingles"), F.struct("members", "comp")).alias("top"), F.sum("members").alias("group_size"), F.sum("shingles").alias("shingles"))
    rest = parts(F.col("group_size") - F.col("top.members"), F.col("shingles") - F.col("top.shingles"))
    sizes = sizes.select("cell", "group_size", F.col("top.comp").alias("top"), F.col("top.members").alias("inner"), parts(F.col("top.members"), F.col("top.shingles")).alias("tops"), rest.alias("rests"), (parts(F.col("group_size"), F.col("shingles")) == 1).alias("whole"))
    dealt = F.when(F.col("whole"), F.col("group_size")).otherwise(F.col("inner") * F.col("rests") + (F.col("group_size") - F.col("inner")) * (F.col("rests") + F.col("tops")))
    return written(sizes.withColumn("dealt", dealt).drop("inner"), "cell-sizes")


def _blocks(members: DataFrame, sizes: DataFrame) -> DataFrame:
    """(block, sid, comp, n) of open cells (cell, sid, comp, n) that have ``sizes``: a cell that fits a task is one block.

    Of a larger one, the members outside its largest component are dealt into parts that
    meet each other and the parts of that component; its own parts don't meet.
    """
    rows = attached(members, sizes, ["cell"], members.count(), how="inner").drop("group_size")
    one = rows.where("whole").select(F.xxhash64("cell").alias("block"), "sid", "comp", "n")
    many = rows.where("not whole").withColumn("is_top", F.col("comp") == F.col("top"))
    many = many.withColumn("own", F.pmod(F.xxhash64("sid"), F.when(F.col("is_top"), F.col("tops")).otherwise(F.col("rests"))).cast("int"))
    with_rests = F.transform(F.sequence(F.lit(0), F.col("rests") - 1), lambda j: F.when(F.col("is_top"), F.struct(F.lit(0).alias("kind"), F.col("own").alias("i"), j.alias("j"))).otherwise(F.struct(F.lit(1).alias("kind"), F.least("own", j).alias("i"), F.greatest("own", j).alias("j"))))
    with_tops = F.when(~F.col("is_top"), F.transform(F.sequence(F.lit(0), F.col("tops") - 1), lambda i: F.struct(F.lit(0).alias("kind"), i.alias("i"), F.col("own").alias("j"))))
    many = many.withColumn("at", F.explode(F.concat(with_rests, F.coalesce(with_tops, F.array().cast("array<struct<kind:int,i:int,j:int>>")))))
    return one.unionByName(many.select(F.xxhash64("cell", "at.kind", "at.i", "at.j").alias("block"), "sid", "comp", "n"))


def _by_block(batches: Iterator[pa.RecordBatch], width: int, kind: str) -> Iterator[list[tuple]]:
    """The rows (block, ..., bytes) of each block, which stand together; the last column as an array of hashes."""
    block, held = None, []
    for batch in batches:
        for *row, body in zip(*(batch.column(k).to_pylist() for k in range(width - 1)), batch.column(width - 1), strict=True):
            if row[0] != block and held:
                yield held
                held = []
            block = row[0]
            held.append((*row, np.frombuffer(body.as_py(), dtype=kind)))
    if held:
        yield held


def _together(rows: DataFrame, total: int) -> DataFrame:
    return rows.repartition(max(8, -(-total // TASK_BYTES)), "block").sortWithinPartitions("block")


def partnered(blocks: DataFrame, lists: DataFrame, shipped: Broadcast, percent: int) -> DataFrame:
    """The rows (block, sid, comp, n) of ``blocks`` that the lists of rarest shingles allow a link with another component's."""
    total = blocks.agg(F.coalesce(F.sum(F.col("n") * (100 - percent) * 4 / 100 + 100), F.lit(0)).cast("long")).first()[0]
    rows = blocks.join(lists.select("sid", "near"), "sid").select("block", "sid", "comp", "n", "near")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = shipped.value
        for held in _by_block(batches, 5, "<u4"):
            comps = np.array([h[2] for h in held])
            if comps.min() == comps.max():
                continue
            near = [h[4] for h in held]
            keep = metric_cells.partnered(near, np.array([h[3] for h in held]), [last_key(x, counts) for x in near], comps, percent)
            if keep.any():
                kept = [h for h, k in zip(held, keep, strict=True) if k]
                yield pa.RecordBatch.from_arrays([pa.array([h[c] for h in kept], pa.int64()) for c in range(4)], names=["block", "sid", "comp", "n"])

    return mapped(_together(rows, total), run, "block long, sid long, comp long, n long")


def cell_links(blocks: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b): links that connect the components of every block, joined by Voronoi cells in its task."""
    total = blocks.agg(F.coalesce(F.sum(F.col("n") * 8 + 100), F.lit(0))).first()[0]
    rows = blocks.select("block", "sid", "comp").join(sets.select("sid", "body"), "sid").select("block", "sid", "comp", "body")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in _by_block(batches, 4, "<u8"):
            near = metric_cells.links([h[3] for h in held], np.array([h[2] for h in held]), percent)
            if near:
                yield pa.RecordBatch.from_arrays([pa.array([held[k[side]][1] for k in near], pa.int64()) for side in (0, 1)], names=["a", "b"])

    return mapped(_together(rows, total), run, "a long, b long")


def gathered(blocks: DataFrame) -> DataFrame:
    """The rows (block, sid, comp, n) of ``blocks``, fewer where blocks have members in common: what met still does.

    Near copies lie together in many cells.  The member of least hash is most likely the same
    in blocks that share most of theirs; these become one, which is dealt as an open cell is.
    Where that makes no fewer rows, blocks stay as they are.
    """
    for turn in range(MERGES):
        total = blocks.count()
        lead = blocks.groupBy("block").agg(F.xxhash64(F.min_by("sid", F.xxhash64("sid", F.lit(turn))), F.lit(turn)).alias("cell"), F.count(F.lit(1)).alias("group_size"))
        lead = written(lead, "leads")
        led = written(attached(blocks, lead, ["block"], total, how="inner").drop("group_size"), "led")
        members = written(led.select("cell", "sid", "comp", "n").distinct(), "led-members")
        sizes = _sizes(members)
        fewer = sizes.join(led.groupBy("cell").agg(F.count(F.lit(1)).alias("rows")), "cell").where("dealt < rows")
        fewer = written(fewer, "fewer")
        alone = attached(led, fewer.select("cell", "rows"), ["cell"], total, size="rows").where("rows is null")
        grown = written(alone.select("block", "sid", "comp", "n").unionByName(_blocks(members, fewer)), "gathered")
        dropped(blocks, lead, led, members, sizes, fewer)
        blocks = grown
    return blocks


class Sets:
    """Whole sets of the corpus, fetched when they are first asked for."""

    def __init__(self, docs: DataFrame, sets_of: DataFrame, id_col: str, text_col: str, width: int, seed: int):
        self.docs, self.sets_of, self.args = docs, sets_of.select("sid", "more", F.col("rep").alias("doc_id")), (id_col, text_col, width, seed)
        self.held: list[DataFrame] = []  # one table that grows

    def of(self, sids: DataFrame) -> DataFrame:
        """(sid, n, body) that holds all of ``sids`` (a column sid), each once."""
        missing = sids.distinct()
        for table in self.held:
            missing = missing.join(table.select("sid"), "sid", "left_anti")
        wanted = written(missing.join(self.sets_of, "sid"), "wanted")
        if not self.held or wanted.take(1):
            self.held = [bucketed(fetched_sets(self.docs, wanted, *self.args), "sets", "sid", *self.held)]
        dropped(wanted)
        return self.held[0]


def _open(members: DataFrame, comps: DataFrame | None, turn: int) -> DataFrame:
    """(cell, sid, n, comp, pivot) of the cells whose members belong to more than one component."""
    known = members.withColumn("comp", F.col("sid")) if comps is None else members.join(comps.withColumnRenamed("node", "sid"), "sid", "left").withColumn("comp", F.coalesce("comp", "sid"))
    known = written(known, "known")
    pivot = F.min("sid") if turn == 0 else F.min_by("sid", F.xxhash64("sid", F.lit(turn)))
    cells = known.groupBy("cell").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), pivot.alias("pivot"), F.count(F.lit(1)).alias("group_size"))
    cells = written(cells.where("low < high").select("cell", "pivot", "group_size"), "open-cells")
    out = written(attached(known, cells, ["cell"], known.count(), how="inner").drop("group_size"), "open")
    dropped(known, cells)
    return out


def linked_components(members: DataFrame, lists: DataFrame, sets: Sets, shipped: Broadcast, percent: int) -> DataFrame | None:
    """(node, comp) of the sets that have links, by recursive joins of the cells ``members`` (cell, sid, n)."""
    links, comps = None, None
    for turn in range(STARS + 1):
        live = _open(members, comps, turn)
        dropped(members)
        if not live.take(1):
            dropped(live)
            break
        if turn < STARS:
            own = live.where("sid = pivot").select("pivot", F.col("n").alias("m"), F.col("comp").alias("pivot_comp")).distinct()
            pairs = live.where("sid <> pivot").select("sid", "n", "comp", "pivot").distinct().join(own, "pivot")
            pairs = pairs.where((F.col("comp") != F.col("pivot_comp")) & (100 * F.least("n", "m") >= percent * F.greatest("n", "m")))
            pairs = pairs.select(F.least("sid", "pivot").alias("sid"), F.greatest("sid", "pivot").alias("pivot")).distinct()
            pairs = written(plausible(pairs, lists, shipped, percent), "pairs")
            near = written(star_links(pairs, sets.of(pairs.select("sid").unionByName(pairs.select(F.col("pivot").alias("sid")))), percent), "links")
            members = written(live.where("sid <> pivot").select("cell", "sid", "n"), "members")
            dropped(pairs)
        else:
            cells = live.select("cell", "sid", "comp", "n")
            sizes = _sizes(cells)
            blocks = written(_blocks(cells, sizes), "blocks")
            left = gathered(written(partnered(blocks, lists, shipped, percent), "partnered"))
            near = written(cell_links(left, sets.of(left.select("sid")), percent), "links")
            dropped(sizes, blocks, left)
        dropped(live)
        if near.take(1):
            grown = near if links is None else written(links.unionByName(near), "links")
            if links is not None:
                dropped(links, comps, near)
            links, comps = grown, components(grown)
        else:
            dropped(near)
        freed(lists.sparkSession)
    if links is not None:
        dropped(links)
    return comps


def joined(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id.

    Words are runs of bytes other than ASCII white space, A-Z lower-cased; sets hold 64-bit
    hashes of all shingles of the whole text.  ``component_id`` is the smallest doc_id
    reachable by links, the own one included.  Null texts, empty ones and those without words
    have an empty set and no link, not even with each other; a row without an id has its
    ``n_shingles`` but no link and no component; rows with one doc_id count each by its own
    text and end in whatever components these have; an empty table gives an empty result;
    other columns aren't read.
    """
    for seed in range(8):
        shipped = docs.sparkSession.sparkContext.broadcast(slot_counts(docs, text_col, width, seed))
        table = written(signed(docs, shipped, id_col, text_col, width, percent, seed), "signed")
        whole = table.where("n > 0 and doc_id is not null")
        sets_of = whole.groupBy("sid").agg(F.min("doc_id").alias("rep"), F.min("more").alias("more"), F.max("more").alias("most"), F.count(F.lit(1)).alias("group_size"))
        sets_of = written(sets_of, "sets-of")
        if not sets_of.where("more <> most").take(1):
            break
        dropped(table, sets_of)  # two different sets with one 64-bit name: other hashes
    counted = table.agg(F.coalesce(F.sum(F.octet_length("near")), F.lit(0))).first()[0] // 8
    places = written(shared_cells(table, max(8, -(-counted // BUCKET))), "places")
    members = merged_cells(places)
    dropped(places)
    lists = rare_lists(table.where("near is not null").select("sid", "n", "near"))
    lists = bucketed(lists.join(members.select("sid").distinct(), "sid", "left_semi"), "lists", "sid")
    sets = Sets(docs, sets_of, id_col, text_col, width, seed)
    comps = linked_components(members, lists, sets, shipped, percent)
    dropped(lists, *sets.held)
    named = sets_of.withColumn("low", F.lit(None).cast(sets_of.schema["rep"].dataType))
    if comps is not None:
        low = comps.withColumnRenamed("node", "sid").join(sets_of.select("sid", "rep"), "sid")
        low = written(low.join(low.groupBy("comp").agg(F.min("rep").alias("low")), "comp").select("sid", "low"), "components")
        named = sets_of.join(low, "sid", "left")
    named = written(named.where("group_size > 1 or low is not null").select("sid", F.coalesce("low", "rep").alias("component_id"), "group_size"), "named")
    dropped(sets_of, *([low, comps] if comps is not None else []))
    total = table.count()
    rows = table.select("doc_id", "n", "sid")
    linkable = (F.col("n") > 0) & F.col("doc_id").isNotNull()
    single = rows.where(~linkable).select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    rest = attached(rows.where(linkable), named, ["sid"], total).select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))
    return single.unionByName(rest)
