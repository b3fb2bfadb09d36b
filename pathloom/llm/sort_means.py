"""Centroid clustering by sort-means, in whole numbers.

Each round orders, for every centroid, the others by their distance from it.  A vector starts
at the centroid it was assigned to last and looks at the others in that order; beyond twice its
distance to that centroid none can be nearer, nor as near, by the triangle inequality, and it
stops.  Squared distances keep this exact: stop where D^2 > 4 d^2.

Vectors lie in blocks, a row a block, which hold their last assignment and the block's sums by
centroid.  A round reads the blocks of the last one, writes the next ones and adds up the sums,
so vectors are never shuffled and a lost task is redone from a table in the shared folder.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import dropped, mapped, written

CLUSTERS, ROUNDS, WIDTH, SCALE = 16, 3, 64, 64
#: Components up to which float64 holds every square and sum exactly; beyond it Python's integers do.
EXACT = 1 << 21
#: Components that no long holds don't take part; blocks of wider ones hold longs.
LARGEST = 1 << 62
#: Vectors of a block.
BLOCK = 8192

BLOCKS = "kind string, ids array<long>, data binary, cluster binary"


def whole(data: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """floor(scale * x) of finite doubles, exactly; Python integers where int64 might not hold them."""
    if not len(data) or np.abs(data).max() * scale < LARGEST:
        return np.floor(data * scale).astype(np.int64)
    return np.array([[int(x) * scale if abs(x) >= 2.0**53 else int(np.floor(x * scale)) for x in row] for row in data], dtype=object).reshape(data.shape)


def _packed(kind: str, rows: np.ndarray, ids: list, cluster: np.ndarray) -> tuple:
    return kind, ids, rows.astype(kind).tobytes(), cluster.astype("<i4").tobytes()


def _kind(rows: np.ndarray) -> str:
    """The narrowest type of a block's components."""
    most = max(int(rows.max()), -int(rows.min()) - 1) if rows.size else 0
    return next(k for k, bits in (("<i1", 7), ("<i2", 15), ("<i4", 31), ("<i8", 63)) if most < 1 << bits)


def _rows(kind: str, data: bytes, width: int) -> np.ndarray:
    """A block's vectors, as numbers in which sums of squares are exact."""
    found = np.frombuffer(data, kind).reshape(-1, width)
    return found.astype(np.float64) if kind in ("<i1", "<i2") or np.abs(found.astype(np.float64)).max(initial=0) < EXACT else found.astype(object)


def fitted(vectors: pa.ListArray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows that take part, their components): those with ``width`` components, none null or not finite."""
    sizes = vectors.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    at = np.flatnonzero(sizes == width)
    flat = vectors.take(pa.array(at)).flatten().cast(pa.float64())
    data = flat.to_numpy(zero_copy_only=False).reshape(-1, width)  # nulls become NaN
    good = np.isfinite(data).all(axis=1)
    return at[good], data[good]


def blocks_of(vectors: DataFrame, clusters: int, width: int, scale: int) -> DataFrame:
    """Blocks of the vectors that take part, without assignment (all at centroid 0), and each block's candidates for starting centroids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, BLOCK):
                part = batch.slice(a, BLOCK)
                at, data = fitted(part.column(1), width)
                rows = whole(data, scale)
                if rows.dtype == object:
                    fit = [k for k, row in enumerate(rows) if max(map(abs, row)) < LARGEST]
                    at, rows = at[fit], rows[fit].astype(np.int64)
                wide = np.abs(rows).max(axis=1, initial=0) >= EXACT
                ids = np.array(part.column(0).to_pylist(), dtype=object)[at]
                for own in (~wide, wide):
                    if own.any():
                        yield block(rows[own], ids[own].tolist(), clusters)

    def block(rows: np.ndarray, ids: list, clusters: int) -> pa.RecordBatch:
        named = ((i is None, hashlib.sha256(f"1:{i}".encode()).hexdigest(), tuple(row)) for i, row in zip(ids, rows.tolist()))
        first = heapq.nsmallest(clusters, named)
        starts = [{"last": last, "name": name, "row": [int(x) for x in row]} for last, name, row in first]
        values = _packed(_kind(rows), rows, ids, np.zeros(len(rows)))
        kinds = [pa.string(), pa.list_(pa.int64()), pa.binary(), pa.binary()]
        start_kind = pa.list_(pa.struct([("last", pa.bool_()), ("name", pa.string()), ("row", pa.list_(pa.int64()))]))
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds)] + [pa.array([starts], start_kind)], names=["kind", "ids", "data", "cluster", "starts"])

    return mapped(vectors, run, f"{BLOCKS}, starts array<struct<last: boolean, name: string, row: array<long>>>")


def reassigned(rows: np.ndarray, centroids: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nearest centroid, squared distance) of each row; ties go to smaller numbers.

    Rows of one former centroid go together, the farthest first, so that those still looking
    are always the first ones.
    """
    exact = rows.dtype != object and all(abs(int(x)) < EXACT for x in centroids.ravel())
    kind = np.float64 if exact else object
    rows, centroids = rows.astype(kind), centroids.astype(kind)
    between = ((centroids[:, None] - centroids[None]) ** 2).sum(axis=2)
    cluster, distance = last.copy(), np.zeros(len(rows), dtype=kind)
    for start in np.unique(last):
        own = np.flatnonzero(last == start)
        own_distance = ((rows[own] - centroids[start]) ** 2).sum(axis=1)
        order = np.argsort(-own_distance, kind="stable")
        own, bound = own[order], 4 * own_distance[order]
        best, best_at = own_distance[order], np.full(len(own), start)
        held = rows[own]
        for other in sorted(range(len(centroids)), key=lambda k: (between[start, k], k)):
            if other == start:
                continue
            n = int(np.searchsorted(-bound, -between[start, other], side="right"))  # those with D^2 <= 4 d^2
            if not n:
                break
            d = ((held[:n] - centroids[other]) ** 2).sum(axis=1)
            nearer = (d < best[:n]) | ((d == best[:n]) & (other < best_at[:n]))
            best[:n] = np.where(nearer, d, best[:n])
            best_at[:n] = np.where(nearer, other, best_at[:n])
        cluster[own], distance[own] = best_at, best
    return cluster, distance


def _assigned(blocks: DataFrame, centroids: list[list[int]], width: int) -> DataFrame:
    """The next blocks, each with its sizes and sums by centroid (as texts, which hold numbers of any size)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        middle = np.array(centroids, dtype=object)
        for batch in batches:
            for k, ids, data, last in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                rows = _rows(k, data, width)
                cluster, _ = reassigned(rows, middle, np.frombuffer(last, "<i4"))
                found = np.unique(cluster)
                sums = [{"cluster": int(c), "size": int((cluster == c).sum()), "total": [str(int(x)) for x in rows[cluster == c].sum(axis=0)]} for c in found]
                kind = pa.list_(pa.struct([("cluster", pa.int32()), ("size", pa.int64()), ("total", pa.list_(pa.string()))]))
                columns = [pa.array([k]), pa.array([ids.as_py()], pa.list_(pa.int64())), pa.array([data], pa.binary()), pa.array([cluster.astype("<i4").tobytes()], pa.binary()), pa.array([sums], kind)]
                yield pa.RecordBatch.from_arrays(columns, names=["kind", "ids", "data", "cluster", "sums"])

    return mapped(blocks.select("kind", "ids", "data", "cluster"), run, f"{BLOCKS}, sums array<struct<cluster: int, size: long, total: array<string>>>")


def _moved(blocks: DataFrame, centroids: list[list[int]]) -> list[list[int]]:
    """Centroids at the floors of their vectors' means.  One row a (centroid, component) reaches the driver."""
    each = blocks.select(F.explode("sums").alias("of")).select("of.cluster", "of.size", F.posexplode("of.total").alias("place", "total"))
    rows = each.groupBy("cluster", "place").agg(F.sum("size").alias("size"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect()
    out = [list(c) for c in centroids]
    for r in rows:
        out[r.cluster][r.place] = int(r.total) // r.size
    return out


def _measured(blocks: DataFrame, centroids: list[list[int]], width: int) -> DataFrame:
    """(vec_id, cluster, squared) of every vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        middle = np.array(centroids, dtype=object)
        for batch in batches:
            for k, ids, data, last in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                cluster, distance = reassigned(_rows(k, data, width), middle, np.frombuffer(last, "<i4"))
                squared = distance.astype(np.int64).astype(str) if distance.dtype != object else [str(d) for d in distance]
                yield pa.RecordBatch.from_arrays([ids.values, pa.array(cluster.astype(np.int32)), pa.array(squared, pa.string())], names=["vec_id", "cluster", "squared"])

    found = mapped(blocks.select("kind", "ids", "data", "cluster"), run, "vec_id long, cluster int, squared string")
    return found.withColumn("squared", F.expr("try_cast(squared AS decimal(38,0))"))


def clustered(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", clusters: int = CLUSTERS, rounds: int = ROUNDS, width: int = WIDTH, scale: int = SCALE) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every vector that takes part.

    Vectors that are null, of another length or hold null or non-finite components don't take
    part, nor do those whose whole numbers exceed 2**62.  Fewer vectors than ``clusters`` make
    fewer centroids.  Rows that share an id all take part, equal ones too; starting centroids
    with one id go by their components; rows without an id start one only after all others.
    Squared distances and their sums beyond a long come out as null.  An empty table gives an
    empty result; other columns aren't read.
    """
    blocks = written(blocks_of(vectors.select(F.col(id_col).cast("long"), F.col(vector_col).cast("array<double>")), clusters, width, scale), "blocks")
    starts = blocks.select(F.explode("starts").alias("at")).select("at.*").orderBy("last", "name", "row").limit(clusters)
    centroids = [list(r.row) for r in starts.collect()]
    for _ in range(rounds if centroids else 0):
        nearer = written(_assigned(blocks, centroids, width), "blocks")
        dropped(blocks)
        blocks, centroids = nearer, _moved(nearer, centroids)
    found = written(_measured(blocks, centroids, width), "assigned")
    dropped(blocks)
    long = lambda c: F.expr(f"try_cast({c} AS long)")
    held = F.when(F.count("squared") == F.count(F.lit(1)), F.try_sum("squared"))
    sums = {r.cluster: r.held for r in found.groupBy("cluster").agg(held.alias("held")).collect()}  # a row a centroid
    facts = [(k, sums.get(k), hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for k, c in enumerate(centroids)]
    whole_sum = None if None in sums.values() else str(sum(sums.values()))
    named = vectors.sparkSession.createDataFrame(facts, "cluster int, held decimal(38,0), centroid_sha256 string")
    out = found.join(F.broadcast(named), "cluster")
    return out.select("vec_id", "cluster", long("squared").alias("distance"), long("held").alias("cluster_inertia"), F.lit(whole_sum).cast("string").alias("whole_sum"), "centroid_sha256").select("vec_id", "cluster", "distance", "cluster_inertia", long("whole_sum").alias("inertia"), "centroid_sha256")
