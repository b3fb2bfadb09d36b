"""Chunk vectors on disk: half precision, a declared dimension, checked when written, migrated without embedding."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.semantic import MAX_CHUNKS
from .scratch import stored
from .snapshot import SnapshotStore

#: The form of the rows: 1 held single-precision arrays, 2 holds half-precision bytes.
STORE_VERSION, MAX_DIM = 2, 8192
CHUNK = "path string, mtime long, size long, chunk_ix int, line_start int"


def packed(rows: DataFrame) -> DataFrame:
    """``vec`` as little-endian half-precision bytes, a batch at a time; null stays null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = batch.column("vec")
            with np.errstate(over="ignore"):
                data = vectors.flatten().to_numpy(zero_copy_only=False).astype("<f2").tobytes()
            ends = np.concatenate(([0], np.cumsum(vectors.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)))) * 2
            held = [None if null else data[a:b] for null, a, b in zip(vectors.is_null().to_pylist(), ends[:-1].tolist(), ends[1:].tolist())]
            yield batch.set_column(batch.schema.get_field_index("vec"), "vec", pa.array(held, pa.binary()))

    fields = ", ".join(f"`{f.name}` {'binary' if f.name == 'vec' else f.dataType.simpleString()}" for f in rows.schema)
    return rows.withColumn("vec", F.col("vec").cast("array<float>")).mapInArrow(run, fields)


def unpacked(rows: DataFrame) -> DataFrame:
    """``vec`` as an array of floats again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = batch.column("vec").fill_null(b"")
            sizes = np.array([len(v.as_buffer()) // 2 for v in held], dtype=np.int32)
            values = np.frombuffer(b"".join(held.to_pylist()), "<f2").astype(np.float32)
            vectors = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)), pa.array(values))
            yield batch.set_column(batch.schema.get_field_index("vec"), "vec", vectors)

    fields = ", ".join(f"`{f.name}` {'array<float>' if f.name == 'vec' else f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(run, fields)


def _from_arrays(rows: DataFrame, facts: dict) -> DataFrame:
    return packed(rows)


#: What brings rows of a version to the next one.
MIGRATIONS: dict[int, Callable[[DataFrame, dict], DataFrame]] = {1: _from_arrays}


def broken(rows: DataFrame, dim: int) -> dict[str, int]:
    """How often packed rows break each rule of the store, by one pass of aggregates, and how much there is."""
    by_doc = rows.groupBy("path").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("chunk_ix").alias("distinct"), F.min("chunk_ix").alias("first"), F.countDistinct("mtime", "size").alias("states"),
        F.count_if(F.col("vec").isNull() | (F.octet_length("vec") != 2 * dim)).alias("vectors"), F.count_if(F.coalesce(F.col("line_start") < 1, F.lit(True))).alias("lines"),
    )
    rules = {
        "vectors of another dimension": F.sum("vectors"), "line numbers below 1": F.sum("lines"), "chunks listed twice": F.sum(F.col("n") - F.col("distinct")), "documents without a first chunk": F.count_if(F.col("first") != 0),
        "documents of two states": F.count_if(F.col("states") != 1), "documents without a path": F.count_if(F.col("path").isNull()), "documents of too many chunks": F.count_if(F.col("n") > MAX_CHUNKS), "docs": F.count(F.lit(1)), "chunks": F.sum("n"),
    }
    return {k: v or 0 for k, v in by_doc.agg(*(e.alias(k) for k, e in rules.items())).first().asDict().items()}


class SemanticStore:
    """Chunks (path, mtime, size, chunk_ix, line_start, vec) of one dimension, in versions."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.store = spark, SnapshotStore(spark, root)

    def facts(self) -> dict | None:
        manifest = self.store.current()
        return None if manifest is None else {"store_version": 1, **manifest}

    def needs_migration(self) -> bool:
        facts = self.facts()
        return facts is not None and facts["store_version"] in MIGRATIONS

    def _write(self, rows: DataFrame, dim: int, expected: int | None = None) -> dict:
        if not 0 < dim <= MAX_DIM:
            raise ValueError(f"vectors of dimension {dim} can't be stored")
        found: dict[str, int] = {}

        def check(written: DataFrame) -> dict:
            found.update(broken(written, dim))
            wrong = {k: n for k, n in found.items() if n and k not in ("docs", "chunks")}
            if wrong:
                raise ValueError("not a sound semantic index: " + ", ".join(f"{n} {k}" for k, n in wrong.items()))
            return {"docs": found["docs"], "chunks": found["chunks"]}

        version = self.store.publish(rows.select("path", "mtime", "size", "chunk_ix", "line_start", "vec"), expected=expected, ordered=False, check=check, store_version=STORE_VERSION, dim=dim)
        if version is None:
            raise RuntimeError("another writer published meanwhile")
        return {"docs": found["docs"], "chunks": found["chunks"], "dim": dim, "version": version}

    def publish(self, rows: DataFrame, *, dim: int | None = None) -> dict:
        """Writes chunks with ``vec`` as arrays; the rules are checked on what was written before it comes into force."""
        held = self.spark.read.schema(f"{CHUNK}, vec binary").parquet(stored(packed(rows.select(F.col("path"), F.col("mtime").cast("long"), F.col("size").cast("long"), F.col("chunk_ix").cast("int"), F.col("line_start").cast("int"), "vec")), "vectors"))
        if dim is None:  # that of the rows, or of the store where there are none
            dim = held.select(F.expr("octet_length(vec) div 2").alias("d")).where("d is not null").agg(F.max("d")).first()[0] or (self.facts() or {}).get("dim") or 1
        return self._write(held, dim)

    def migrate(self) -> dict:
        """Brings an older version's rows to the present form, step by step, without embedding anything."""
        facts = self.facts()
        rows, version = self.store.load(), facts["store_version"]
        if rows is None:
            raise ValueError("the semantic index can't be read")
        dim = facts.get("dim") or rows.agg(F.max(F.size("vec"))).first()[0] or 1
        while version in MIGRATIONS:
            rows, version = MIGRATIONS[version](rows, facts), version + 1
        return self._write(rows, dim, expected=facts["version"])

    def load(self, dim: int | None = None) -> DataFrame | None:
        """The chunks with ``vec`` as arrays; None where there are none, or damaged ones, or ones of a foreign version or another dimension than asked for."""
        facts = self.facts()
        if facts is None or not isinstance(facts["store_version"], int) or not 1 <= facts["store_version"] <= STORE_VERSION:
            return None
        if dim is not None and facts.get("dim", dim) != dim:
            return None
        rows = self.store.load()
        kinds = {"path": "string", "mtime": "bigint", "size": "bigint", "chunk_ix": "int", "line_start": "int"}
        if rows is None or any(dict(rows.dtypes).get(c) != k for c, k in kinds.items()):
            return None
        if facts["store_version"] == 1:
            return rows
        counted = rows.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.coalesce(F.octet_length("vec") != 2 * facts.get("dim", 0), F.lit(True))).alias("odd")).first()
        return unpacked(rows) if counted.n == facts.get("chunks") and not counted.odd else None
