"""Scratch tables, batch sizing and skew-safe joins shared by the operators of this folder."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import word_hash

#: Rows up to which a *counted* table is broadcast; beyond it the shuffle form runs.
BROADCAST_ROWS = 200_000
#: A group is hot if it holds more than 1/HOT_SHARE of all rows, so there are fewer than HOT_SHARE.
HOT_SHARE = 400
#: Bytes after which an Arrow batch on its way to a Python worker ends; rows are whole, so its last one may exceed them.
BATCH_BYTES, BATCH_CONF = 4 << 20, "spark.sql.execution.arrow.maxBytesPerBatch"


def scratch_root(spark: SparkSession) -> str:
    """The shared folder the cluster names; a local one only where none is set (tests)."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="scratch-")  # one machine: driver and executor are one process
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, *, by: list[str] | None = None) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: lineage ends here and lost executors can reread it."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*by) if by else writer).parquet(path)
    owned(spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def bucketed(df: DataFrame, name: str, key: str, onto: DataFrame | None = None) -> DataFrame:
    """``df`` as a table whose files lie by ``key``, or added to such a table: joins on the key move the other side only.

    Rows are dealt out once, and of rows with one key one is kept.
    """
    spark = df.sparkSession
    path, table = (scratch_path(spark, name), f"{name}_{uuid.uuid4().hex}") if onto is None else (onto._scratch, onto._table)
    buckets = max(8, int(spark.conf.get("spark.sql.shuffle.partitions"))) if onto is None else onto._buckets
    rows = df.repartition(buckets, key).dropDuplicates([key])
    rows.write.format("parquet").mode("append").option("path", path).bucketBy(buckets, key).saveAsTable(table)
    if onto is None:
        owned(spark, path)
    out = spark.table(table)
    out._scratch, out._table, out._buckets = path, table, buckets
    return out


def owned(spark: SparkSession, path: str) -> None:
    """Leaves a written folder to the driver's file system, which deletes it when the driver ends: lazy results may read it until then."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(folder)


def dropped(*tables: DataFrame) -> None:
    """Deletes tables of ``written`` and ``bucketed`` that nothing lazy reads any more."""
    for table in tables:
        if hasattr(table, "_table"):
            table.sparkSession.sql(f"DROP TABLE IF EXISTS {table._table}")
        jvm = table.sparkSession._jvm
        path = jvm.org.apache.hadoop.fs.Path(table._scratch)
        path.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def freed(spark: SparkSession) -> None:
    """Lets the context cleaner delete shuffle files of finished rounds, which it does only after a collection."""
    gc.collect()
    spark._jvm.System.gc()


def mapped(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``df.mapInArrow`` whose workers give their memory back: they live on, idle, beside later stages' workers.

    A batch of long texts would fill tens of MB, several times over, in the worker and outside the
    JVM's heap, and neither gives all of it back.  So batches are bounded by bytes, in the whole
    session, unless it sets a bound of its own.
    """
    if df.sparkSession.conf.get(BATCH_CONF, None) is None:
        df.sparkSession.conf.set(BATCH_CONF, BATCH_BYTES)

    def lean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        returned()

    return df.mapInArrow(lean, schema)


def returned() -> None:
    """Gives memory that hashing, Arrow and the C library hold for later back to the system."""
    word_hash.forget()
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """Whether a counted table stays under the broadcast bound (reads at most ``rows`` + 1)."""
    return df.limit(rows + 1).count() <= rows


def attached(rows: DataFrame, groups: DataFrame, keys: list[str], total: int, *, size: str = "group_size", how: str = "left") -> DataFrame:
    """``rows`` joined (``how``: left or inner) with one-row-per-key ``groups`` without a hot key in one task.

    Groups above total / HOT_SHARE rows number fewer than HOT_SHARE by counting, so they are
    broadcast; the others are joined by a shuffle in which no key is large.  Both tables
    should be cheap to read twice.  Keys must not be null.
    """
    hot = groups.where(F.col(size) * HOT_SHARE > F.lit(total))
    cold = groups.where(F.col(size) * HOT_SHARE <= F.lit(total))
    near = rows.join(F.broadcast(hot), keys, "inner")
    rest = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(cold, keys, how)
    return near.unionByName(rest)


def text_bytes(column: str) -> Column:
    return F.coalesce(F.octet_length(F.col(column)), F.lit(0)).cast("long")
