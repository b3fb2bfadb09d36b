"""Line inputs and history files."""

from __future__ import annotations

import warnings
from typing import BinaryIO

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.history import COMPACT_OVER, compacted, formatted, needs_compaction, parsed
from .snapshot import SnapshotStore

LINE_CAP = 500_000


def from_lines(spark: SparkSession, values: list[str]) -> DataFrame:
    """(ord, path) of lines as they came, blank ones left out, the first ``LINE_CAP`` of them."""
    kept = [v.rstrip("\n") for v in values if v.strip()]
    if len(kept) > LINE_CAP:
        warnings.warn(f"only the first {LINE_CAP} lines are searched", stacklevel=2)
        kept = kept[:LINE_CAP]
    return spark.createDataFrame([(k, v, 0, 0) for k, v in enumerate(kept)], "ord long, path string, mtime long, size long")


def utf8_lines(stream: BinaryIO) -> list[str]:
    """The lines of a byte stream up to the first that isn't UTF-8, as far as the cap needs them."""
    out, seen = [], 0
    for raw in stream:
        try:
            line = raw.decode()
        except UnicodeDecodeError:
            break
        out.append(line)
        seen += bool(line.strip())
        if seen > LINE_CAP:
            break
    return out


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """All lines of text files that aren't blank, in the files' order; being distributed, they need no cap."""
    rows = spark.read.text(path, wholetext=False).withColumn("ord", F.monotonically_increasing_id()).where(F.trim("value") != "")
    return rows.select("ord", F.col("value").alias("path"), F.lit(0).cast("long").alias("mtime"), F.lit(0).cast("long").alias("size"))


def read_history(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return parsed(spark.read.text(path))


def append_opens(opens: DataFrame, path: str) -> None:
    """Appends opens (ts, count, path) as text files of the history folder."""
    formatted(opens).write.mode("append").text(path)


def read_queries(spark: SparkSession, path: str) -> DataFrame:
    """(seq, q) of a query history folder, by file time and line."""
    rows = spark.read.text(path).select(F.col("_metadata.file_modification_time").alias("at"), F.col("_metadata.file_name").alias("file"), F.monotonically_increasing_id().alias("line"), F.col("value").alias("q"))
    return rows.orderBy("at", "file", "line").select(F.monotonically_increasing_id().alias("seq"), "q")


def append_query(spark: SparkSession, path: str, query: str) -> None:
    if query.strip():
        spark.createDataFrame([(query.strip(),)], "value string").coalesce(1).write.mode("append").text(path)


def hits_as_lines(hits: DataFrame) -> DataFrame:
    """Hits as printed: path; path:line:text; path:line:score."""
    if "line" in hits.columns:
        shown = F.concat_ws(":", "path", F.col("line_number").cast("string"), "line")
    elif "line_start" in hits.columns:
        shown = F.concat_ws(":", "path", F.col("line_start").cast("string"), F.format_string("%.2f", "score"))
    else:
        shown = F.col("path")
    out = hits.select(*[c for c in ("rank",) if c in hits.columns], shown.alias("value"))
    return out.orderBy("rank") if "rank" in out.columns else out


def numbered(rows: DataFrame, order: list) -> DataFrame:
    return rows.withColumn("ord", F.row_number().over(Window.orderBy(*order)).cast("long"))


class HistoryLog:
    """The open history: a base table and text files of later opens, which are merged into it when they are many."""

    def __init__(self, spark: SparkSession, root: str, *, most: int = COMPACT_OVER):
        self.spark, self.root, self.most = spark, root.rstrip("/"), most
        self.base = SnapshotStore(spark, f"{self.root}/base")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path(f"{self.root}/log"))

    def append(self, opens: DataFrame) -> None:
        append_opens(opens, f"{self.root}/log")

    def _files(self) -> list[str]:
        """The log's files that the base doesn't hold yet.  One that was merged, but not deleted, is not read again."""
        merged = set((self.base.current() or {}).get("merged", []))
        each = (s.getPath().getName() for s in self._fs.listStatus(self._path(f"{self.root}/log")))
        return sorted(f for f in each if f.startswith("part-") and f not in merged)

    def _read(self, files: list[str]) -> DataFrame:
        rows = self.base.load()
        rows = self.spark.createDataFrame([], "ts long, count long, path string") if rows is None else rows.select("ts", "count", "path")
        return rows.unionByName(read_history(self.spark, [f"{self.root}/log/{f}" for f in files])) if files else rows

    def load(self) -> DataFrame:
        """All opens (ts, count, path); a history of too many rows is compacted on the way."""
        if needs_compaction(self._read(self._files())):
            self.compact()
        return self._read(self._files())

    def compact(self) -> bool:
        """One row a path as the new base.  Opens appended meanwhile stay in the log; False if another process compacted first."""
        now, files = self.base.current(), self._files()
        done = self.base.publish(compacted(self._read(files)), expected=now["version"] if now else 0, ordered=False, merged=files)
        if done is None:
            return False
        for f in files:  # the manifest names them, so a stop on the way loses and doubles nothing
            self._fs.delete(self._path(f"{self.root}/log/{f}"), False)
        return True
