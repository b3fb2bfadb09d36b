"""Changes of files folded into snapshots by Structured Streaming; a micro-batch is a burst."""

from __future__ import annotations

import os
import time
from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.changes import folded
from ..operators.predicates import not_excluded
from ..sources.scratch import stored
from ..sources.snapshot import SnapshotStore
from ..sources.walk import below, entry, walked

DEBOUNCE, SAVE_EVERY = "400 milliseconds", 60.0


def present_state(touched: DataFrame, excludes: list[str]) -> DataFrame:
    """(path, mtime, size) of what touched paths are now; a folder brings all its entries.  Events say only where to look."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [found for path in batch.path if (found := entry(path.rstrip("/") or "/"))]
            yield pd.DataFrame(rows, columns=["path", "mtime", "size"]).astype({"mtime": "int64", "size": "int64"})

    spark = touched.sparkSession
    own = spark.read.schema("path string, mtime long, size long").parquet(stored(touched.select("path").distinct().mapInPandas(run, "path string, mtime long, size long"), "touched"))
    folders = own.where("path like '%/'").select("path")
    if folders.isEmpty():
        return own
    return own.unionByName(below(folders, excludes).where("state = 'found'").select("path", "mtime", "size")).dropDuplicates(["path"])


class IndexStream:
    """Keeps a snapshot store up to date from a stream of touched paths."""

    def __init__(self, store: SnapshotStore, excludes: list[str] = (), *, save_every: float = 0.0, state: Callable[[DataFrame], DataFrame] | None = None):
        self.store, self.excludes, self.save_every = store, list(excludes), save_every
        self.state = state or (lambda touched: present_state(touched, self.excludes))
        self.saved: float | None = None

    def fold(self, batch: DataFrame, batch_id: int) -> None:
        """One burst.  It is in the store before Spark counts it as done, so bursts that wait for the next save outlive the driver.

        Replaying one is harmless: states are looked up again.
        """
        self.store.enqueue(not_excluded(batch.select("path").distinct(), self.excludes))
        if self.saved is None or time.monotonic() - self.saved >= self.save_every:
            self.flush()

    def flush(self) -> None:
        """Folds all waiting bursts into the next version; they go on waiting if another writer published in between."""
        folders = self.store.waiting()
        if not folders:
            return
        seen = self.store.spark.read.schema("path string").parquet(*folders).distinct()
        if not seen.isEmpty():
            current, version = self._current()
            rows = folded(current, seen, self.state(seen), burst=version + 1)
            if not self._publish(rows, version):
                return
        self.saved = time.monotonic()
        self.store.forget(folders)

    def reconcile(self, roots: list[str]) -> None:
        """Makes the entries below the roots what a full walk finds, deletions while nothing watched included."""
        below = [os.path.abspath(r) for r in roots if os.path.isdir(r)]
        if not below:
            return
        current, version = self._current()
        now = walked(self.store.spark, below, self.excludes, dedupe=True).where("state = 'found'").select("path", F.col("mtime").alias("mtime_now"), F.col("size").alias("size_now"))
        inside = reduce(lambda a, b: a | b, (F.startswith(F.col("path"), F.lit(r.rstrip("/") + "/")) for r in below))
        found = F.col("mtime_now").isNotNull()
        same = F.col("mtime").eqNullSafe(F.col("mtime_now")) & F.col("size").eqNullSafe(F.col("size_now"))
        rows = current.join(now, "path", "full_outer").where(found | ~inside)
        rows = rows.select("path", F.coalesce("mtime_now", "mtime").alias("mtime"), F.coalesce("size_now", "size").alias("size"), F.when(found & ~same, version + 1).otherwise(F.col("burst")).cast("long").alias("burst"))
        self._publish(rows, version)

    def _current(self) -> tuple[DataFrame, int]:
        manifest, current = self.store.current(), self.store.load()
        if current is None:
            current = self.store.spark.createDataFrame([], "path string, mtime long, size long, burst long")
        if "burst" not in current.columns:
            current = current.withColumn("burst", F.lit(0).cast("long"))
        return current.select("path", "mtime", "size", "burst"), manifest["version"] if manifest else 0

    def _publish(self, rows: DataFrame, version: int) -> bool:
        rows = rows.orderBy(F.desc("burst"), F.desc("mtime"), "path").withColumn("ord", F.monotonically_increasing_id())
        return self.store.publish(rows, expected=version) is not None

    def start(self, events: DataFrame, checkpoint: str, *, available_now: bool = False, roots: list[str] = ()) -> StreamingQuery:
        """Folds what waits from an earlier run, takes in what changed below ``roots`` meanwhile, then follows the stream."""
        self.flush()
        self.reconcile(list(roots))
        writer = events.writeStream.foreachBatch(self.fold).option("checkpointLocation", checkpoint)
        return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=DEBOUNCE)).start()
