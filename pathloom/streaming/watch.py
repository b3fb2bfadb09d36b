"""Watching folders without holding them: polls are listings in a log, changes come from keyed state.

A poll is one distributed walk whose listing is published as a folder of the log at once, and
the log is read by Spark's file stream.  A burst is therefore a set of files that the stream's
checkpoint names: after a kill the same burst is read again, whatever has changed meanwhile.
What was known of each path (time and size) is kept in Spark's state store by bucket of paths,
which tells new, changed and gone paths.  The driver sees neither listing nor state.
"""

from __future__ import annotations

import json
import threading
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..sources.walk import walked

LISTING = "poll long, bucket long, path string, mtime long, size long"
CHANGES = "poll long, path string, mtime long, size long, state string"
#: Buckets of paths, each with one state row; fixed when a log is made.
BUCKETS = 256
KNOWN = pa.schema([("path", pa.string()), ("mtime", pa.int64()), ("size", pa.int64())])


class PollLog:
    """Numbered listings of the same folders."""

    def __init__(self, spark: SparkSession, folder: str, *, buckets: int = BUCKETS):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark._jsc.hadoopConfiguration())
        settings = self._path(f"{self.folder}/settings.json")
        if not self._fs.exists(settings):
            out = self._fs.create(settings, False)  # one writer makes a log
            out.write(bytearray(json.dumps({"buckets": buckets}).encode()))
            out.close()
        stream = self._fs.open(settings)
        self.buckets = json.loads(bytes(stream.readAllBytes()))["buckets"]
        stream.close()
        self._fs.mkdirs(self._path(f"{self.folder}/listings"))

    def polls(self) -> list[int]:
        each = (s.getPath().getName() for s in self._fs.listStatus(self._path(f"{self.folder}/listings")))
        return sorted(int(name) for name in each if name.isdigit())

    def publish(self, listing: DataFrame) -> int:
        """Adds a listing (path, mtime, size; one row a path) as the next poll.  It appears whole, by one rename."""
        number = (self.polls() or [0])[-1] + 1
        rows = listing.select(F.lit(number).cast("long").alias("poll"), F.pmod(F.xxhash64("path"), F.lit(self.buckets)).alias("bucket"), "path", "mtime", "size")
        # a row without path for each bucket: a bucket that has lost all its paths is looked at too
        every = self.spark.range(self.buckets).select(F.lit(number).cast("long").alias("poll"), F.col("id").alias("bucket"), *(F.lit(None).cast(t).alias(c) for c, t in (("path", "string"), ("mtime", "long"), ("size", "long"))))
        aside = f"{self.folder}/_poll-{number}"
        rows.unionByName(every).write.mode("overwrite").parquet(aside)
        if not self._fs.rename(self._path(aside), self._path(f"{self.folder}/listings/{number}")):
            raise RuntimeError(f"poll {number} is there already: a log has one writer")
        return number

    def poll(self, roots: list[str], excludes: list[str] | tuple[str, ...] = ()) -> int:
        """One walk of the roots, as the next listing."""
        return self.publish(walked(self.spark, roots, excludes, dedupe=True).where("state = 'found'").select("path", "mtime", "size"))

    def prune(self, keep: int = 2) -> None:
        """Deletes the oldest listings; call it only for polls that every reader has taken in."""
        for number in self.polls()[:-keep]:
            self._fs.delete(self._path(f"{self.folder}/listings/{number}"), True)

    def stream(self) -> DataFrame:
        return self.spark.readStream.schema(LISTING).parquet(f"{self.folder}/listings/*")


def _packed(known: pd.DataFrame) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, KNOWN, options=pa.ipc.IpcWriteOptions(compression="lz4")) as out:
        out.write_table(pa.Table.from_pandas(known, schema=KNOWN, preserve_index=False))
    return sink.getvalue().to_pybytes()


def _opened(held: bytes) -> pd.DataFrame:
    return pa.ipc.open_stream(held).read_all().to_pandas()


def compared(known: pd.DataFrame, now: pd.DataFrame) -> pd.DataFrame:
    """(path, mtime, size, state): paths that are new, or whose time or size differ, and those that are gone."""
    both = now.merge(known, on="path", how="outer", suffixes=("", "_old"), indicator="side")
    gone = both.side == "right_only"
    changed = (both.side == "left_only") | ((both.side == "both") & ((both.mtime != both.mtime_old) | (both["size"] != both.size_old)))
    out = both[gone | changed]
    return pd.DataFrame({"path": out.path, "mtime": out.mtime.fillna(0).astype("int64"), "size": out["size"].fillna(0).astype("int64"), "state": out.side.astype(str).map(lambda s: "gone" if s == "right_only" else "changed")})


def _differences(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    rows = pd.concat(list(frames), ignore_index=True)
    known, moved = _opened(state.get[0]) if state.exists else pd.DataFrame({n: pd.Series(dtype=t) for n, t in (("path", "object"), ("mtime", "int64"), ("size", "int64"))}), not state.exists
    for poll in sorted(rows.poll.unique()):  # polls that piled up are taken in one after the other
        now = rows[(rows.poll == poll) & rows.path.notna()][["path", "mtime", "size"]].astype({"mtime": "int64", "size": "int64"})
        found = compared(known, now)
        if len(found):
            moved = True
            yield found.assign(poll=poll)[["poll", "path", "mtime", "size", "state"]]
        known = now
    if moved:
        state.update((_packed(known),))


def changes(listings: DataFrame) -> DataFrame:
    """(poll, path, mtime, size, state) of what differs from the poll before; ``state`` is changed or gone.

    All paths of the first poll are changed ones.  A bucket's known paths are one binary state
    value, rewritten only when they differ.
    """
    return listings.groupBy("bucket").applyInPandasWithState(_differences, CHANGES, "known binary", "append", GroupStateTimeout.NoTimeout)


def watched(log: PollLog) -> DataFrame:
    """The stream of changed paths of a log."""
    return changes(log.stream())


class Poller:
    """Polls in a thread until stopped; a poll that fails is told and tried again at the next turn."""

    def __init__(self, log: PollLog, roots: list[str], excludes: list[str] | tuple[str, ...] = (), *, every: float = 5.0):
        self.log, self.roots, self.excludes, self.every = log, roots, excludes, every
        self.failed: Exception | None = None
        self._stop = threading.Event()
        self._thread = threading.Thread(target=self._run, daemon=True)

    def _run(self) -> None:
        while True:
            try:
                self.log.poll(self.roots, self.excludes)
                self.failed = None
            except Exception as e:  # noqa: BLE001  whatever the file system says
                self.failed = e
            if self._stop.wait(self.every):
                return

    def start(self) -> Poller:
        self._thread.start()
        return self

    def stop(self) -> None:
        self._stop.set()
        self._thread.join()
