"""Directory walks in rounds: folders are rows, dealt again whenever tasks have done their share.

The folders walked must be visible to the executors (a shared file system on a cluster).
"""

from __future__ import annotations

import os
import re
import stat
import time
from collections import deque
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.predicates import exclude_regex
from .scratch import stored

SCHEMA = "path string, mtime long, size long, state string"
#: Rows of a round: folders not opened yet keep the bytes of their names, which needn't be UTF-8.
ROUND = f"{SCHEMA}, raw binary"
#: Entries that a task lists in the first round before it hands its folders back, how that grows by round, and the most.
SHARE, GROWTH, MOST = 2_000, 5, 100_000
#: Rows that a task holds at once, and folders of a later round to a task at least.
BATCH, TASK_FOLDERS = 10_000, 4


def _shown(path: str) -> str:
    return path.encode("utf-8", "surrogateescape").decode("utf-8", "replace")


def entry(path: str) -> tuple[str, int, int] | None:
    """(path, mtime, size) as indexed: folders end in a slash and have size 0; links and special files are no entries."""
    try:
        s = os.lstat(path)
    except OSError:
        return None
    shown = _shown(path)
    if stat.S_ISDIR(s.st_mode):
        return shown.rstrip("/") + "/", int(s.st_mtime), 0
    return (shown, int(s.st_mtime), s.st_size) if stat.S_ISREG(s.st_mode) else None


def _listed(folder: str, excluded: re.Pattern | None) -> Iterator[tuple[str, int, int, str, str]]:
    """The entries of one folder that aren't excluded, and their paths as the system has them; an unreadable folder comes as state ``skipped``."""
    try:
        with os.scandir(folder) as names:
            for e in names:
                if not (excluded and excluded.match(e.path)) and (found := entry(e.path)):
                    yield *found, "found", e.path
    except OSError:
        yield _shown(folder), 0, 0, "skipped", folder


def apps(folders: list[str], depth: int = 2) -> Iterator[tuple[str, int, int, str]]:
    """Application bundles: ``.app`` folders as files of size 0."""
    for folder in folders:
        todo = [(folder, 1)]
        while todo:
            at, level = todo.pop()
            try:
                names = [e for e in os.scandir(at) if e.is_dir(follow_symlinks=False)]
            except OSError:
                continue
            for e in names:
                if e.name.endswith(".app"):
                    yield e.path, int(e.stat(follow_symlinks=False).st_mtime), 0, "found"
                elif level < depth:
                    todo.append((e.path, level + 1))


@dataclass
class Progress:
    """How far a walk is: rounds done, entries listed, folders known but not opened yet, seconds since it began."""

    rounds: int
    entries: int
    folders_left: int
    seconds: float


def below(folders: DataFrame, excludes: list[str] | tuple[str, ...] = (), *, share: int = SHARE, most: int = MOST, told: Callable[[Progress], None] | None = None) -> DataFrame:
    """(path, mtime, size, state) of all that lies below ``folders`` (path), the folders themselves left out.

    A round's tasks go down breadth first and stop after their share of entries; folders they
    have not opened are dealt anew over all tasks in the next round, so one deep or wide
    folder is soon everyone's work.  Each round is a table in the shared folder.  A single
    folder's own entries are one task's, taken in batches.  Names that aren't UTF-8 are shown
    with replacement characters.  ``told`` hears of every round.
    """
    spark, began = folders.sparkSession, time.monotonic()
    pattern = exclude_regex(list(excludes))  # a bad glob fails here
    tasks = max(2, spark.sparkContext.defaultParallelism)

    def listing(allowed: int):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            excluded, done, out = re.compile(pattern) if pattern else None, 0, []
            frame = lambda rows: pd.DataFrame(rows, columns=["path", "mtime", "size", "state", "raw"]).astype({"mtime": "int64", "size": "int64"})
            for batch in batches:
                todo = deque(os.fsdecode(raw) for raw in batch.raw)
                while todo:
                    folder = todo.popleft()
                    if done >= allowed:
                        out.append((_shown(folder), 0, 0, "todo", os.fsencode(folder)))
                    else:
                        for *row, path in _listed(folder, excluded):
                            done += 1
                            out.append((*row, None))
                            if row[3] == "found" and row[0].endswith("/"):
                                todo.append(path)
                            if len(out) >= BATCH:
                                yield frame(out)
                                out = []
            yield frame(out)

        return run

    rounds, listed, allowed, frontier = [], 0, share, folders.select(F.regexp_replace("path", "(?<=.)/+$", "").cast("binary").alias("raw"))
    while True:
        rounds.append(stored(frontier.mapInPandas(listing(allowed), ROUND), "walk"))
        rows = spark.read.schema(ROUND).parquet(rounds[-1])
        rest = rows.where("state = 'todo'").select("raw")
        facts = rows.agg(F.count_if(F.col("state") == "todo").alias("left"), F.count_if(F.col("state") == "found").alias("found")).first()
        count, listed = facts.left, listed + facts.found
        if told:
            told(Progress(len(rounds), listed, count, time.monotonic() - began))
        if not count:
            return spark.read.schema(SCHEMA).parquet(*rounds).where("state <> 'todo'")
        frontier, allowed = rest.repartition(min(4 * tasks, -(-count // TASK_FOLDERS))), min(most, allowed * GROWTH)


def walked(spark: SparkSession, roots: list[str], excludes: list[str] | tuple[str, ...] = (), *, app_folders: list[str] = (), dedupe: bool = False, share: int = SHARE, told: Callable[[Progress], None] | None = None) -> DataFrame:
    """(path, mtime, size, state) below all roots that exist; overlapping roots give their entries twice unless ``dedupe``."""
    there = [(r,) for r in roots if os.path.isdir(r)]
    rows = below(spark.createDataFrame(there, "path string"), excludes, share=share, told=told)
    found = list(apps(list(app_folders)))
    if found:
        rows = spark.createDataFrame(found, SCHEMA).unionByName(rows)
    return rows.dropDuplicates(["path"]) if dedupe else rows


def walk_stats(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count_if(F.col("state") == "found").alias("files"), F.count_if(F.col("state") == "skipped").alias("skipped"))


def listing(rows: DataFrame, folder: str, limit: int = 200) -> DataFrame:
    """A folder's entries: folders first, then by name."""
    from ..functions.columns import is_dir, parent, path_name

    inside = rows.where(parent(F.col("path")) == folder.rstrip("/") + "/")
    return inside.withColumn("name", path_name(F.col("path"))).orderBy(F.desc(is_dir(F.col("path"))), "name").limit(limit)
