"""Folding a burst of file changes into an index."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


#: Touched paths, and bytes of them, up to which they are broadcast; beyond it the folders of all rows are joined with them.
FEW, FEW_BYTES = 100_000, 16 << 20


def ancestors(path: str = "path"):
    """All folders above a path, without slash at the end: a prefix join becomes an equi-join on these."""
    bare = F.regexp_replace(F.col(path), "/+$", "")
    parts = F.split(bare, "/")
    return F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda k: F.array_join(F.slice(parts, 1, k), "/"))


def without(current: DataFrame, touched: DataFrame) -> DataFrame:
    """``current`` less the touched paths and all that lies below them.

    A small burst is broadcast, once for each depth of its paths: rows meet it by their first
    so many names, so nothing is shuffled.
    """
    bare = touched.select(F.regexp_replace("path", "/+$", "").alias("gone")).where("gone is not null").distinct()
    bare = bare.withColumn("depth", F.size(F.split("gone", "/")))
    facts = bare.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length("gone")), F.lit(0)).alias("size"), F.collect_set("depth").alias("depths")).first()
    rows = current.withColumn("bare", F.regexp_replace("path", "/+$", ""))
    if facts.n <= FEW and facts.size <= FEW_BYTES:
        for depth in sorted(facts.depths):
            own = bare.where(F.col("depth") == depth).select("gone")
            rows = rows.join(F.broadcast(own), F.substring_index("bare", "/", depth) == F.col("gone"), "left_anti")
        return rows.drop("bare")
    bare = bare.select("gone")
    rest = rows.join(bare, F.col("bare") == F.col("gone"), "left_anti").drop("bare")
    names = rest.select("path", F.explode(ancestors()).alias("folder"))
    below = names.join(bare, F.col("folder") == F.col("gone"), "left_semi").select("path").distinct()
    return rest.join(below, "path", "left_anti")


def folded(current: DataFrame, touched: DataFrame, fronts: DataFrame, burst: int = 0) -> DataFrame:
    """The next index: what the touched paths are now, ahead of what the burst left alone.

    ``fronts`` holds the present state of touched files and folders (path, mtime, size), the
    entries of touched folders included; missing ones have none.  Its rows get ``burst``,
    so that a later burst's rows stand before an earlier one's.
    """
    first = fronts.dropDuplicates(["path"]).select("path", "mtime", "size")
    kept = without(current, touched.select("path").unionByName(first.select("path")))
    if "burst" in current.columns:
        return first.withColumn("burst", F.lit(burst).cast("long")).unionByName(kept.select("path", "mtime", "size", "burst"))
    return first.unionByName(kept.select("path", "mtime", "size"))


def last_changes(events: DataFrame) -> DataFrame:
    """(path, seq, kind): the last change of each path."""
    return events.groupBy("path").agg(F.max("seq").alias("seq"), F.max_by("kind", "seq").alias("kind"))
