"""Open history and query history: sums, boosts, compaction, the last distinct queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

COMPACT_OVER, QUERY_CAP, COUNT_MAX = 20_000, 100, (1 << 32) - 1


def parsed(lines: DataFrame) -> DataFrame:
    """(ts, count, path) of text lines ``value``; what doesn't parse is left out, paths may hold tabs."""
    parts = F.split("value", "\t", 3)
    rows = lines.select(F.try_element_at(parts, F.lit(1)).try_cast("bigint").alias("ts"), F.try_element_at(parts, F.lit(2)).try_cast("bigint").alias("count"), F.try_element_at(parts, F.lit(3)).alias("path"))
    return rows.where("ts is not null and count between 0 and 4294967295 and path is not null")


def summed(opens: DataFrame) -> DataFrame:
    """(path, count, last): one row a path."""
    return opens.groupBy("path").agg(F.least(F.sum("count"), F.lit(COUNT_MAX)).alias("count"), F.max("ts").alias("last"))


def boosts(opens: DataFrame, now: int) -> DataFrame:
    """(path, boost): how lately and how often a path was opened."""
    age = F.lit(now) - F.col("last")
    lately = F.when(age < 3600, 48).when(age < 86_400, 40).when(age < 604_800, 28).otherwise(16)
    return summed(opens).select("path", (lately + F.least("count", F.lit(10)) * 4).cast("int").alias("boost"))


def compacted(opens: DataFrame) -> DataFrame:
    """The history as one row a path."""
    return summed(opens).select(F.col("last").alias("ts"), "count", "path")


def needs_compaction(opens: DataFrame) -> bool:
    return opens.limit(COMPACT_OVER + 1).count() > COMPACT_OVER


def formatted(opens: DataFrame) -> DataFrame:
    return opens.select(F.concat_ws("\t", F.col("ts").cast("string"), F.col("count").cast("string"), "path").alias("value"))


def last_queries(queries: DataFrame, cap: int = QUERY_CAP) -> DataFrame:
    """(seq, q): the last ``cap`` distinct queries at their last places, oldest first."""
    latest = queries.where(F.trim("q") != "").groupBy("q").agg(F.max("seq").alias("seq"))
    return latest.orderBy(F.desc("seq")).limit(cap).select("seq", "q").orderBy("seq")
