"""Ranking: index order, boosts, quiet places, fuzzy scores, the strong part, top rows."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import fuzzy
from ..functions.columns import basename
from ..request import Filters, Request, java_pattern
from .predicates import QUIET, atom_predicate, predicate, quiet

FILENAME_LIMIT, BIG_LIMIT, MIN_KEEP = 500, 20, 8


def index_order(rows: DataFrame) -> list[Column]:
    """The rank of a row in its index: the stored ordinal, or newest first and then by path."""
    return [F.col("ord")] if "ord" in rows.columns else [F.desc("mtime"), F.asc("path")]


def with_ordinals(rows: DataFrame) -> DataFrame:
    """Rows in index order with a growing ``ord``; range partitions, so no task holds all rows."""
    return rows.orderBy(F.desc("mtime"), "path").withColumn("ord", F.monotonically_increasing_id())


def boosted(rows: DataFrame, boosts: DataFrame | None) -> DataFrame:
    """Adds ``boost`` (null where a path was never opened).  The history is bounded by its compaction, but counted by Spark's own statistics."""
    if boosts is None:
        return rows.withColumn("boost", F.lit(None).cast("int"))
    return rows.join(boosts.select("path", "boost"), "path", "left")


def top(rows: DataFrame, order: list[Column], limit: int | None) -> DataFrame:
    """The first rows with their ``rank`` from 1.  The limit runs as a top-k before the one small window."""
    cut = rows.orderBy(*order)
    cut = cut.limit(limit) if limit is not None else cut
    return cut.withColumn("rank", F.row_number().over(Window.orderBy(*order)).cast("long"))


def head(rows: DataFrame, *, boosts: DataFrame | None = None, demote: bool = True, quiet_patterns: tuple[str, ...] = QUIET, limit: int = FILENAME_LIMIT) -> DataFrame:
    """What an empty query shows: opened rows by boost, other rows, quiet ones; all but the last are strong."""
    rows = boosted(rows, boosts)
    bucket = F.when(F.col("boost").isNotNull(), 0).when(quiet(quiet_patterns) if demote else F.lit(False), 2).otherwise(1)
    rows = rows.withColumn("bucket", bucket)
    order = [F.col("bucket"), F.desc(F.when(F.col("bucket") == 0, F.col("boost"))), *index_order(rows)]
    return top(rows, order, limit).withColumn("is_strong", F.col("bucket") < 2).withColumn("recent_open", F.col("boost").isNotNull()).drop("bucket")


def regex_ranked(rows: DataFrame, pattern: str, *, boosts: DataFrame | None = None, limit: int = FILENAME_LIMIT) -> DataFrame:
    """Paths a pattern matches: opened rows by boost first, then index order; all strong."""
    rows = boosted(rows.where(F.col("path").rlike(java_pattern(pattern))), boosts)
    order = [F.desc(F.coalesce("boost", F.lit(0))), *index_order(rows)]
    return top(rows, order, limit).withColumn("is_strong", F.lit(True)).withColumn("recent_open", F.col("boost").isNotNull())


def _fuzzy_scores(paths: list[str], names: list[str], pattern: str) -> np.ndarray:
    """The path's score plus the name's, if that matches too; -1 where the path doesn't match."""
    whole = fuzzy.scores(paths, pattern)
    return whole + fuzzy.scores(names, pattern).clip(min=0) * (whole >= 0)


def _may_match(rows: DataFrame, pattern: str) -> DataFrame:
    """Rows that the ASCII atoms of a pattern let through, told natively before anything is scored."""
    for atom in fuzzy.atoms(pattern):
        if atom.text.isascii():
            rows = rows.where(atom_predicate(atom))
    return rows


def scored(rows: DataFrame, pattern: str) -> DataFrame:
    """Rows a fuzzy pattern matches, with ``score``.

    The scorer is marked nondeterministic so that filtering on its result doesn't run it twice.
    """

    @F.pandas_udf("long")
    def score(paths: pd.Series, names: pd.Series) -> pd.Series:
        return pd.Series(_fuzzy_scores(paths.fillna("").tolist(), names.fillna("").tolist(), pattern))

    return _may_match(rows, pattern).withColumn("score", score.asNondeterministic()("path", basename(F.col("path")))).where("score >= 0")


def _with_strong(bars: DataFrame, demote: bool) -> DataFrame:
    """Adds ``strong``, how many rows are strong, to a small table of (is_quiet, score, n).

    The block that counts is the rows outside quiet places, if there are both kinds; strong
    are its rows with at least half its best score, eight at least.
    """
    over_all = Window.partitionBy(F.lit(0))
    loud = F.sum(F.when(~F.col("is_quiet"), F.col("n")).otherwise(0)).over(over_all)
    facts = bars.select("*", loud.alias("loud"), F.sum("n").over(over_all).alias("rows"), F.max("score").over(over_all).alias("best"), F.max(F.when(~F.col("is_quiet"), F.col("score"))).over(over_all).alias("loud_best"))
    mixed = F.lit(demote) & (F.col("loud") > 0) & (F.col("loud") < F.col("rows"))
    facts = facts.select(*bars.columns, mixed.alias("mixed"), F.when(mixed, F.col("loud")).otherwise(F.col("rows")).alias("block"), F.when(mixed, F.expr("loud_best div 2")).otherwise(F.expr("best div 2")).alias("floor"))
    counts = (~F.col("mixed") | ~F.col("is_quiet")) & (F.col("score") >= F.col("floor"))
    strong = F.greatest(F.sum(F.when(counts, F.col("n")).otherwise(0)).over(over_all), F.least(F.lit(MIN_KEEP), F.col("block")))
    return facts.select(*bars.columns, strong.alias("strong"))


def strong_part(rows: DataFrame, *, demote: bool = True, limit: int = FILENAME_LIMIT) -> DataFrame:
    """Ranks rows that come with their score and is_quiet, and marks the strong ones.

    One row of aggregates is joined back, so no window spans all rows.
    """
    bars = rows.groupBy("is_quiet", "score").agg(F.count(F.lit(1)).alias("n"))  # as many as there are scores
    strong = _with_strong(bars, demote).agg(F.max("strong").alias("strong"))
    order = ([F.col("is_quiet")] if demote else []) + [F.desc("score"), *index_order(rows)]
    return top(rows, order, limit).join(F.broadcast(strong)).withColumn("is_strong", F.col("rank") <= F.col("strong")).drop("strong")


def _best_and_bars(tables: Iterator[pa.Table], order: list[tuple[str, str]], limit: int) -> Iterator[pa.RecordBatch]:
    """The first ``limit`` rows of a partition (n = 0), and how many rows each score has (n > 0, other columns null)."""
    best, bars, schema = None, Counter(), None
    for table in tables:
        schema, counted = table.schema, pc.greater(table["n"], 0)
        for row in table.filter(counted).select(["is_quiet", "score", "n"]).to_pylist():
            bars[row["is_quiet"], row["score"]] += row["n"]
        rows = table.filter(pc.invert(counted))
        rows = rows if best is None else pa.concat_tables([best, rows])
        best = rows.take(pc.sort_indices(rows, sort_keys=order)[:limit]).combine_chunks()
    if schema is None:
        return
    part = TaskContext.get().partitionId()
    given = {"is_quiet": [q for q, _ in bars], "score": [s for _, s in bars], "n": list(bars.values()), "part": [part] * len(bars)}
    counts = pa.table([pa.array(given[f.name], f.type) if f.name in given else pa.nulls(len(bars), f.type) for f in schema], schema=schema)
    best = best.set_column(schema.get_field_index("part"), schema.field("part"), pa.array([part] * len(best), pa.int32()))
    yield from pa.concat_tables([best, counts]).to_batches()


def _in_one_pass(rows: DataFrame, grade: Callable[[pa.Table], np.ndarray], *, demote: bool, limit: int) -> DataFrame:
    """Grades every row once (-1: no match); of each partition only its first rows and the counts of its scores go on.

    These are merged by groups of partitions, then in one task, which so sees some hundred
    rows and scores a group, however many rows there are.
    """
    index = [("ord", "ascending")] if "ord" in rows.columns else [("mtime", "descending"), ("path", "ascending")]
    order = ([("is_quiet", "ascending")] if demote else []) + [("score", "descending"), *index]
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in rows.schema] + [T.StructField("score", T.LongType()), T.StructField("n", T.LongType()), T.StructField("part", T.IntegerType())])

    def graded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def tables() -> Iterator[pa.Table]:
            for batch in batches:
                table = pa.Table.from_batches([batch])
                score = grade(table)
                table = table.append_column("score", pa.array(score, pa.int64())).append_column("n", pa.array(np.zeros(len(score)), pa.int64())).append_column("part", pa.array(np.zeros(len(score)), pa.int32()))
                table = table.filter(pa.array(score >= 0))
                quiet_score, n = np.unique(np.stack([table["is_quiet"].to_numpy().astype(np.int64), table["score"].to_numpy()]), axis=1, return_counts=True)
                given = {"is_quiet": quiet_score[0].astype(bool), "score": quiet_score[1], "n": n, "part": np.zeros(len(n))}
                yield table
                yield pa.table([pa.array(given[f.name], f.type) if f.name in given else pa.nulls(len(n), f.type) for f in table.schema], schema=table.schema)

        return _best_and_bars(tables(), order, limit)

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _best_and_bars((pa.Table.from_batches([b]) for b in batches), order, limit)

    found = _with_strong(rows.mapInArrow(graded, schema).repartition("part").mapInArrow(merged, schema), demote)
    places = ([F.col("is_quiet")] if demote else []) + [F.desc("score"), *index_order(rows)]
    ranked = top(found.where("n = 0"), places, limit)
    return ranked.withColumn("is_strong", F.col("rank") <= F.col("strong")).drop("strong", "n", "part")


def fuzzy_ranked(rows: DataFrame, pattern: str, *, boosts: DataFrame | None = None, demote: bool = True, quiet_patterns: tuple[str, ...] = QUIET, limit: int = FILENAME_LIMIT) -> DataFrame:
    rows = boosted(_may_match(rows, pattern), boosts).withColumn("is_quiet", quiet(quiet_patterns)).withColumn("__name", basename(F.col("path")))

    def grade(table: pa.Table) -> np.ndarray:
        score = _fuzzy_scores([p or "" for p in table["path"].to_pylist()], [p or "" for p in table["__name"].to_pylist()], pattern)
        total = score + pc.fill_null(table["boost"], 0).to_numpy()
        total = np.where(table["is_quiet"].to_numpy() & demote, total * 2 // 5, total)
        return np.where(score >= 0, total, -1)

    ranked = _in_one_pass(rows, grade, demote=demote, limit=limit)
    return ranked.drop("__name").withColumn("recent_open", F.col("boost").isNotNull())


def filename_search(rows: DataFrame, request: Request, *, boosts: DataFrame | None = None, quiet_patterns: tuple[str, ...] = QUIET, limit: int = FILENAME_LIMIT) -> DataFrame:
    """Filename modes: filters, then head, regex or fuzzy ranking."""
    demote = not request.path_intent
    rows = rows.where(predicate(request.filters))
    if not request.pattern:
        return head(rows, boosts=boosts, demote=demote, quiet_patterns=quiet_patterns, limit=limit)
    if request.mode == "regex":
        return regex_ranked(rows, request.pattern, boosts=boosts, limit=limit)
    return fuzzy_ranked(rows, request.pattern, boosts=boosts, demote=demote, quiet_patterns=quiet_patterns, limit=limit)


def big_files(rows: DataFrame, limit: int = BIG_LIMIT) -> DataFrame:
    """The largest files; ties in index order."""
    return top(rows.where(predicate(Filters())), [F.desc("size"), *index_order(rows)], limit)


def launch_sections(ranked: DataFrame) -> DataFrame:
    """The leading run of opened rows is one section, the rest the other."""
    run = F.min(F.col("recent_open").cast("int")).over(Window.orderBy("rank").rowsBetween(Window.unboundedPreceding, 0))
    return ranked.withColumn("section", F.when(run == 1, "recent opens").otherwise("recently modified"))


def visible(ranked: DataFrame, show_weak: bool = False) -> DataFrame:
    return ranked if show_weak else ranked.where("is_strong")


def marked_paths(ranked: DataFrame, marks: DataFrame) -> DataFrame:
    """Marked paths among the rows, each once, at its first place."""
    return ranked.join(marks.select("path").distinct(), "path", "left_semi").groupBy("path").agg(F.min("rank").alias("rank"))
