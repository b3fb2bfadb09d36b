"""A request and the corpus tables to one DataFrame."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.calc import evaluate, shown
from ..operators.content import CONTENT_LIMIT, MAX_BYTES, grep
from ..operators.predicates import QUIET
from ..operators.rank import FILENAME_LIMIT, filename_search, visible
from ..operators.semantic import HASH_DIM, hash_vector, semantic_search
from ..request import Request, parse


@dataclass
class Corpus:
    """The tables a query reads; those a mode doesn't need may be left out."""

    files: DataFrame
    texts: DataFrame | None = None
    chunks: DataFrame | None = None
    boosts: DataFrame | None = None
    quiet: tuple[str, ...] = QUIET
    max_bytes: int = MAX_BYTES


def hash_query(spark: SparkSession, text: str, dim: int = HASH_DIM) -> list[float]:
    row = spark.createDataFrame([(text,)], "text string").select(hash_vector(F.col("text"), dim).alias("v")).first()
    return list(row.v)




def plan(spark: SparkSession, corpus: Corpus, request: Request, *, limit: int | None = None, embed=None, content_limit: int | None = CONTENT_LIMIT) -> DataFrame:
    if request.mode == "calc":
        value = evaluate(request.pattern)
        return spark.createDataFrame([] if value is None else [(request.pattern, shown(value))], "expression string, result string")
    if request.mode == "content":
        texts = corpus.texts
        return grep(texts, request.pattern, request.filters, limit=content_limit, max_bytes=corpus.max_bytes) if request.pattern else grep(texts, "x").limit(0)
    if request.mode == "semantic":
        query = (embed or (lambda t: hash_query(spark, t)))(request.pattern)
        found = semantic_search(corpus.chunks, query, request.filters, files=corpus.files)
        return found if request.pattern else found.limit(0)
    return filename_search(corpus.files, request, boosts=corpus.boosts, quiet_patterns=corpus.quiet, limit=limit or FILENAME_LIMIT)


def script_search(spark: SparkSession, corpus: Corpus, text: str, now: int, **options) -> tuple[DataFrame, DataFrame]:
    """(rows to print, all rows): no boosts, no regex switch, strong rows only, no limit on lines."""
    request = parse(text, now, script=True)
    plain = Corpus(corpus.files, corpus.texts, corpus.chunks, None, corpus.quiet, corpus.max_bytes)
    rows = plan(spark, plain, request, content_limit=None, **options)
    return (visible(rows) if "is_strong" in rows.columns else rows), rows


def filter_lines(spark: SparkSession, lines: DataFrame, text: str, now: int, *, regex: bool = False, limit: int = FILENAME_LIMIT) -> DataFrame:
    """The same matcher over lines: prefixes are text, no boosts, nothing is quiet."""
    request = parse(text, now, regex=regex, lines=True)
    return filename_search(lines, request, quiet_patterns=(), limit=limit)
