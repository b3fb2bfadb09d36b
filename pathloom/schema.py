"""Tables of the engine and the adapters that derive them from the star-schema test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

FORMAT_VERSION = 3

FILES = T.StructType([T.StructField("path", T.StringType()), T.StructField("mtime", T.LongType()), T.StructField("size", T.LongType())])
OPENS = T.StructType([T.StructField("ts", T.LongType()), T.StructField("count", T.LongType()), T.StructField("path", T.StringType())])
LINE_HITS = T.StructType([T.StructField("path", T.StringType()), T.StructField("line_number", T.LongType()), T.StructField("line", T.StringType())])

#: The time at which the adapters' history is read: 2024-02-01.
NOW = 1_706_745_600

#: One text for both engines: the corpus as files.  Extension, root, size and time follow from the document.
FILES_SQL = """
SELECT doc_id,
       concat(CASE WHEN doc_id % 11 = 0 THEN '/Library' WHEN doc_id % 13 = 0 THEN '/.cache' ELSE '/home' END,
              '/', lang, '/', source, '/doc-', CAST(doc_id AS STRING), '.',
              CASE doc_id % 8 WHEN 0 THEN 'txt' WHEN 1 THEN 'md' WHEN 2 THEN 'pdf' WHEN 3 THEN 'rs' WHEN 4 THEN 'png' WHEN 5 THEN 'mp4' WHEN 6 THEN 'zip' ELSE 'docx' END) AS path,
       1700000000 + (doc_id * 7919) % 5000000 AS mtime,
       CAST(n_chars AS BIGINT) AS size
FROM documents
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, path, mtime, size): the path index of the corpus."""
    return spark.sql(FILES_SQL.replace("FROM documents", "FROM {documents}"), documents=table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars"))


def with_dirs(found: DataFrame) -> DataFrame:
    """Files and their parent directories: a trailing slash, size 0, the newest child's time."""
    parents = found.groupBy(F.regexp_extract("path", "^(.*/)[^/]+$", 1).alias("path")).agg(F.max("mtime").alias("mtime")).select("path", "mtime", F.lit(0).cast("long").alias("size"))
    return found.select("path", "mtime", "size").unionByName(parents)


def doc_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, mtime, size, text)."""
    docs = table(spark, sf_dir, "documents")
    return spark.sql(FILES_SQL.replace("doc_id,\n", "doc_id, text,\n", 1).replace("FROM documents", "FROM {documents}"), documents=docs)


def opens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ts, count, path): one open for each view, of the file its user's number names."""
    views = table(spark, sf_dir, "events").where("event_type = 'view'").select(F.unix_seconds(F.col("ts").cast("timestamp")).alias("ts"), "user_id")
    return views.join(files(spark, sf_dir).select("doc_id", "path"), F.col("user_id") == F.col("doc_id")).select("ts", F.lit(1).cast("long").alias("count"), "path")


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc, chunk_ix, line_start, vec): embeddings as chunks, five a document."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.expr("vec_id div 5").alias("doc"), F.expr("cast(vec_id % 5 as bigint)").alias("chunk_ix"), F.expr("cast((vec_id % 5) * 20 + 1 as bigint)").alias("line_start"), F.col("embedding").cast("array<double>").alias("vec"))


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(conv_id, turn, path): conversation turns as an input of lines, in their order."""
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("text").alias("path"))


def fs_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(seq, kind, path): events as changes of files."""
    e = table(spark, sf_dir, "events").where("event_type <> 'view'")
    kind = F.when(F.col("event_type") == "signup", "create").when(F.col("event_type") == "error", "delete").otherwise("modify")
    return e.join(files(spark, sf_dir).select("doc_id", "path"), F.col("user_id") == F.col("doc_id")).select(F.col("event_id").alias("seq"), kind.alias("kind"), "path")
