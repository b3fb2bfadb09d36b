"""The training-data pipeline: five stages over ``documents``, each written as Parquet and read again."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathloom.llm.exact_dedup import deduplicated
from pathloom.llm.jaccard_join import joined
from pathloom.llm.mixing import mixed
from pathloom.llm.piece_bpe import encoded
from pathloom.llm.quality import scored, trained
from pathloom.llm.queries import piece_model
from pathloom.llm.shared import owned, read_table, scratch_path, small

#: SQL can't express the classifier, so the rows are tested against brute force.
ORACLE_SQL = None


#: Columns that stages read by these names; all others go through under names of their own.
OWN = ("doc_id", "text", "lang", "source", "n_chars")


def apart(stage: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """The stage over columns that no working column of an operator can clash with; they come out as they went in."""

    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        names = [c if c in OWN else f"__column_{k}" for k, c in enumerate(docs.columns)]
        return stage(spark, docs.toDF(*names), sf_dir).toDF(*docs.columns)

    return run_stage


@apart
def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents the classifier accepts; the model learns from all documents' labels outside the held-out fold.

    A null text is scored as an empty one; rows with one id are each scored by their own text;
    equal texts have equal scores; an empty table gives an empty one, other columns stay.
    """
    model = trained(docs, read_table(spark, sf_dir, "labels"))
    return scored(docs, model, keep=docs.columns).where("predicted = 1").select(*docs.columns)


def _without(docs: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    """``docs`` less the rows listed; the list is broadcast if counted small, so texts stay where they are."""
    on = [docs[k].eqNullSafe(gone[f"gone_{k}"]) for k in keys]
    return docs.join(F.broadcast(gone) if small(gone) else gone, on, "left_anti")


@apart
def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts; one listed twice under its id stays once."""
    found = deduplicated(docs)
    gone = found.where(~F.col("kept")).select(F.col("doc_id").alias("gone_doc_id"), F.col("text_sha256").alias("gone_sha")).distinct()
    marked = docs.withColumn("sha", F.sha2(F.coalesce("text", F.lit("")), 256))
    kept = _without(marked, gone, ["doc_id", "sha"]).drop("sha")
    again = found.where("kept and group_size > 1").groupBy("doc_id", "text_sha256").count().where("count > 1")
    return kept.dropDuplicates(["doc_id", "text"]) if again.take(1) else kept


@apart
def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each component of near-equal ones.

    Documents without shingles (null and empty texts among them) and rows without an id stay;
    rows with one id stay or go together; an empty table gives an empty one, other columns stay.
    """
    gone = joined(docs).where("doc_id <> component_id").select(F.col("doc_id").alias("gone_doc_id")).distinct()
    return _without(docs, gone, ["doc_id"]).select(*docs.columns)


@apart
def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as the mix takes it, none to three; those without words, null texts among them, aren't taken.

    A null source is a source; ties go by a hash of the row, so reruns agree; an empty table
    gives an empty one, other columns stay.
    """
    return mixed(docs, keep=docs.columns).where("copies > 0").withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).select(*docs.columns)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as token ids, with digests of ids and of the text decoded from them.

    A null text is encoded as an empty one; repeated rows give repeated results; an empty
    table gives an empty one; of the columns the id, language and source stay.
    """
    return encoded(docs, piece_model(), keep=["doc_id", "lang", "source"], with_text=False)


STAGES = [
    ("quality classifier", quality_stage),
    ("exact dedup", exact_stage),
    ("n-gram Jaccard join", near_stage),
    ("mixing sources to target weights", mixing_stage),
    ("SentencePiece encoding and decoding", encoding_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``.  Each stage's table is in the shared folder, so a lost executor costs one stage at most."""
    docs = read_table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        path = scratch_path(spark, f"stage{k}")
        out = stage(spark, docs, sf_dir)
        out.write.parquet(path)
        owned(spark, path)
        docs = spark.read.schema(out.schema).parquet(path)
    return docs
