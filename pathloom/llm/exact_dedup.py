"""Exact deduplication against immutable snapshots screened by static binary-fuse filters.

A snapshot is two tables: ``entries`` (one row per distinct text: digest, greatest id, count)
and ``filters`` (one binary-fuse filter per digest bucket).  A batch is first grouped on its
own; one row per distinct new text is screened by its bucket's filter; only the positives are
joined with the exact entries of the bucket, and then their bytes are compared.

Only digests of 48 bytes a row are shuffled; texts move only for the positives.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import fuse_filter
from .shared import attached, dropped, small, text_bytes, written

#: Distinct digests a bucket's filter is meant to hold.
BUCKET_KEYS = 50_000
KEY = ["sha", "n_bytes"]


def digest_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, sha, n_bytes) of every row; a null text counts as empty."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).alias("doc_id"), F.unhex(F.sha2(text, 256)).alias("sha"), text_bytes(text_col).alias("n_bytes"))


def grouped(rows: DataFrame) -> DataFrame:
    """One row per digest; the partial aggregate meets hot texts before the shuffle."""
    return rows.groupBy(*KEY).agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))


def _key64():
    return F.xxhash64("sha")


def _bucket(buckets: int):
    return F.pmod(F.hash("sha"), F.lit(buckets))


def build_snapshot(groups: DataFrame, buckets: int) -> tuple[DataFrame, DataFrame]:
    """(entries, filters) of a grouped batch.  A bucket holds about BUCKET_KEYS distinct digests, however hot a text is."""
    entries = written(groups.withColumn("bucket", _bucket(buckets)), "snapshot-entries")

    def make(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"bucket": pdf.bucket.iloc[:1], "bits": [fuse_filter.build(pdf.key.to_numpy("int64").view("uint64"))]})

    filters = entries.select("bucket", _key64().alias("key")).groupBy("bucket").applyInPandas(make, "bucket int, bits binary")
    return entries, written(filters, "snapshot-filters")


def screened(groups: DataFrame, filters: DataFrame, buckets: int) -> DataFrame:
    """The batch's distinct digests that a snapshot may hold."""

    def probe(pdf: pd.DataFrame, bits: pd.DataFrame) -> pd.DataFrame:
        hit = fuse_filter.contains(bits.bits.iloc[0], pdf.key.to_numpy("int64").view("uint64")) if len(bits) and len(pdf) else [False] * len(pdf)
        return pdf.loc[hit, ["sha", "n_bytes", "keep_id"]]

    keyed = groups.select(*KEY, "keep_id", _key64().alias("key"), _bucket(buckets).alias("bucket"))
    id_type = groups.schema["keep_id"].dataType.simpleString()
    return keyed.groupBy("bucket").cogroup(filters.groupBy("bucket")).applyInPandas(probe, f"sha binary, n_bytes long, keep_id {id_type}")


def confirmed(positives: DataFrame, entries: DataFrame, docs: DataFrame, buckets: int, id_col: str, text_col: str) -> DataFrame:
    """Positives that join an exact entry whose bytes are equal: KEY, old_id, old_size."""
    old = entries.select("bucket", *KEY, F.col("keep_id").alias("old_id"), F.col("group_size").alias("old_size"))
    pairs = written(positives.withColumn("bucket", _bucket(buckets)).join(old, ["bucket", *KEY]).drop("bucket"), "positives")
    ends = pairs.select(*KEY, F.explode(F.array_distinct(F.array("keep_id", "old_id"))).alias("end"))
    text = F.coalesce(F.col(text_col), F.lit(""))
    texts = docs.select(F.col(id_col).alias("end"), text.alias("body"))
    found = texts.join(F.broadcast(ends) if small(ends) else ends, "end").where(F.unhex(F.sha2("body", 256)) == F.col("sha"))
    same = found.groupBy(*KEY).agg(F.min("body").alias("low"), F.max("body").alias("high")).where("low = high").select(*KEY)
    nulls = pairs.where("keep_id is null or old_id is null").select(*KEY)  # rows without an id can't be fetched: the digest stands
    return pairs.join(same.unionByName(nulls).distinct(), KEY, "left_semi").drop("keep_id")


def deduplicated(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    The rows are taken in as two batches (by a hash of the id): the first becomes the
    snapshot, the second is screened against it.  Equal texts have equal bytes; the greatest
    doc_id of each group stays.  Null texts equal empty ones; a null doc_id is below all
    others and stays only where its whole group has none; rows with the same doc_id and text
    are one document and are marked alike.  An empty table gives an empty result.  Columns
    beyond ``id_col`` and ``text_col`` are not read.
    """
    rows = written(digest_rows(docs, id_col, text_col).withColumn("batch", F.pmod(F.xxhash64("doc_id"), F.lit(2)).cast("int")), "digests")
    total = rows.count()
    buckets = max(1, -(-total // BUCKET_KEYS))
    old = grouped(rows.where("batch = 0"))
    new = written(grouped(rows.where("batch = 1")), "new-groups")
    entries, filters = build_snapshot(old, buckets)
    both = written(confirmed(screened(new, filters, buckets), entries, docs, buckets, id_col, text_col), "confirmed")

    new_merged = new.join(both, KEY, "left").select(F.lit(1).alias("batch"), *KEY, F.greatest("keep_id", "old_id").alias("keep_id"), (F.col("group_size") + F.coalesce("old_size", F.lit(0))).alias("group_size"))
    back = both.join(new.withColumnsRenamed({"keep_id": "new_id", "group_size": "new_size"}), KEY)
    old_merged = entries.drop("bucket").join(back.select(*KEY, "new_id", "new_size"), KEY, "left").select(F.lit(0).alias("batch"), *KEY, F.greatest("keep_id", "new_id").alias("keep_id"), (F.col("group_size") + F.coalesce("new_size", F.lit(0))).alias("group_size"))
    groups = written(new_merged.unionByName(old_merged).where("group_size > 1"), "groups")
    dropped(entries, filters, both, new)
    return attached(rows, groups, ["batch", *KEY], total).select(
        "doc_id",
        F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.when(F.col("group_size").isNull(), F.lit(True)).otherwise(F.col("doc_id").eqNullSafe(F.col("keep_id"))).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )
