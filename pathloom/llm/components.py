"""Connected components by contraction, over tables in the shared folder."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import dropped, mapped, written

#: Links that one task joins; more are contracted by shuffles until no more are left.
TASK_LINKS = 250_000


def least_labels(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, smallest node of the component of each)."""
    nodes, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low, high = np.minimum(label[x], label[y]), np.maximum(label[x], label[y])
        if (low == high).all():
            return nodes, nodes[label]
        np.minimum.at(label, high, low)
        while (label[label] != label).any():
            label = label[label]


def _in_a_task(edges: DataFrame) -> DataFrame:
    """(node, parent) of few links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(batch.column(0).to_numpy(), batch.column(1).to_numpy()) for batch in batches]
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in least_labels(*map(np.concatenate, zip(*held)))], names=["node", "parent"])

    return mapped(edges.select("a", "b").coalesce(1), run, "node long, parent long")


def _roots(parents: DataFrame) -> DataFrame:
    """Follows parent pointers (each to a smaller node) to their ends, doubling every step."""
    while True:
        up = parents.select(F.col("node").alias("parent"), F.col("parent").alias("above"))
        deeper = written(parents.join(up, "parent", "left").select("node", F.coalesce("above", "parent").alias("parent"), F.coalesce(F.col("above") != F.col("parent"), F.lit(False)).alias("moved")), "pointers")
        dropped(parents)
        parents = deeper
        if not parents.where("moved").take(1):
            return parents


def components(links: DataFrame) -> DataFrame:
    """(node, comp) of every node of ``links`` (a, b); comp is the smallest node of its component.

    Every node points to its smallest neighbour, pointers are followed to their roots, links
    are redrawn between roots and repeated ones merged, until a task can join the rest.
    Aggregates meet hot nodes before the shuffle; nothing is collected.
    """
    edges = written(links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    labels = None
    while left := edges.count():
        if left <= TASK_LINKS:
            parents = written(_in_a_task(edges), "pointers")
        else:
            both = edges.select(F.col("a").alias("node"), F.col("b").alias("other")).unionByName(edges.select(F.col("b").alias("node"), F.col("a").alias("other")))
            parents = _roots(written(both.groupBy("node").agg(F.min("other").alias("low")).select("node", F.least("node", "low").alias("parent"), F.lit(True).alias("moved")), "pointers"))
        if labels is None:
            grown = written(parents.select("node", F.col("parent").alias("comp")), "labels")
        else:
            grown = written(labels.join(parents.select(F.col("node").alias("comp"), "parent"), "comp", "left").select("node", F.coalesce("parent", "comp").alias("comp")), "labels")
            dropped(labels)
        labels = grown
        if left <= TASK_LINKS:
            dropped(parents)
            break
        a, b = (parents.select(F.col("node").alias(c), F.col("parent").alias(f"{c}_root")) for c in "ab")
        fewer = written(edges.join(a, "a").join(b, "b").where("a_root <> b_root").select(F.least("a_root", "b_root").alias("a"), F.greatest("a_root", "b_root").alias("b")).distinct(), "edges")
        dropped(edges, parents)
        edges = fewer
    dropped(edges)
    if labels is None:
        return written(links.select(F.col("a").alias("node"), F.col("a").alias("comp")).limit(0), "labels")
    return labels
