"""Connected components of an edge table by alternating large-star and small-star rounds."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillflow.checkpoint import cut


def stars(x: np.ndarray, y: np.ndarray, n: int) -> np.ndarray:
    """Smallest node that edges x - y between nodes 0 to n - 1 connect each node with."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        # hook the roots of both ends, then shorten paths
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each batch's edges as stars: fewer edges that connect the same nodes."""
    for batch in batches:
        a, b = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        if not len(a):
            continue
        nodes, at = np.unique(np.r_[a, b], return_inverse=True)
        label = stars(at[: len(a)], at[len(a) :], len(nodes))
        moved = label != np.arange(len(nodes))
        yield pa.RecordBatch.from_arrays([pa.array(nodes[moved]), pa.array(nodes[label[moved]])], ["a", "b"])


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of (a, b), root the smallest node of its component.

    Edges are first thinned to stars where they lie. Then each round links, for each node,
    its larger neighbours to its smallest neighbour, and its smaller ones too; it ends when
    all edges are stars, in about log2(diameter) rounds. Every round is checkpointed.
    """
    pairs = cut(edges.mapInArrow(_forest, "a long, b long").distinct())
    while True:
        # stars already: one root for each node, and no root below another
        twice = pairs.groupBy("a").count().where("count > 1").select("a")
        chained = pairs.join(pairs.select(F.col("b").alias("a")).distinct(), "a", "left_semi").select("a")
        if twice.union(chained).isEmpty():
            break
        both = pairs.union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = cut(large.mapInArrow(_forest, "a long, b long").distinct())
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        pairs = cut(small.union(least.select("a", F.col("m").alias("b"))).distinct())
    roots = pairs.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.union(pairs.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
