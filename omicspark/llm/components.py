"""Connected components of a link table, by alternating star steps."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from omicspark.session import cut_lineage


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node reachable from each node that has a link.

    ``links`` holds pairs of longs in any order, repeats and self-links allowed; pairs with a null are no
    links. Only the pairs a round ends with are kept, and each round is written to the shared folder, so a
    lost executor costs one step. A node with many links is a join key on both sides of a plain equi join,
    which adaptive execution splits; nothing gathers the links of one node.
    """
    ends = F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")
    pairs = links.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    pairs = cut_lineage(pairs.select(*ends).distinct())
    seen = _digest(pairs)
    while seen[0]:
        pairs = _small_star(_large_star(pairs))
        now = _digest(pairs)
        if now == seen:
            break
        seen = now
    stars = pairs.select(F.col("hi").alias("node"), F.col("lo").alias("component"))
    return stars.unionByName(pairs.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct())


def _digest(pairs: DataFrame) -> tuple[int, int]:
    """Number of pairs and an order-free hash of them."""
    mixed = F.xxhash64("hi", "lo").bitwiseAND(F.lit((1 << 40) - 1))
    row = pairs.agg(F.count(F.lit(1)).alias("n"), F.sum(mixed).alias("h")).first()
    return row["n"], row["h"] or 0


def _large_star(pairs: DataFrame) -> DataFrame:
    """Each larger neighbour of a node moves to the smallest node around it."""
    around = pairs.select(F.col("hi").alias("node"), F.col("lo").alias("other")).unionByName(
        pairs.select(F.col("lo").alias("node"), F.col("hi").alias("other"))
    )
    smallest = cut_lineage(around.groupBy("node").agg(F.least(F.col("node"), F.min("other")).alias("least")))
    moved = pairs.join(smallest, pairs["lo"] == smallest["node"])
    return cut_lineage(moved.select("hi", F.col("least").alias("lo")).distinct())


def _small_star(pairs: DataFrame) -> DataFrame:
    """The smaller neighbours of a node, and the node, move to the smallest of them."""
    smallest = cut_lineage(pairs.groupBy(F.col("hi").alias("node")).agg(F.min("lo").alias("least")))
    moved = pairs.join(smallest, pairs["hi"] == smallest["node"])
    moved = moved.where(F.col("lo") != F.col("least")).select(F.col("lo").alias("hi"), F.col("least").alias("lo"))
    own = smallest.select(F.col("node").alias("hi"), F.col("least").alias("lo"))
    return cut_lineage(moved.unionByName(own).distinct())


def merge(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels (each the smallest row of its group) after joining the rows ``a`` with the rows ``b``."""
    rows = np.arange(len(labels))
    a, b = np.concatenate([a, rows]), np.concatenate([b, labels])
    while True:
        least = np.minimum(labels[a], labels[b])
        after = labels.copy()
        np.minimum.at(after, a, least)
        np.minimum.at(after, b, least)
        after = after[after]
        if np.array_equal(after, labels):
            return labels
        labels = after
