"""Connected components of links between long ids, by alternating large-star and small-star steps; what fits one task ends there."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mapped, stored

#: Links that one task solves at the end (16 bytes each).
BASE = 300_000


def local_roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of links held in one task that are not the smallest of their component, and that smallest node."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    moved = label != np.arange(len(nodes))
    return nodes[moved], nodes[label[moved]]


def _solved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, root) of every node of some links."""
    held = list(batches)
    a, b = (np.concatenate([np.zeros(0, np.int64), *(x.column(c).to_numpy() for x in held)]) for c in (0, 1))
    node, root = local_roots(a, b)
    tops = np.unique(root)
    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([node, tops])), pa.array(np.concatenate([root, tops]))], names=["node", "root"])


def components(links: DataFrame) -> DataFrame:
    """links (a long, b long): (node, root), the smallest node reachable, for every node of a link. Self links count as none.

    Each step sums up the neighbours of a node by partial aggregation before it joins, so a node with very many
    links costs no more than its links. Steps are written to the shared folder. Each step leaves fewer or shorter links, and
    once they are BASE or fewer one task solves them.
    """
    pairs = stored(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    last = None
    while True:
        if pairs.count() <= BASE:
            return mapped(pairs.coalesce(1), _solved, "node long, root long")
        both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("low")).select(F.col("a").alias("u"), F.least("a", "low").alias("low"))
        # large star: neighbours above a node go to the smallest of node and neighbours
        large = both.where("b > a").join(low, F.col("a") == F.col("u")).select(F.col("b").alias("a"), F.col("low").alias("b")).where("a <> b").distinct()
        # small star: a node and its lower neighbours go to the lowest
        down = large.groupBy("a").agg(F.min("b").alias("low")).withColumnRenamed("a", "u")
        small = large.join(down, F.col("a") == F.col("u")).select(F.explode(F.array(F.struct("a", F.col("low").alias("b")), F.struct(F.col("b").alias("a"), F.col("low").alias("b")))).alias("e")).select("e.*").where("a <> b").distinct()
        pairs = stored(small)
        now = pairs.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == last:
            break
        last = now
    return pairs.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(pairs.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
