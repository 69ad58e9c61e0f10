"""Connected components of an edge table by alternating large-star and small-star steps.

Every step is a grouped minimum (combined before its shuffle) and a join with it, whose
skewed side adaptive execution may split; each round ends in a checkpoint in the shared
folder. Once FEW edges or fewer are left, one task ends the work with a union-find of that
bounded size. Nothing of the graph is collected; only counts and a checksum reach the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, lean

#: Edges a partition of a round holds on average.
ROWS = 200_000
#: Edges that one task joins at once, 16 bytes each.
FEW = 2_000_000


def _checksum(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def _packed(edges: DataFrame, count: int) -> DataFrame:
    """Few edges in few partitions: a step writes a file for each partition that it reads."""
    return edges.coalesce(max(1, -(-count // ROWS)))


def joined(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of some edges and the smallest node that each reaches."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = ends[: len(a)], ends[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        after = label.copy()
        np.minimum.at(after, label[x], low)
        np.minimum.at(after, label[y], low)
        while (after != after[after]).any():
            after = after[after]
        if (after == label).all():
            return nodes, nodes[label]
        label = after


def _at_once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
    if held:
        nodes, roots = joined(*(np.concatenate(x) for x in zip(*held)))
        for lo in range(0, len(nodes), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(x[lo : lo + 100_000]) for x in (nodes, roots)], names=["node", "root"])


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) of every node of an edge, root being the smallest node it reaches.

    Nodes are whole numbers. Edges with a null end are ignored; loops and repeated edges do
    no harm; without edges the result is empty.
    """
    x, y = F.col(a).cast("long"), F.col(b).cast("long")
    now = checkpointed(edges.where(x != y).select(F.greatest(x, y).alias("a"), F.least(x, y).alias("b")).distinct())
    state = (now.count(), None)
    now = _packed(now, state[0])
    while state[0] > FEW:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        inner = large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = checkpointed(inner.unionByName(low.select("a", F.col("m").alias("b"))).distinct())
        before, state = state, _checksum(now)
        now = _packed(now, state[0])
        if before == state:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
    return checkpointed(now.coalesce(1).mapInArrow(lean(_at_once), "node long, root long"))
