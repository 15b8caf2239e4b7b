"""Connected components of an edge list, by contraction in DataFrame operations."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SharedTable


def local_stars(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges from each node to the least node of its component, for edges that fit in memory."""
    nodes, back = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = back[: len(u)], back[len(u) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        while True:  # pointers to pointers
            jump = new[new]
            if np.array_equal(jump, new):
                break
            new = jump
        if np.array_equal(new, label):
            break
        label = new
    far = label != np.arange(len(nodes))
    return nodes[far], nodes[label[far]]


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node that has an edge; ``edges`` has two long columns u and v.

    Each round hooks a node to its neighbour of least random priority, if that is less than its
    own, follows pointers twice, and contracts. Rounds grow with the logarithm of the nodes; a
    hub's edges meet in partial aggregates and in joins that can be split, in no single task.
    """
    left = SharedTable(edges.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "edges")
    nodes = SharedTable(left.df.select(F.explode(F.array("u", "v")).alias("node")).distinct(), "nodes").df
    hooks: list[DataFrame] = []
    while not left.df.isEmpty():
        e, salt = left.df, F.lit(len(hooks))

        def rank(node: str, salt: Column = salt) -> Column:
            return F.struct(F.xxhash64(F.col(node), salt).alias("p"), F.col(node).alias("n"))

        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        best = both.groupBy("u").agg(F.min(rank("v")).alias("best"))
        hook = SharedTable(best.where(F.col("best") < rank("u")).select("u", F.col("best.n").alias("p")), "hooks").df
        up = hook.select(F.col("u").alias("p"), F.col("p").alias("pp"))
        hook = SharedTable(hook.join(up, "p", "left").select("u", F.coalesce("pp", "p").alias("p")), "hooks").df
        hooks.append(hook)
        moved = e.join(hook, "u", "left").select(F.coalesce("p", "u").alias("a"), "v")
        moved = moved.join(hook.select(F.col("u").alias("v"), "p"), "v", "left").select("a", F.coalesce("p", "v").alias("b"))
        moved = moved.where("a <> b").select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct()
        before, left = left, SharedTable(moved, "edges")
        before.drop()
    out = nodes.withColumn("root", F.col("node"))
    for hook in hooks:
        out = out.join(hook.select(F.col("u").alias("root"), "p"), "root", "left").select("node", F.coalesce("p", "root").alias("root"))
    return out
