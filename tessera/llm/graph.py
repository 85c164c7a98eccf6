"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import cut

#: Edges that the driver joins up by itself (16 bytes each); more go through rounds of the executors.
EDGES_COLLECTED = 1_000_000


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Edges have u > v."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionAll(least.select("u", F.col("m").alias("v"))).distinct()


def joined(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of the edges, and the least node of each node's component."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    root = np.arange(len(nodes))
    while len(a):
        least = np.minimum(root[a], root[b])
        np.minimum.at(root, np.concatenate([root[a], root[b]]), np.concatenate([least, least]))
        while (root != (up := root[root])).any():
            root = up
        apart = root[a] != root[b]
        a, b = a[apart], b[apart]
    return nodes, nodes[root]


def components(edges: DataFrame, most_collected: int | None = None) -> DataFrame:
    """(node, root): the least node of each node's component, for nodes that have an edge to another.

    ``edges`` has two long columns u and v, in any direction, repeated or not;
    edges of a node to itself and nulls are left out. Up to ``most_collected``
    different edges (EDGES_COLLECTED) come to the driver, which joins them up:
    rounds over a small table would be thousands of tasks of a few rows each.
    More go through rounds, of which each is cut into the checkpoint folder and
    only counts come to the driver; their number grows with the logarithm of the
    longest chain. The result is the same.
    """
    edges = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u != v").distinct()
    edges, mark = cut(edges), None
    if edges.count() <= (EDGES_COLLECTED if most_collected is None else most_collected):
        ends = edges.toArrow()
        nodes, roots = joined(*(ends.column(c).to_numpy() for c in ("u", "v")))
        return edges.sparkSession.createDataFrame(pa.table({"node": nodes, "root": roots}))
    while True:
        seen = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen == mark or not seen[0]:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        mark = seen
        edges = cut(_small_star(_large_star(edges)))
