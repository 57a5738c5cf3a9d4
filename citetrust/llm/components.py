"""Connected components of a graph given as a table of edges."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from citetrust.llm.work import stored


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(smallest node that it reaches, node) of each node that reaches a smaller one over the edges (a, b).

    For what a task holds already: edges that leave it as stars take fewer rounds to join with those of other tasks.
    """
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root, before = np.arange(len(nodes)), None
    while before is None or (root != before).any():
        before, low = root.copy(), np.minimum(root[x], root[y])
        np.minimum.at(root, before[x], low)
        np.minimum.at(root, before[y], low)
        while (root[root] != root).any():
            root = root[root]
    hung = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[root[hung]], nodes[hung]


def _large(edges: DataFrame) -> tuple[DataFrame, bool]:
    """Larger neighbours of each node hung on the smallest neighbour, and whether ``edges`` were stars already.

    They are stars, each around its smallest node, if no node with several neighbours has a smaller one.
    """
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("least"), F.count("*").alias("degree"))
    seen = Observation()
    least = stored(least.observe(seen, F.count_if(F.expr("degree > 1 and least < a")).alias("loose")).drop("degree"), "least")
    if seen.get["loose"] == 0:
        return edges, True
    moved = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("least").alias("b"))
    return stored(moved, "large"), False


def _small(edges: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours hung on the smallest of these; b < a in ``edges``, and after it, too."""
    least = stored(edges.groupBy("a").agg(F.min("b").alias("least")), "least")
    moved = edges.join(least, "a").select(F.col("b").alias("a"), F.col("least").alias("b")).where("a != b")
    return stored(moved.unionByName(least.select("a", F.col("least").alias("b"))).distinct(), "small")


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of each node that has an edge to another; the component is its smallest node.

    ``edges`` (a, b), in any direction and any number; nulls and loops are dropped. Large-star and small-star steps
    are repeated until all edges are stars; each step is stored, and only a count goes to the driver. Smallest
    neighbours are aggregated before they are shuffled and stored before they are joined, so Spark knows their size:
    it broadcasts them if they are small, and otherwise can split the rows of a node with very many neighbours.
    """
    edges = edges.where("a is not null and b is not null and a != b")
    edges = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges, done = stored(edges, "edges"), False
    while not done:
        moved, done = _large(edges)
        if not done:
            edges = _small(moved)
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )
