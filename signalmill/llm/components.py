"""Connected components: inside one block of a link matrix, and of a graph given as a table of edges."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from signalmill.session import materialise


def forest(linked: np.ndarray, left: np.ndarray, right: np.ndarray) -> dict[int, int]:
    """Smallest node connected to each linked node within a tile, by breadth-first search over whole rows.

    A node may stand in several rows and columns; what they reach is one component.
    """
    root: dict[int, int] = {}
    above: dict[int, int] = {}  # roots of components that a later one joined

    def top(low: int) -> int:
        while low in above:
            low = above[low]
        return low

    open_rows = linked.any(1)
    while open_rows.any():
        rows = np.zeros(len(left), bool)
        columns = np.zeros(len(right), bool)
        front = np.zeros(len(left), bool)
        front[np.flatnonzero(open_rows)[0]] = True
        while front.any():
            rows |= front
            reached = linked[front].any(0) & ~columns
            columns |= reached
            front = linked[:, reached].any(1) & ~rows if reached.any() else np.zeros(len(left), bool)
        members = np.concatenate([left[rows], right[columns]]).tolist()
        roots = {top(root[m]) for m in members if m in root}
        low = min(*members, *roots)
        above.update((r, low) for r in roots if r != low)
        root.update(dict.fromkeys(members, low))
        open_rows &= ~rows
    return {m: top(low) for m, low in root.items()}


def components(edges: DataFrame, label: str = "components") -> DataFrame:
    """``node, component`` for every node of ``edges`` (``a, b``) that is not the smallest of its component.

    Contraction in rounds: each node hooks onto its smallest neighbour where that
    is smaller, the resulting trees are flattened by pointer jumping, and the
    edges are rewritten to the roots. Edges within a tree go; the rest shrinks
    from round to round. Minima are combined before the shuffle, and joins on a
    node with very many edges are split by AQE. Every state is a written table.
    """
    def canonical(df: DataFrame) -> DataFrame:
        return (df.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())

    left, facts = materialise(canonical(edges.select("a", "b")), label, n=F.count(F.lit(1)))
    result = None
    while facts["n"] or result is None:
        tree, _ = materialise(left.groupBy("a").agg(F.min("b").alias("up")).withColumnRenamed("a", "node"), label)
        moved = 1
        while moved:
            above = tree.select(F.col("node").alias("up"), F.col("up").alias("_top"))
            jumped = tree.join(above, "up", "left").select(
                "node", F.coalesce("_top", "up").alias("up"), F.col("_top").isNotNull().alias("_moved"))
            tree, seen = materialise(jumped, label, n=F.count_if("_moved"))
            moved = seen["n"]
            tree = tree.drop("_moved")
        if result is None:
            result = tree.select("node", F.col("up").alias("component"))
        else:
            up = tree.select(F.col("node").alias("component"), "up")
            grown = result.join(up, "component", "left").select("node", F.coalesce("up", "component").alias("component"))
            # Roots that hooked in this round are nodes of their own.
            result = grown.unionByName(tree.join(result.select("node"), "node", "left_anti").select("node", F.col("up").alias("component")))
        if not facts["n"]:
            break
        low = tree.select(F.col("node").alias("b"), F.col("up").alias("_b"))
        rewritten = (left.join(tree, left["a"] == tree["node"]).select(F.col("up").alias("a"), "b").join(low, "b", "left")
                     .select("a", F.coalesce("_b", "b").alias("b")))
        left, facts = materialise(canonical(rewritten), label, n=F.count(F.lit(1)))
    return result
