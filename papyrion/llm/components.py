"""Connected components of an undirected graph, by repeated contraction.

Each round every vertex hooks onto its smallest neighbour, edges are rewritten to the hooked
names and loops and repeats go away. Vertex names should be well mixed (``mix64``), so that
each round takes away a constant share of the vertices. No round needs the neighbours of a
vertex in one place: minima are partial aggregates and renaming is a join, which adaptive
execution splits where a vertex has very many edges.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papyrion.llm.shared import settle


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words (the finaliser of SplitMix64)."""
    x = x.astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def components(edges: DataFrame) -> DataFrame:
    """``edges`` (a long, b long) -> (v long, root long), one row for each vertex that has an edge.

    Vertices of one component share a root. Loops and repeated edges are fine; an empty table
    gives an empty one.
    """
    edges = settle(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    names: list[DataFrame] = []
    while not edges.isEmpty():
        both = edges.select(F.col("a").alias("v"), F.col("b").alias("w")).union(edges.select("b", "a"))
        hook = settle(both.groupBy("v").agg(F.min("w").alias("w")).select("v", F.least("v", "w").alias("to")))
        names.append(hook)
        left = hook.select(F.col("v").alias("a"), F.col("to").alias("a2"))
        right = hook.select(F.col("v").alias("b"), F.col("to").alias("b2"))
        moved = edges.join(left, "a").join(right, "b").where("a2 <> b2")
        edges = settle(moved.select(F.least("a2", "b2").alias("a"), F.greatest("a2", "b2").alias("b")).distinct())
    if not names:
        return edges.select(F.col("a").alias("v"), F.col("b").alias("root"))
    roots = names.pop().select(F.col("v"), F.col("to").alias("root"))
    while names:  # names of the round before, followed by what became of them
        later = roots.withColumnsRenamed({"v": "to"})
        roots = names.pop().join(later, "to", "left").select("v", F.coalesce("root", "to").alias("root"))
    return settle(roots)
