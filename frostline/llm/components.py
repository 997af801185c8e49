"""Connected components of an edge table by alternating stars, each round kept as a table
until the next one is."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from frostline.sources.shared import drop_written, written


EDGES = 1 << 22  # that a task puts together before the rounds


def _stars(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Edges from each node to the smallest of those that a task's edges connect it with: fewer than there are nodes."""
    a, b, waiting, held = np.zeros(0, np.int64), np.zeros(0, np.int64), [], 0

    def contracted(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        nodes, places = np.unique(np.concatenate([a, b]), return_inverse=True)
        left, right, root = places[: len(a)], places[len(a) :], np.arange(len(nodes))
        while True:
            x, y = root[left], root[right]
            apart = x != y
            if not apart.any():
                break
            np.minimum.at(root, np.maximum(x, y)[apart], np.minimum(x, y)[apart])
            while (root[root] != root).any():
                root = root[root]
        other = root != np.arange(len(nodes))
        return nodes[other], nodes[root[other]]

    for batch in batches:
        waiting.append((batch["a"].to_numpy(), batch["b"].to_numpy()))
        held += len(batch)
        if held >= EDGES:
            a, b = contracted(*(np.concatenate([first, *rest]) for first, rest in zip((a, b), zip(*waiting, strict=True), strict=True)))
            waiting, held = [], 0
    if waiting:
        a, b = contracted(*(np.concatenate([first, *rest]) for first, rest in zip((a, b), zip(*waiting, strict=True), strict=True)))
    yield pd.DataFrame({"a": a, "b": b})


def components(edges: DataFrame) -> DataFrame:
    """node, root: the smallest node that each node of edges (a, b: long) reaches. Nodes without edges have no row.

    Large stars hang every larger neighbour of a node onto the smallest one, small stars every smaller neighbour and
    the node itself; edges never multiply, and the rounds grow with the logarithm of the longest path. Minima are
    taken before the shuffle, and joins leave a node with most of the edges to adaptive execution. Before the rounds,
    each task replaces its edges (of some millions) by stars, without a shuffle.
    """
    given = written(edges.where(F.col("a") != F.col("b")).select("a", "b"), "given")
    stars = given.coalesce(max(1, -(-given.count() // EDGES))).mapInPandas(_stars, "a long, b long")
    flat = stars.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    current, before = written(flat, "edges"), None
    drop_written(given)
    while True:
        both = current.unionByName(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("least")).select(
            F.col("a").alias("of"), F.least("a", "least").alias("least")
        )
        large = both.where(F.col("b") > F.col("a")).join(least, F.col("a") == F.col("of")).select(
            F.col("b").alias("a"), F.col("least").alias("b")
        ).distinct()
        large = written(large, "stars")
        least = large.groupBy("a").agg(F.min("b").alias("least")).select(F.col("a").alias("of"), "least")
        small = large.join(least, F.col("a") == F.col("of"))
        small = small.select("b", "least").where(F.col("b") != F.col("least")).select(
            F.col("b").alias("a"), F.col("least").alias("b")
        ).unionByName(least.select(F.col("of").alias("a"), F.col("least").alias("b"))).distinct()
        earlier, current = current, written(small, "edges")
        drop_written(earlier)
        drop_written(large)
        state = current.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.bit_xor(F.xxhash64("b", "a"))).first()
        if state == before or state[0] == 0:
            break
        before = state
    roots = current.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionByName(current.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
