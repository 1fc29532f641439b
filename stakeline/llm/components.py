"""Connected components of a distributed graph by alternating large and small stars."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stakeline.llm.common import roots, store

EDGES = "a bigint, b bigint"


def _forest(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Each batch of links reduced to one link per node, to the smallest node it reaches there."""
    for part in parts:
        nodes, place = np.unique(part[["a", "b"]].to_numpy().ravel(), return_inverse=True)
        place = place.reshape(-1, 2)
        root = roots(len(nodes), place[:, 0], place[:, 1])
        linked = root != np.arange(len(nodes))
        yield pd.DataFrame({"a": nodes[linked], "b": nodes[root[linked]]})


def _stars(edges: DataFrame) -> DataFrame:
    """One round. Links point from ``a`` down to ``b`` (a > b).

    Large star: all larger neighbours of a node move to its smallest neighbour. Small star: the
    smaller neighbours of a node, and the node, move to the smallest of them. Minima are partially
    aggregated, and the joins are plain, so that adaptive execution can split a hub.
    """
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
    large = (
        both.join(least, "a")
        .where("b > a and b <> m")
        .select(F.col("b").alias("a"), F.col("m").alias("b"))
        .distinct()
    )
    large = store(large, "large-star")
    least = large.groupBy("a").agg(F.min("b").alias("m"))
    moved = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.withColumnRenamed("m", "b")).distinct()


def components(links: DataFrame) -> DataFrame:
    """``node, component`` for every node of ``links`` (two bigint columns) that reaches a smaller one.

    ``component`` is the smallest node reachable. Links in either direction, repeated links and
    links of a node to itself are allowed; links with a NULL end are left out. No links, no rows.
    Each round is stored in the shared folder; the number of rounds grows with the logarithm of the
    longest path.
    """
    edges = links.toDF("a", "b").where("a <> b").mapInPandas(_forest, EDGES).distinct()
    edges, seen = store(edges, "links"), None
    while True:
        size = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if tuple(size) == seen or size[0] == 0:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
        seen = tuple(size)
        edges = store(_stars(edges), "stars")
