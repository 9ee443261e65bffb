"""Connected components by alternating large-star and small-star steps, as joins and aggregations.

Kiveris et al., "Connected Components in MapReduce and Beyond". Nothing is gathered per node: the least neighbour of a
node is an aggregate that is combined before the shuffle, and joined back. Every step is written to the shared folder.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from risklane.llm.common import shuffled, stage


def _print_of(edges: DataFrame) -> tuple[int, int]:
    found = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return found["n"], int(found["h"] or 0)


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(shuffled(least), "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """``edges`` point from the greater node to the lesser one."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    joined = edges.join(shuffled(least), "u")
    return joined.filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v")) \
        .unionByName(least.select("u", F.col("m").alias("v")))


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node of ``links`` (columns a, b), root being the least node reachable.

    Links may repeat and may go either way; links of a node to itself and with null ends are ignored. Without links
    the result is empty.
    """
    edges = stage(links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
                  .distinct(), "edges")
    seen = _print_of(edges)
    while seen[0]:
        edges = stage(_small_star(_large_star(edges).filter("u <> v").distinct()).filter("u <> v").distinct(), "edges")
        now = _print_of(edges)
        if now == seen:
            break
        seen = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")) \
        .unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()


def trees(a: np.ndarray, b: np.ndarray) -> pd.DataFrame:
    """Spanning trees of the links a[i]-b[i] inside one task: each linked id (``id``) but the least of its tree, with that
    least id (``root``). A block of many links so gives out no more rows than it has members."""
    ids, places = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = places[:len(a)], places[len(a):]
    root = np.arange(len(ids))
    while len(a):
        least = root.copy()
        np.minimum.at(least, a, root[b])
        np.minimum.at(least, b, root[a])
        np.minimum.at(least, root, least.copy())
        least = least[least]
        if (least == root).all():
            break
        root = least
    below = root != np.arange(len(ids))
    return pd.DataFrame({"id": ids[below], "root": ids[root[below]]})
