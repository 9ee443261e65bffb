"""Isolation forest: trees grown from one bounded sample, rows scored where they are."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window as W, functions as F

from risklane.operators.quantiles import quantiles
from risklane.operators.shaping import hash_rank, hash_sample
from risklane.staging import stage

TREES, TREE_ROWS, CONTAMINATION = 200, 256, 0.035       # fixed values
NODE = "tree int, node int, feature int, threshold double, left int, right int, path double"


def mean_path(n: np.ndarray | float) -> np.ndarray:
    """Average path length of an unsuccessful search in a binary search tree of n rows."""
    n = np.asarray(n, dtype=float)
    safe = np.maximum(n, 3.0)
    long = 2 * (np.log(safe - 1) + np.euler_gamma) - 2 * (safe - 1) / safe
    return np.where(n <= 1, 0.0, np.where(n == 2, 1.0, long))


def grow(x: np.ndarray, rng: np.random.Generator) -> list[tuple[int, int, float, int, int, float]]:
    """(node, feature, threshold, left, right, path) of one tree; leaves have feature -1."""
    deepest = int(np.ceil(np.log2(max(len(x), 2))))
    nodes = []
    open_nodes = [(0, np.arange(len(x)), 0)]
    used = 1
    while open_nodes:
        node, rows, depth = open_nodes.pop()
        low, high = x[rows].min(axis=0), x[rows].max(axis=0)
        varied = np.flatnonzero(high > low)
        if depth == deepest or len(rows) <= 1 or not len(varied):
            nodes.append((node, -1, 0.0, -1, -1, float(depth + mean_path(len(rows)))))
            continue
        feature = int(rng.choice(varied))
        cut = float(rng.uniform(low[feature], high[feature]))
        goes_left = x[rows, feature] <= cut
        nodes.append((node, feature, cut, used, used + 1, 0.0))
        open_nodes += [(used, rows[goes_left], depth + 1), (used + 1, rows[~goes_left], depth + 1)]
        used += 2
    return nodes


@dataclass
class Forest:
    """Node tables (trees x nodes), rows per tree, and the scaling fixed on the training scores."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    path: np.ndarray
    rows: int
    low: float = 0.0
    high: float = 1.0
    flag_above: float = 1.0


def fit(train: DataFrame, trees: int = TREES, tree_rows: int = TREE_ROWS, contamination: float = CONTAMINATION,
        seed: int = 42, ident: str = "TransactionID") -> Forest:
    """Grow the trees in parallel, each from its slice of one random sample of trees * tree_rows rows.

    With fewer rows than that, slices wrap around; a tree never gets a row twice.
    """
    spark = train.sparkSession
    arrays = train.select(ident, vector_to_array("features").alias("x"))
    pool = hash_sample(arrays, trees * tree_rows, ident, seed)
    # The pool has a fixed maximal size, so one task may number it.
    pool = pool.withColumn("_at", F.row_number().over(W.orderBy(hash_rank(ident, seed), ident)) - 1)
    size = pool.count()
    per_tree = min(tree_rows, size)
    slots = spark.range(trees * per_tree).select(
        F.floor(F.col("id") / per_tree).cast("int").alias("tree"), (F.col("id") % size).cast("int").alias("_at"))
    samples = slots.join(pool, "_at").select("tree", ident, "x")

    def build(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        tree = int(key[0])
        x = np.stack(rows.sort_values(ident)["x"].to_numpy())
        nodes = grow(x, np.random.default_rng([seed, tree]))
        table = pd.DataFrame(nodes, columns=["node", "feature", "threshold", "left", "right", "path"])
        table.insert(0, "tree", tree)
        return table

    nodes = samples.groupBy("tree").applyInPandas(build, NODE).toPandas()     # at most trees * 2 * tree_rows rows
    width = int(nodes["node"].max()) + 1
    tables = {}
    for column, kind in (("feature", np.int32), ("threshold", float), ("left", np.int32), ("right", np.int32), ("path", float)):
        table = np.full((trees, width), -1, dtype=kind)
        table[nodes["tree"], nodes["node"]] = nodes[column]
        tables[column] = table
    forest = Forest(**tables, rows=per_tree)
    scores = stage(raw_scores(forest, train, ident), "iso_raw")       # the quantiles take several passes
    ends = quantiles(scores, [], "iso_raw", [0.0, 1 - contamination, 1.0], "q").first()["q"]
    forest.low, forest.flag_above, forest.high = ends
    return forest


# Rows that go through a tree together: they and the tree stay in the processor's cache.
TOGETHER = 8192


def path_scores(tables: tuple[np.ndarray, ...], rows: int, x: np.ndarray) -> np.ndarray:
    """2 ** -(mean path / expected path): near 1 for rows that are isolated early.

    The right child follows the left one. A leaf leads to itself, so that all rows take the same number of steps.
    """
    feature, threshold, left, _, path = tables
    leaf = feature < 0
    cuts = np.where(leaf, np.inf, threshold)
    following = np.where(leaf, np.arange(feature.shape[1]), left).astype(np.intp)
    total, steps = np.zeros(len(x)), depths(feature, left)
    for first in range(0, len(x), TOGETHER):
        part = np.ascontiguousarray(x[first:first + TOGETHER].T)
        line, width, values = np.arange(part.shape[1]), part.shape[1], part.ravel()
        offsets = np.maximum(feature, 0).astype(np.intp) * width
        for tree in range(len(feature)):
            offset, cut, after = offsets[tree], cuts[tree], following[tree]
            at = np.zeros(width, np.intp)
            for _ in range(int(steps[tree])):
                at = after[at] + (values[offset[at] + line] > cut[at])
            total[first:first + TOGETHER] += path[tree][at]
    return 2.0 ** (-total / len(feature) / float(mean_path(rows)))


def depths(feature: np.ndarray, left: np.ndarray) -> np.ndarray:
    """Most steps from the root to a leaf, by tree."""
    deep = np.zeros(feature.shape, int)
    for node in range(feature.shape[1]):                    # parents stand before their children
        inner = np.flatnonzero(feature[:, node] >= 0)
        for side in (0, 1):
            deep[inner, left[inner, node] + side] = deep[inner, node] + 1
    return deep.max(axis=1)


def with_raw_scores(forest: Forest, df: DataFrame, name: str = "iso_raw") -> DataFrame:
    """``df`` with the unscaled score of each row's ``features``."""
    shipped = df.sparkSession.sparkContext.broadcast(
        (forest.feature, forest.threshold, forest.left, forest.right, forest.path))
    tree_rows = forest.rows

    @F.pandas_udf("double")
    def raw(x: pd.Series) -> pd.Series:
        return pd.Series(path_scores(shipped.value, tree_rows, np.stack(x.to_numpy())) if len(x) else [], dtype="float64")

    return df.withColumn(name, raw(vector_to_array("features")))


def raw_scores(forest: Forest, df: DataFrame, ident: str = "TransactionID") -> DataFrame:
    return with_raw_scores(forest, df.select(ident, "features")).drop("features")


def with_scores(forest: Forest, df: DataFrame, by_batch: bool = False) -> DataFrame:
    """``df`` with iso_score and iso_flag. The score is scaled by the training range and clipped to [0, 1];
    ``by_batch`` scales by the range of the rows given instead."""
    raw = with_raw_scores(forest, df)
    low, high = forest.low, forest.high
    if by_batch:
        ends = raw.agg(F.min("iso_raw").alias("low"), F.max("iso_raw").alias("high")).first()
        low, high = ends["low"], ends["high"]
    scaled = (F.col("iso_raw") - low) / (high - low + 1e-9)
    clipped = F.least(F.greatest(scaled, F.lit(0.0)), F.lit(1.0)).cast("float").cast("double")
    return raw.withColumn("iso_score", clipped).withColumn(
        "iso_flag", (F.col("iso_raw") > forest.flag_above).cast("int")).drop("iso_raw")


def scores(forest: Forest, df: DataFrame, ident: str = "TransactionID", by_batch: bool = False) -> DataFrame:
    """(id, iso_score, iso_flag)."""
    return with_scores(forest, df.select(ident, "features"), by_batch).drop("features")
