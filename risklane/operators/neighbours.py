"""Exact nearest neighbours within one table, in blocks of bounded size.

Rows are placed in the cell of their nearest pivot and cells are cut into blocks. A row first meets
its own block, which bounds the distance of its k-th neighbour. By the triangle inequality it then
has to meet only the blocks of cells that reach inside that bound. Every task sees at most one block
of rows and one block of askers, and reports k rows per asker.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F

from risklane.operators.shaping import hash_sample
from risklane.staging import stage

BLOCK_ROWS = 4_000
MOST_PIVOTS = 1_000
FOUND = "id long, other long, distance double"


def distances(a: np.ndarray, b: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(first row, distances) for slabs of ``a`` against all of ``b``, by plain differences."""
    step = max(1, 2_000_000 // max(1, b.size))
    for start in range(0, len(a), step):
        gap = a[start:start + step, None, :] - b[None, :, :]
        yield start, np.sqrt((gap * gap).sum(axis=2))


def candidates(a: np.ndarray, b: np.ndarray, ids: np.ndarray, others: np.ndarray, bound: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row of ``a``, row of ``b``) of every pair that may be among the k nearest and not beyond the bound.

    Distances come from a matrix product here. They are off by rounding, so a pair is left out only if it is too far by more than
    the product can be wrong.
    """
    centre = b.mean(axis=0)
    a, b = a - centre, b - centre
    far, near = (b * b).sum(axis=1), (a * a).sum(axis=1)
    slack = 8 * (a.shape[1] + 8) * np.finfo(float).eps * (np.sqrt(near) + np.sqrt(far.max())) ** 2
    slack = np.where(np.isfinite(slack), slack, 0.0)
    step = max(1, 4_000_000 // len(b))
    for start in range(0, len(a), step):
        part = slice(start, start + step)
        squares = (a[part] @ b.T) * -2 + far + near[part, None]
        if not np.isfinite(squares).all():
            squares[:] = 0.0                                  # nothing is known, so every pair is measured
        squares[ids[part, None] == others[None, :]] = np.inf
        limit = bound[part] ** 2 * (1 + 1e-9)
        unknown = np.flatnonzero(~np.isfinite(limit))
        if len(unknown):
            limit[unknown] = np.partition(squares[unknown], min(k, len(b)) - 1, axis=1)[:, min(k, len(b)) - 1]
        row, other = np.nonzero(squares <= np.minimum(limit + 2 * slack[part], np.finfo(float).max)[:, None])
        yield row + start, other


def nearest(askers: pd.DataFrame, rows: pd.DataFrame, k: int) -> pd.DataFrame:
    """The k nearest of ``rows`` for each asker, itself left out; lower id first on equal distance. Askers with a ``bound`` have k
    others within it already, so what is farther need not be given."""
    rows = rows.sort_values("id")
    a, b = np.stack(askers["x"].to_numpy()), np.stack(rows["x"].to_numpy())
    ids, others = askers["id"].to_numpy(), rows["id"].to_numpy()
    bound = askers["bound"].to_numpy(float) if "bound" in askers else np.full(len(a), np.inf)
    parts = []
    for row, other in candidates(a, b, ids, others, bound, k):
        for first, last in slabs(row, 2_000_000 // a.shape[1]):
            mine, its = row[first:last], other[first:last]
            gap = a[mine] - b[its]
            gaps = np.sqrt((gap * gap).sum(axis=1))
            order = np.lexsort((its, gaps, mine))
            mine = mine[order]
            order = order[np.arange(len(mine)) - np.searchsorted(mine, mine) < k]
            parts.append(pd.DataFrame({"id": ids[row[first:last][order]], "other": others[its[order]], "distance": gaps[order]}))
    found = pd.concat(parts) if parts else pd.DataFrame({"id": ids[:0], "other": others[:0], "distance": np.zeros(0)})
    return found[np.isfinite(found["distance"])]


def slabs(row: np.ndarray, size: int) -> Iterator[tuple[int, int]]:
    """Ranges of about ``size`` sorted numbers that part no equal ones."""
    first = 0
    while first < len(row):
        last = min(len(row), first + max(1, size))
        if last < len(row):
            last = int(np.searchsorted(row, row[last - 1], side="right"))
        yield first, last
        first = last


def neighbours(points: DataFrame, k: int, block_rows: int = BLOCK_ROWS, seed: int = 42) -> DataFrame:
    """(id, other, distance, rank): the k nearest other points of each of ``points`` (id, x)."""
    spark = points.sparkSession
    points = points.select("id", "x")
    n_cells = max(1, min(MOST_PIVOTS, -(-points.count() // block_rows)))
    pivots = np.array([row["x"] for row in hash_sample(points, n_cells, "id", seed).collect()])

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                gaps = np.vstack([g for _, g in distances(np.stack(batch["x"].to_numpy()), pivots)])
                yield batch.assign(cell=gaps.argmin(axis=1).astype("int32"), reach=gaps.min(axis=1))

    placed = stage(points.mapInPandas(place, "id long, x array<double>, cell int, reach double"), "placed")
    cells = placed.groupBy("cell").agg(
        F.ceil(F.count(F.lit(1)) / block_rows).cast("int").alias("blocks"),
        F.min("reach").alias("near"), F.max("reach").alias("far"))
    known = cells.collect()                                   # one row per pivot
    size = {row["cell"]: row["blocks"] for row in known}
    near, far = (np.array([next((r[c] for r in known if r["cell"] == i), np.nan) for i in range(len(pivots))])
                 for c in ("near", "far"))
    blocked = placed.join(F.broadcast(cells.select("cell", "blocks")), "cell").withColumn(
        "block", F.pmod(F.xxhash64(F.lit(seed), "id"), F.col("blocks")).cast("int")).drop("blocks", "reach")

    def within(rows: pd.DataFrame) -> pd.DataFrame:
        return nearest(rows, rows, k)

    own = stage(blocked.groupBy("cell", "block").applyInPandas(within, FOUND), "own_block")
    if sum(size.values()) == 1:
        return _ranked(own, k)

    # The k-th distance seen so far; none when the own block was too small.
    bound = own.groupBy("id").agg(F.when(F.count(F.lit(1)) >= k, F.max("distance")).alias("bound"))

    def visit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            gaps = np.vstack([g for _, g in distances(np.stack(batch["x"].to_numpy()), pivots)])
            reachable = batch["bound"].fillna(np.inf).to_numpy()[:, None] * (1 + 1e-9) + 1e-9
            with np.errstate(invalid="ignore"):
                meets = (gaps - far <= reachable) & (near - gaps <= reachable)
            row, cell = np.nonzero(meets)
            yield pd.DataFrame({"id": batch["id"].to_numpy()[row], "x": batch["x"].to_numpy()[row],
                                "bound": batch["bound"].to_numpy(float)[row], "home": batch["block"].to_numpy()[row], "home_cell": batch["cell"].to_numpy()[row],
                                "cell": cell.astype("int32")})

    asked = blocked.join(bound, "id", "left").mapInPandas(
        visit, "id long, x array<double>, bound double, home int, home_cell int, cell int")
    asked = stage(
        asked.join(F.broadcast(cells.select("cell", "blocks")), "cell")
             .withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
             .filter((F.col("cell") != F.col("home_cell")) | (F.col("block") != F.col("home")))
             .select("id", "x", "bound", "cell", "block"), "askers")
    # A block asked by many rows is met in several parts.
    parts = asked.groupBy("cell", "block").agg(F.ceil(F.count(F.lit(1)) / block_rows).cast("int").alias("parts"))
    key = ["cell", "block", "part"]
    askers = asked.join(parts, ["cell", "block"]).withColumn(
        "part", F.pmod(F.xxhash64(F.lit(seed + 1), "id"), F.col("parts")).cast("int")).drop("parts")
    hosts = blocked.join(parts, ["cell", "block"]).withColumn(
        "part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")

    def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"id": [], "other": [], "distance": []})
        return nearest(left, right, k)

    met = askers.groupBy(*key).cogroup(hosts.groupBy(*key)).applyInPandas(meet, FOUND)
    return _ranked(own.unionByName(met), k)


def _ranked(found: DataFrame, k: int) -> DataFrame:
    closest = W.partitionBy("id").orderBy("distance", "other")
    return found.withColumn("rank", F.row_number().over(closest)).filter(F.col("rank") <= k)
