"""Minority oversampling by interpolation between near neighbours."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

from risklane.operators.neighbours import BLOCK_ROWS, neighbours
from risklane.operators.ordered import TASK_ROWS, positions
from risklane.operators.shaping import hash_rank
from risklane.operators.skew import lookup
from risklane.staging import stage

NEIGHBOURS = 5


def synthetic(rows: DataFrame, k: int = NEIGHBOURS, seed: int = 42, label: str = "isFraud",
              ident: str = "TransactionID", block_rows: int = BLOCK_ROWS, limit: int = TASK_ROWS) -> DataFrame:
    """New rows of the rarer class, as many as it lacks: (label, base, other, share, features).

    A new row lies ``share`` of the way from an existing row to one of its k nearest of the same class.
    Base rows are used equally often, give or take one. All draws are functions of (seed, id, copy).
    """
    sizes = {row[label]: row["n"] for row in rows.groupBy(label).agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(sizes) != 2:
        raise ValueError("oversampling needs rows of both classes")
    rare = min(sizes, key=lambda value: (sizes[value], -value))
    have, lacking = sizes[rare], max(sizes.values()) - sizes[rare]
    if have < 2:
        raise ValueError("oversampling needs at least two rows of the rarer class")
    points = stage(rows.filter(F.col(label) == rare).select(
        F.col(ident).alias("id"), vector_to_array("features").alias("x")), "minority")
    near = stage(neighbours(points, min(k, have - 1), block_rows, seed), "near")
    chosen_from = near.groupBy("id").agg(F.transform(
        F.sort_array(F.collect_list(F.struct("rank", "other"))), lambda r: r["other"]).alias("others"))

    # Row i of the class gets the copies between these two whole numbers: they add up to what is lacking.
    at = F.col("_at")
    copies = F.floor((at + 1) * lacking / have) - F.floor(at * lacking / have)
    order = points.withColumn("_order", hash_rank("id", seed))
    bases = positions(order, ["_order", "id"], "_at", limit).select("id", "x", copies.cast("int").alias("_copies"))
    bases = bases.filter(F.col("_copies") > 0).join(chosen_from, "id")
    drawn = bases.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("_copies")))).select(
        "id", "x", "copy",
        F.get("others", (_draw(seed + 1) * F.size("others")).cast("int")).alias("other"),
        _draw(seed + 2).alias("share"))
    ends = points.select(F.col("id").alias("other"), F.col("x").alias("y"))
    mixed = F.zip_with("x", "y", lambda a, b: a + F.col("share") * (b - a))
    return lookup(drawn, ends, ["other"], limit).select(
        F.lit(rare).alias(label), F.col("id").alias("base"), "other", "share", array_to_vector(mixed).alias("features"))


def _draw(seed: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(seed), "id", "copy"), F.lit(1 << 52)) / float(1 << 52)


def balance(rows: DataFrame, k: int = NEIGHBOURS, seed: int = 42, label: str = "isFraud",
            ident: str = "TransactionID", block_rows: int = BLOCK_ROWS, limit: int = TASK_ROWS) -> DataFrame:
    """The rows with both classes equally large; new rows have no id."""
    new = synthetic(rows, k, seed, label, ident, block_rows, limit)
    return rows.select(ident, label, "features").unionByName(
        new.select(F.lit(None).cast("long").alias(ident), F.col(label), "features"))
