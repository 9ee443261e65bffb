"""Category codes: fitted once on the training rows, looked up for every other row."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from risklane.operators.ordered import BROADCAST_ROWS, TASK_ROWS, running_sums
from risklane.operators.skew import lookup
from risklane.staging import stage

MISSING = "__nan__"
UNSEEN = -1


def as_category(value: Column) -> Column:
    """Text of the value; null is a category of its own."""
    return F.coalesce(value.cast("string"), F.lit(MISSING))


def fit_codes(train: DataFrame, columns: Sequence[str], limit: int = TASK_ROWS) -> DataFrame:
    """(column, value, code): codes count from 0 in the sorted order of a column's values."""
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), as_category(F.col(c)).alias("value")) for c in columns])
    values = stage(train.select(F.explode(pairs).alias("p")).select("p.*").distinct(), "categories")
    ranked = running_sums(values, ["column"], ["value"], {"code": F.lit(1).cast("long")}, limit)
    return stage(ranked.withColumn("code", F.col("code").cast("int")), "codes")


def code_sizes(codes: DataFrame) -> dict[str, int]:
    """Number of known values per column."""
    return {row["column"]: row["n"] for row in
            codes.groupBy("column").agg(F.count(F.lit(1)).alias("n")).collect()}


def apply_codes(df: DataFrame, codes: DataFrame, columns: Sequence[str],
                sizes: Mapping[str, int] | None = None) -> DataFrame:
    """Replace each column by its code, -1 for values not seen in training.

    A dictionary is broadcast when its size allows it; ``sizes`` saves counting them again.
    """
    sizes = code_sizes(codes) if sizes is None else sizes
    order = df.columns
    for name in columns:
        right = codes.filter(F.col("column") == name).select(
            F.col("value").alias(name), F.col("code").alias("_code"))
        texts = df.withColumn(name, as_category(F.col(name)))
        if sizes.get(name, 0) <= BROADCAST_ROWS:
            joined = texts.join(F.broadcast(right), name, "left")
        else:
            joined = lookup(texts, right, [name])
        df = joined.withColumn(name, F.coalesce("_code", F.lit(UNSEEN))).drop("_code").select(*order)
    return df
