"""Joins of a row table with a one-row-per-key table that stay balanced when a key is hot."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame

from risklane.operators.ordered import TASK_ROWS, hot_keys, if_small, split_hot


def lookup(df: DataFrame, right: DataFrame, keys: Sequence[str], limit: int = TASK_ROWS) -> DataFrame:
    """Left join with ``right``, which has one row per key.

    Rows of hot keys meet a broadcast of just those keys' rows; the others are joined by shuffle.
    """
    keys = list(keys)
    hot = hot_keys(df, keys, limit)
    if hot is None:
        return df.join(right, keys, "left")
    hot_rows, others = split_hot(df, keys, hot)
    hot_right, _ = split_hot(right, keys, hot)
    return others.join(right, keys, "left").unionByName(hot_rows.join(if_small(hot_right), keys, "left"))


def attach(df: DataFrame, keys: Sequence[str], limit: int = TASK_ROWS, **aggregates: Column) -> DataFrame:
    """Add per-key aggregates to every row; the aggregates are combined before the shuffle."""
    totals = df.groupBy(*keys).agg(*[agg.alias(name) for name, agg in aggregates.items()])
    return lookup(df, totals, keys, limit)
