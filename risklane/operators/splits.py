"""Chronological splits and batches, as predicates on (time, id)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from risklane.operators.ordered import TASK_ROWS, Timeline, between

TIME, IDENT = "TransactionDT", "TransactionID"


def timeline(df: DataFrame, limit: int = TASK_ROWS) -> Timeline:
    return Timeline(df, TIME, IDENT, limit)


def _pieces(line: Timeline, ends: list[int], names: list) -> Column:
    """``names[i]`` for rows before position ``ends[i]``, the last name for the rest."""
    column = F.lit(names[-1])
    for bound, name in reversed(list(zip(line.rows_at(ends), names))):
        # No row stands at this end: everything that is left belongs before it.
        column = F.lit(name) if bound is None else F.when(between(TIME, IDENT, None, bound), name).otherwise(column)
    return column


def split_ends(size: int, train: float = 0.70, val: float = 0.15) -> tuple[int, int]:
    return int(size * train), int(size * (train + val))


def split_column(line: Timeline, train: float = 0.70, val: float = 0.15) -> Column:
    """'train' | 'val' | 'test' by position in time."""
    return _pieces(line, list(split_ends(line.size, train, val)), ["train", "val", "test"])


def _batch_ends(line: Timeline, batches: int, start: int) -> list[int]:
    size = (line.size - start) // batches
    return [start + size * i for i in range(batches + 1)]


def batch_column(line: Timeline, batches: int = 10, start: int = 0) -> Column:
    """1-based number of the equal batch among the rows from position ``start`` on.

    Null for earlier rows and for the few left over at the end.
    """
    if (line.size - start) // batches == 0:
        return F.lit(None).cast("int")
    ends = _batch_ends(line, batches, start)
    names = [F.lit(None).cast("int"), *range(1, batches + 1), F.lit(None).cast("int")]
    return _pieces(line, ends, names)


def with_split(df: DataFrame, limit: int = TASK_ROWS, **shares: float) -> DataFrame:
    return df.withColumn("split", split_column(timeline(df, limit), **shares))


def with_batch(df: DataFrame, batches: int = 10, limit: int = TASK_ROWS) -> DataFrame:
    return df.withColumn("batch", batch_column(timeline(df, limit), batches)).filter(F.col("batch").isNotNull())


def parts(df: DataFrame, train: float = 0.70, val: float = 0.15, limit: int = TASK_ROWS) -> dict[str, DataFrame]:
    """The three splits, each by a filter on (time, id) that a sorted parquet scan can use to skip data."""
    line = timeline(df, limit)
    first, second = line.rows_at(split_ends(line.size, train, val))
    return {"train": df.filter(between(TIME, IDENT, None, first)),
            "val": df.filter(between(TIME, IDENT, first, second)) if first else df.limit(0),
            "test": df.filter(between(TIME, IDENT, second, None)) if second else df.limit(0)}


def train_and_batches(df: DataFrame, batches: int = 10, limit: int = TASK_ROWS) -> tuple[DataFrame, DataFrame]:
    """The training rows, and the test rows in equal time-ordered batches."""
    line = timeline(df, limit)
    train_end, test_start = split_ends(line.size)
    ends = _batch_ends(line, batches, test_start)
    first, start, *_, stop = line.rows_at([train_end, test_start, *ends])      # all at once
    numbered = df.filter(between(TIME, IDENT, start, stop)).withColumn("batch", batch_column(line, batches, test_start))
    return df.filter(between(TIME, IDENT, None, first)), numbered.filter(F.col("batch").isNotNull())


def split_summary(df: DataFrame) -> DataFrame:
    """Rows, fraud rate and time range of each split."""
    return df.groupBy("split").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("isFraud") * 100, 2).alias("fraud_pct"),
        F.min(TIME).alias("first_dt"), F.max(TIME).alias("last_dt"))
