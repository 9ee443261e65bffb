"""Exact quantiles with linear interpolation, without holding a group's values in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from risklane.operators.ordered import TASK_ROWS, if_small, running_sums
from risklane.staging import stage


# Relative rank error of the sketch, and how far to either side of a quantile its bracket reaches.
ACCURACY = 10_000
REACH = 3.0 / ACCURACY
# Groups of at most so many rows are counted value by value.
WHOLE_ROWS = 50_000


def brackets(df: DataFrame, keys: Sequence[str], value: str, probs: Sequence[float], whole: int) -> DataFrame:
    """One row per key: ``_brackets``, ranges of values that hold the quantiles, by a mergeable sketch in one pass."""
    asked = [edge for prob in probs for edge in (max(0.0, prob - REACH), min(1.0, prob + REACH))]
    numbers = ", ".join(f"{edge!r}D" for edge in asked)
    sketch = df.groupBy(*keys).agg(F.expr(f"percentile_approx(`{value}`, array({numbers}), {ACCURACY})").alias("_q"),
                                   F.count(F.lit(1)).alias("_rows"))
    ends = []
    for i in range(len(probs)):
        low = "-double('infinity')" if asked[2 * i] == 0 else f"double(_q[{2 * i}])"
        high = "double('infinity')" if asked[2 * i + 1] == 1 else f"double(_q[{2 * i + 1}])"
        ends.append(f"named_struct('low', {low}, 'high', {high})")
    all_values = "array(named_struct('low', -double('infinity'), 'high', double('infinity')))"
    return sketch.select(*keys, F.expr(f"CASE WHEN _rows <= {whole} THEN {all_values} ELSE array({', '.join(ends)}) END").alias("_brackets"))


def counted_values(df: DataFrame, keys: Sequence[str], value: str, found: DataFrame) -> DataFrame:
    """(keys, value, _gap, _n): counts of the values inside brackets, and of all values between two brackets together.

    The latter stand behind the end of the last bracket below them (``_gap`` 1, ``value`` that end).
    """
    if keys:
        both = df.join(if_small(found), keys)
    else:
        ranges = found.first()["_brackets"]         # one row
        both = df.withColumn("_brackets", F.array(*[F.struct(F.lit(b["low"]).alias("low"), F.lit(b["high"]).alias("high")) for b in ranges]))
    here = F.col(value).cast("double")
    inside = F.exists("_brackets", lambda b: (here >= b["low"]) & (here <= b["high"]))
    below = F.array_max(F.transform("_brackets", lambda b: F.when(b["high"] < here, b["high"])))
    kind = df.schema[value].dataType
    at = F.when(inside, F.col(value)).otherwise(below.cast(kind))
    placed = both.select(*keys, at.alias("_at"), (~inside).cast("int").alias("_gap"))
    return placed.groupBy(*keys, F.col("_at").alias(value), "_gap").agg(F.count(F.lit(1)).alias("_n"))


def quantiles(df: DataFrame, keys: Sequence[str], value: str, probs: Sequence[float],
              name: str = "quantiles", limit: int = TASK_ROWS, whole: int = WHOLE_ROWS) -> DataFrame:
    """One row per key: the array of quantiles of ``value`` at ``probs`` (nulls left out), exact.

    A sketch says where each quantile lies; a second pass counts, value by value, only what lies there, and the rest as a few
    sums. Should a quantile lie outside its bracket after all, every value is counted.
    """
    keys = list(keys)
    rows = df.select(*keys, value).filter(F.col(value).isNotNull())
    found = stage(brackets(rows, keys, value, probs, whole), "brackets")
    cut = stage(_ranked(counted_values(rows, keys, value, found), keys, value, probs, name, limit), "quantiles")
    if cut.filter(F.exists(name, lambda v: v.isNull())).isEmpty():
        return cut
    every = rows.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n")).withColumn("_gap", F.lit(0))
    return _ranked(every, keys, value, probs, name, limit)


def _ranked(counts: DataFrame, keys: list[str], value: str, probs: Sequence[float], name: str, limit: int) -> DataFrame:
    """Quantiles from counted values; null where one falls between two brackets."""
    # Staged, since it is read for its size, its totals and its ranks.
    counted = stage(counts, "values")
    ranked = running_sums(counted, keys, [value, "_gap"], {"_before": F.col("_n")}, limit)
    sizes = counted.groupBy(*keys).agg(F.sum("_n").alias("_size"))
    if keys:
        ranked = ranked.join(if_small(sizes), keys)
    else:
        total = sizes.first()["_size"]
        ranked = ranked.withColumn("_size", F.lit(total).cast("long"))

    # As SQL text: one expression per quantile rather than dozens of column objects.
    def at(rank: str) -> str:
        return f"max(CASE WHEN _before <= {rank} AND {rank} < _before + _n AND _gap = 0 THEN `{value}` END)"

    picks = []
    for prob in probs:
        spot = f"{float(prob)!r}D * (_size - 1)"
        low, high = at(f"floor({spot})"), at(f"least(floor({spot}) + 1, _size - 1)")
        picks.append(f"{low} + ({high} - {low}) * max({spot} - floor({spot}))")
    return ranked.groupBy(*keys).agg(F.expr(f"array({', '.join(picks)})").alias(name))


def medians(df: DataFrame, keys: Sequence[str], value: str, name: str = "median",
            limit: int = TASK_ROWS) -> DataFrame:
    return quantiles(df, keys, value, [0.5], "_q", limit).select(*keys, F.col("_q")[0].alias(name))
