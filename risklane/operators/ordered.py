"""Ordered running sums that never hold a whole key, or the whole table, in one task.

Every operator that needs "what came before this row" is built on ``running_sums``. It windows a
key whole only after checking that no key has more than ``limit`` rows. Beyond that it uses
``range_scan``: rows are range-partitioned by (key, order), summed inside each slice, and each
slice adds the total carried in from earlier slices of the same key.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from risklane.staging import stage

# Most rows of one key that a single task may sort and window.
TASK_ROWS = 1_000_000
# Rows of a slice of a scan, on average, if that takes more slices than a shuffle has partitions.
SLICE_ROWS = 250_000
# Most rows of a table that may be broadcast.
BROADCAST_ROWS = 200_000


def hot_keys(df: DataFrame, keys: Sequence[str], limit: int = TASK_ROWS) -> DataFrame | None:
    """Keys with more than ``limit`` rows, or None. There are at most rows/limit of them.

    Counts are combined before the shuffle, and only the key columns are read. The few keys found are
    staged, so the rows are counted once however often the keys are used.
    """
    hot = stage(df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"))
                  .filter(F.col("_rows") > limit).select(*keys), "hot")
    return None if hot.isEmpty() else hot


def small(df: DataFrame, limit: int = BROADCAST_ROWS) -> bool:
    """Whether ``df`` has at most ``limit`` rows. Tasks count; no row moves."""
    return df.count() <= limit


def if_small(df: DataFrame) -> DataFrame:
    """With a broadcast hint when the size, checked here, allows it."""
    return F.broadcast(df) if small(df) else df


def split_hot(df: DataFrame, keys: Sequence[str], hot: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows of the hot keys, all other rows). A null key is a key like any other."""
    few = if_small(hot.select(*[F.col(key).alias(f"_h_{key}") for key in keys]))
    same = F.lit(True)
    for key in keys:
        same &= F.col(key).eqNullSafe(F.col(f"_h_{key}"))
    return df.join(few, same, "left_semi"), df.join(few, same, "left_anti")


def running_sums(df: DataFrame, keys: Sequence[str], order: Sequence[str],
                 sums: Mapping[str, Column], limit: int = TASK_ROWS) -> DataFrame:
    """Add, per row, the sums over the earlier rows of its key (0 for the first row).

    ``order`` must be unique inside a key. Keys of at most ``limit`` rows take one shuffle and one
    sort; the rows of larger keys go through ``range_scan``.
    """
    if not keys:
        return (window_sums if small(df, limit) else range_scan)(df, keys, order, sums)
    hot = hot_keys(df, keys, limit)
    if hot is None:
        return window_sums(df, keys, order, sums)
    hot_rows, others = split_hot(df, keys, hot)
    return window_sums(others, keys, order, sums).unionByName(range_scan(hot_rows, keys, order, sums))


def window_sums(df: DataFrame, keys: Sequence[str], order: Sequence[str],
                sums: Mapping[str, Column]) -> DataFrame:
    before = W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    return df.select("*", *[
        F.coalesce(F.sum(value).over(before), F.lit(0)).alias(name) for name, value in sums.items()
    ])


def range_scan(df: DataFrame, keys: Sequence[str], order: Sequence[str],
               sums: Mapping[str, Column]) -> DataFrame:
    """``running_sums`` for keys of any size. What a task sorts does not grow with the table: slices get more, not larger."""
    usual = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    needed = -(-df.count() // SLICE_ROWS)
    number = [needed] if needed > usual else []         # else as many as any shuffle
    slices = stage(
        df.select("*", *[value.alias(f"_in_{name}") for name, value in sums.items()])
          .repartitionByRange(*number, *keys, *order)
          .withColumn("_slice", F.spark_partition_id()),
        "slices",
    )
    totals = slices.groupBy("_slice", *keys).agg(
        *[F.sum(f"_in_{name}").alias(f"_sum_{name}") for name in sums])
    # Slices are sorted by key first, so a slice continues at most one key from earlier slices:
    # this table never has more rows than there are slices.
    earlier = W.partitionBy(*keys).orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    carried = totals.select(
        F.col("_slice").alias("_c_slice"),
        *[F.col(key).alias(f"_c_{key}") for key in keys],
        F.count(F.lit(1)).over(earlier).alias("_earlier"),
        *[F.sum(f"_sum_{name}").over(earlier).alias(f"_carry_{name}") for name in sums],
    ).filter("_earlier > 0").drop("_earlier")

    matches = F.col("_slice") == F.col("_c_slice")
    for key in keys:
        matches &= F.col(key).eqNullSafe(F.col(f"_c_{key}"))
    inside = W.partitionBy("_slice", *keys).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    if number:
        slices = slices.repartition(needed, "_slice", *keys)
    local = slices.select(*df.columns, "_slice", *[
        F.sum(f"_in_{name}").over(inside).alias(f"_local_{name}") for name in sums])
    return local.join(F.broadcast(carried), matches, "left").select(*df.columns, *[
        (F.coalesce(f"_local_{name}", F.lit(0)) + F.coalesce(f"_carry_{name}", F.lit(0))).alias(name)
        for name in sums
    ])


def positions(df: DataFrame, order: Sequence[str], name: str = "position",
              limit: int = TASK_ROWS) -> DataFrame:
    """Add the 0-based global row number."""
    return running_sums(df, [], order, {name: F.lit(1).cast("long")}, limit)


def rolling_mean(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, size: int,
                 name: str, limit: int = TASK_ROWS) -> DataFrame:
    """Mean of the last ``size`` rows of the key, null until that many exist.

    A difference of two running sums, so the cost does not grow with ``size``.
    """
    seen = running_sums(df, keys, order, {"_at": F.lit(1).cast("long"), "_before": F.col(value)}, limit)
    seen = seen.withColumn("_through", F.col("_before") + F.col(value))
    # Segments of ``span`` rows, each seeded with the last ``size`` rows of the one before it.
    span = max(limit, size)
    segment = F.floor(F.col("_at") / span)
    lands_in = F.when(F.col("_at") % span >= span - size, F.array(segment, segment + 1)) \
                .otherwise(F.array(segment))
    spread = seen.withColumn("_segment", F.explode(lands_in))
    line = W.partitionBy(*keys, "_segment").orderBy("_at")
    left_out = F.coalesce(F.lag("_through", size).over(line), F.lit(0))
    rolled = spread.withColumn(
        name, F.when(F.col("_at") >= size - 1, (F.col("_through") - left_out) / size))
    return rolled.filter(F.col("_segment") == segment).select(*df.columns, name)


class Timeline:
    """Positions of rows in (time, ident) order, found without ordering the rows.

    One scan counts rows per second. A position is located by its second, and only the rows of that
    second are ranked. This turns a positional split into a plain predicate on the two columns.
    """

    def __init__(self, df: DataFrame, time: str, ident: str, limit: int = TASK_ROWS) -> None:
        self.df, self.time, self.ident, self.limit = df, time, ident, limit
        self.seconds = stage(df.groupBy(time).agg(F.count(F.lit(1)).alias("_rows")), "seconds")
        found = self.seconds.agg(F.sum("_rows").alias("rows"), F.count(F.lit(1)).alias("seconds")).first()
        self.size: int = found["rows"] or 0
        self._sums = window_sums if found["seconds"] <= limit else range_scan
        self._known: dict[int, tuple[int, int]] = {}

    def rows_at(self, ranks: Sequence[int]) -> list[tuple[int, int] | None]:
        """(time, ident) of the rows at these 0-based ranks; None past the end."""
        wanted = sorted({rank for rank in ranks if rank < self.size and rank not in self._known})
        if wanted:
            self._locate(wanted)
        return [self._known.get(rank) for rank in ranks]

    def _locate(self, wanted: list[int]) -> None:
        starts = self._sums(self.seconds, [], [self.time], {"_start": F.col("_rows")})
        holds = F.exists(F.array(*[F.lit(rank).cast("long") for rank in wanted]),
                         lambda rank: (rank >= F.col("_start")) & (rank < F.col("_start") + F.col("_rows")))
        found = starts.filter(holds).collect()          # at most one row per wanted rank
        spot = {rank: (row[self.time], rank - row["_start"]) for row in found for rank in wanted
                if row["_start"] <= rank < row["_start"] + row["_rows"]}
        ties = self.df.filter(F.col(self.time).isin(sorted({at for at, _ in spot.values()}))) \
                      .select(self.time, self.ident)
        sums = window_sums if max(row["_rows"] for row in found) <= self.limit else range_scan
        ranked = sums(ties, [self.time], [self.ident], {"_offset": F.lit(1).cast("long")})
        chosen = F.lit(False)
        for at, offset in set(spot.values()):
            chosen |= (F.col(self.time) == at) & (F.col("_offset") == offset)
        idents = {(row[self.time], row["_offset"]): row[self.ident] for row in ranked.filter(chosen).collect()}
        self._known.update({rank: (place[0], idents[place]) for rank, place in spot.items()})


def between(time: str, ident: str, start: tuple[int, int] | None, stop: tuple[int, int] | None) -> Column:
    """True for rows from ``start`` on and before ``stop`` in (time, ident) order; None is no bound.

    The plain comparisons of ``time`` come first: they are what a scan can be pruned by.
    """
    inside = F.lit(True)
    if start is not None:
        at, key = start
        inside &= (F.col(time) >= at) & ((F.col(time) > at) | (F.col(ident) >= key))
    if stop is not None:
        at, key = stop
        inside &= (F.col(time) <= at) & ((F.col(time) < at) | (F.col(ident) < key))
    return inside
