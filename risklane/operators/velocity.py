"""Per-card velocity: how much a card was used before this payment.

Output is one row per payment: its id, card, time and the ``vel_`` columns, to be joined back by
id. Amounts are integer cents, so every sum is exact whatever order it is added in.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import partial

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from risklane.functions.clock import DAY, HOUR, WEEK, bucket
from risklane.operators.ordered import TASK_ROWS, hot_keys, range_scan, running_sums, split_hot, window_sums
from risklane.operators.skew import attach, lookup

KEY = ["TransactionID", "card1", "TransactionDT"]
HORIZONS = {"1h": HOUR, "24h": DAY, "7d": WEEK}
EXACT = "decimal(38,0)"


def card_totals(df: DataFrame) -> DataFrame:
    """Number, sum and sum of squares of the amounts of each card."""
    return df.groupBy("card1").agg(
        F.count(F.lit(1)).alias("old_n"), F.sum("cents").alias("old_sum"),
        F.sum(_square(F.col("cents"))).cast(EXACT).alias("old_squares"))


def exact_velocity(df: DataFrame, keep: Sequence[str] = (), limit: int = TASK_ROWS,
                   earlier: DataFrame | None = None) -> DataFrame:
    """Prior count and spend in the last hour, day and week, all prior payments, and the z-score.

    "Prior" means earlier in (time, id) order; a window reaches back h seconds, both ends included.
    ``earlier`` holds ``card_totals`` of payments before those in ``df``, older than every window.
    """
    df = df.select(*KEY, "cents", *keep)
    hot = hot_keys(df, ["card1"], limit)
    if hot is None:
        history = _history_by_window(df)
    else:
        hot_rows, others = split_hot(df, ["card1"], hot)
        history = _history_by_window(others).unionByName(_history_by_scan(hot_rows, keep))
    if earlier is not None:
        history = lookup(history, earlier, ["card1"], limit)
        for now, old in (("_n", "old_n"), ("_sum", "old_sum"), ("_squares", "old_squares")):
            added = F.coalesce(old, F.lit(0))
            history = history.withColumn(now, F.col(now) + added)
            for name in HORIZONS if now != "_squares" else ():
                history = history.withColumn(f"{now}_{name}", F.col(f"{now}_{name}") + added)
    return from_history(history, keep)


def from_history(history: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Velocity from running totals: ``_n``, ``_sum``, ``_squares`` of all prior payments, ``_n_h`` and ``_sum_h`` of those older
    than horizon h."""
    spent = {name: (F.col("_sum") - F.col(f"_sum_{name}")).cast("double") / 100 for name in HORIZONS}
    return history.select(
        *KEY, *keep,
        *[(F.col("_n") - F.col(f"_n_{name}")).alias(f"vel_tx_{name}") for name in HORIZONS],
        F.col("_n").alias("vel_tx_prior"),
        *[spent[name].alias(f"vel_amt_{name}") for name in ("1h", "24h")],
        z_score(population=True).alias("vel_amt_zscore"),
    )


def _history_by_window(df: DataFrame) -> DataFrame:
    """One shuffle by card: running totals to the previous row, less those older than each horizon.

    Frames grow from the start of the card, which Spark evaluates in one pass over the sorted rows.
    """
    line = W.partitionBy("card1").orderBy("TransactionDT", "TransactionID")
    before = line.rowsBetween(W.unboundedPreceding, -1)
    by_time = W.partitionBy("card1").orderBy("TransactionDT")
    cents = F.col("cents")
    columns = [
        (F.row_number().over(line) - 1).cast("long").alias("_n"),
        F.coalesce(F.sum(cents).over(before), F.lit(0)).alias("_sum"),
        F.coalesce(F.sum(_square(cents)).over(before), F.lit(0)).cast(EXACT).alias("_squares"),
    ]
    for name, seconds in HORIZONS.items():
        older = by_time.rangeBetween(W.unboundedPreceding, -seconds - 1)
        columns += [F.count(F.lit(1)).over(older).alias(f"_n_{name}"),
                    F.coalesce(F.sum(cents).over(older), F.lit(0)).alias(f"_sum_{name}")]
    return df.select("*", *columns)


def _history_by_scan(df: DataFrame, keep: Sequence[str]) -> DataFrame:
    """The same columns for cards too large for one task.

    Each payment also sends a mark to the start of each of its horizons. One scan in (card, time)
    order gives marks and payments their running totals; the marks then return to their payment.
    """
    zero = F.lit(0).cast("long")
    events = [F.struct(F.col("TransactionDT").alias("at"), F.lit("row").alias("mark"),
                       F.lit(1).cast("long").alias("one"), F.col("cents").alias("amount"))]
    events += [F.struct((F.col("TransactionDT") - seconds).alias("at"), F.lit(name).alias("mark"),
                        zero.alias("one"), zero.alias("amount"))
               for name, seconds in HORIZONS.items()]
    spread = df.select(*KEY, "cents", *keep, F.explode(F.array(*events)).alias("e")) \
               .select(*KEY, "cents", *keep, "e.*") \
               .withColumn("is_row", F.col("mark") == "row")
    # False sorts first: a mark stands before the payments of its own second.
    scanned = range_scan(spread, ["card1"], ["at", "is_row", "TransactionID", "mark"], {
        "_n": F.col("one"), "_sum": F.col("amount"), "_squares": _square(F.col("amount"))})

    def at(mark: str, column: str) -> Column:
        return F.max(F.when(F.col("mark") == mark, F.col(column)))

    return scanned.groupBy(*KEY).agg(
        *[F.max(name).alias(name) for name in ("cents", *keep)],
        at("row", "_n").alias("_n"), at("row", "_sum").alias("_sum"),
        at("row", "_squares").cast(EXACT).alias("_squares"),
        *[column for name in HORIZONS for column in (
            at(name, "_n").alias(f"_n_{name}"), at(name, "_sum").alias(f"_sum_{name}"))],
    )


def _square(cents: Column) -> Column:
    return cents.cast("decimal(18,0)") * cents.cast("decimal(18,0)")


def z_score(population: bool) -> Column:
    """Distance of the amount from the card's earlier amounts in standard deviations; 0 with fewer than two.

    n * sum(x^2) - sum(x)^2 is formed in exact integers, so equal amounts give exactly zero spread.
    """
    n, total = F.col("_n"), F.col("_sum").cast("decimal(19,0)")
    spread = (F.col("_n").cast("decimal(12,0)") * F.col("_squares").cast("decimal(26,0)")
              - total * total).cast("double")
    divisor = n * n if population else n * (n - 1)
    deviation = F.sqrt(spread / divisor.cast("double")) / 100
    mean = F.col("_sum").cast("double") / n.cast("double") / 100
    amount = F.col("cents").cast("double") / 100
    return F.when(n >= 2, (amount - mean) / (deviation + 1e-6)).otherwise(F.lit(0.0))


def bucketed_velocity(df: DataFrame, keep: Sequence[str] = (), limit: int = TASK_ROWS) -> DataFrame:
    """The cheap variant: prior payments inside the calendar hour, the day, and ever."""
    df = df.select(*KEY, "cents", *keep) \
           .withColumn("_hour", bucket("TransactionDT", HOUR)) \
           .withColumn("_day", bucket("TransactionDT", DAY))
    hot = hot_keys(df, ["card1"], limit)
    if hot is None:
        seen = _seen(df, window_sums)           # all three from one shuffle by card
    else:
        hot_rows, others = split_hot(df, ["card1"], hot)
        # An hour or a day of a hot card may still be large, so these sums check their own keys.
        seen = _seen(others, window_sums).unionByName(_seen(hot_rows, partial(running_sums, limit=limit)))
    return seen.select(
        *KEY, *keep, "vel_tx_1h", "vel_tx_24h", F.col("_n").alias("vel_tx_prior"),
        (F.col("_sum_hour").cast("double") / 100).alias("vel_amt_1h"),
        (F.col("_sum_day").cast("double") / 100).alias("vel_amt_24h"),
        z_score(population=False).alias("vel_amt_zscore"),
    )


def _seen(df: DataFrame, sums: Callable[..., DataFrame]) -> DataFrame:
    order = ["TransactionDT", "TransactionID"]
    one, cents = F.lit(1).cast("long"), F.col("cents")
    df = sums(df, ["card1"], order, {"_n": one, "_sum": cents, "_squares": _square(cents)})
    df = sums(df, ["card1", "_day"], order, {"vel_tx_24h": one, "_sum_day": cents})
    return sums(df, ["card1", "_hour"], order, {"vel_tx_1h": one, "_sum_hour": cents})


def emails_per_card_day(df: DataFrame, limit: int = TASK_ROWS) -> DataFrame:
    """Distinct email domains of the card on the calendar day (later rows of the day included)."""
    df = df.select(*KEY, "P_emaildomain", bucket("TransactionDT", DAY).alias("day"))
    return attach(df, ["card1", "day"], limit,
                  vel_unique_emails=F.count_distinct("P_emaildomain"))


def emails_per_card_bin(df: DataFrame, bins: int = 50, limit: int = TASK_ROWS) -> DataFrame:
    """As above over equal-width, right-closed bins of the whole day range."""
    df = df.select(*KEY, "P_emaildomain", bucket("TransactionDT", DAY).alias("day"))
    span = df.agg(F.min("day").alias("low"), F.max("day").alias("high")).first()
    width = max(span["high"] - span["low"], 1)
    steps = (F.col("day") - span["low"]) * bins
    binned = df.withColumn("bin", F.greatest(F.lit(1), F.ceil(steps / width)).cast("long"))
    return attach(binned, ["card1", "bin"], limit,
                  vel_unique_emails=F.count_distinct("P_emaildomain"))


def emails_prior_24h(df: DataFrame, limit: int = TASK_ROWS) -> DataFrame:
    """Distinct email domains among the card's earlier payments of the last day; nothing later is looked at.

    A payment stands for its domain until the card's next one with that domain, or for a day, whichever ends first. So the
    distinct domains before a payment are the earlier payments, less those among them that took over from one of the last
    day, less those whose day ended without a successor: three running counts, whatever the width of the window.
    """
    df = df.select(*KEY, "P_emaildomain")
    hot = hot_keys(df, ["card1"], limit)
    if hot is None:
        counted = _domains_by_window(df)
    else:
        hot_rows, others = split_hot(df, ["card1"], hot)
        counted = _domains_by_window(others).unionByName(_domains_by_scan(hot_rows))
    return counted.select(*KEY, (F.col("_seen") - F.col("_ended")).cast("long").alias("vel_emails_prior_24h"))


def _domains_by_window(df: DataFrame) -> DataFrame:
    """One shuffle by card: what each payment starts, takes over and ends, and the running counts of these."""
    same = W.partitionBy("card1", "P_emaildomain").orderBy("TransactionDT", "TransactionID")
    known, time = F.col("P_emaildomain").isNotNull(), F.col("TransactionDT")
    takes = known & F.coalesce(time - F.lag("TransactionDT").over(same) <= DAY, F.lit(False))
    taken = F.coalesce(F.lead("TransactionDT").over(same) - time <= DAY, F.lit(False))
    marked = df.repartition("card1").select(
        *KEY, (known & ~takes).cast("long").alias("_new"), (known & ~taken).cast("long").alias("_last"))
    line = W.partitionBy("card1").orderBy("TransactionDT", "TransactionID")
    day_over = W.partitionBy("card1").orderBy("TransactionDT").rangeBetween(W.unboundedPreceding, -DAY - 1)
    return marked.select(*KEY, F.coalesce(F.sum("_new").over(line.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_seen"),
                         F.coalesce(F.sum("_last").over(day_over), F.lit(0)).alias("_ended"))


def _domains_by_scan(df: DataFrame) -> DataFrame:
    """The same counts for cards too large for one task, from two scans with marks a day before and after each payment."""
    one = F.col("P_emaildomain").isNotNull().cast("long")
    near = _at_marks(df, ["card1", "P_emaildomain"], ["P_emaildomain"], {"before": -DAY, "after": DAY}, {"_n": one})
    marked = near.select(*KEY, (one * (F.col("_n_row") == F.col("_n_before")).cast("long")).alias("_new"),
                         (one * (F.col("_n_after") == F.col("_n_row") + 1).cast("long")).alias("_last"))
    found = _at_marks(marked, ["card1"], ["_new", "_last"], {"before": -DAY}, {"_new": F.col("_new"), "_last": F.col("_last")})
    return found.select(*KEY, F.col("_new_row").alias("_seen"), F.col("_last_before").alias("_ended"))


def _at_marks(df: DataFrame, keys: Sequence[str], keep: Sequence[str], marks: Mapping[str, int],
              sums: Mapping[str, Column]) -> DataFrame:
    """Per payment, running sums over its key at the payment ("row") and at its marks, each so many seconds away.

    A mark in the past stands before the payments of its second, one in the future after them.
    """
    events = [F.struct(F.col("TransactionDT").alias("at"), F.lit(1).alias("turn"), F.lit("row").alias("mark"))]
    events += [F.struct((F.col("TransactionDT") + away).alias("at"), F.lit(0 if away < 0 else 2).alias("turn"), F.lit(name).alias("mark"))
               for name, away in marks.items()]
    kept = list(dict.fromkeys([*KEY, *keep]))
    spread = df.select(*kept, F.explode(F.array(*events)).alias("e")).select(*kept, "e.*")
    scanned = range_scan(spread, keys, ["at", "turn", "TransactionID", "mark"], {
        f"_run_{name}": F.when(F.col("mark") == "row", value).otherwise(F.lit(0)) for name, value in sums.items()})
    return scanned.groupBy(*KEY).agg(
        *[F.max(name).alias(name) for name in keep],
        *[F.max(F.when(F.col("mark") == mark, F.col(f"_run_{name}"))).alias(f"{name}_{mark}")
          for name in sums for mark in ("row", *marks)])


BAND_EDGES = [(0, 1, "1"), (1, 3, "2-3"), (3, 5, "4-5"), (5, 10, "6-10"), (10, 999, "11-999")]


def fraud_by_band(velocity: DataFrame) -> DataFrame:
    """Fraud rate by number of payments in the last day. Bands are open on the left: none has zero."""
    count = F.col("vel_tx_24h")
    band = F.lit(None).cast("string")
    order = F.lit(None).cast("int")
    for i, (low, high, label) in enumerate(BAND_EDGES):
        inside = (count > low) & (count <= high)
        band, order = F.when(inside, label).otherwise(band), F.when(inside, i).otherwise(order)
    return (velocity.select(band.alias("band"), order.alias("band_order"), "isFraud")
            .filter(F.col("band").isNotNull())
            .groupBy("band", "band_order")
            .agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("isFraud").cast("long")).alias("frauds"),
                 F.round(F.avg("isFraud") * 100, 4).alias("fraud_pct")))


def alarms(velocity: DataFrame) -> DataFrame:
    """Payments on busy cards (more than five in a day) and amount spikes (z above three)."""
    return velocity.agg(F.count_if(F.col("vel_tx_24h") > 5).alias("high_velocity"),
                        F.count_if(F.col("vel_amt_zscore") > 3).alias("amount_spikes"))
