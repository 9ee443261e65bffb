"""Profiling of a labelled transaction table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from risklane.operators.quantiles import medians, quantiles

# Right-closed amount bands (fixed values). Zero, negative and larger amounts belong to none.
AMOUNT_BANDS = [(0, 50, "₹0-50"), (50, 100, "₹51-100"), (100, 500, "₹101-500"),
                (500, 1000, "₹501-1k"), (1000, 50000, "₹1k+")]


def rate(label: str | Column, digits: int = 2) -> Column:
    return F.round(F.avg(label) * 100, digits)


def summary(df: DataFrame, amount: str = "TransactionAmt", label: str = "isFraud") -> DataFrame:
    """One row: totals, fraud rate, mean and median amount, legit-to-fraud ratio."""
    positives = F.sum(F.col(label).cast("long"))
    total = F.count(F.lit(1))
    totals = df.agg(
        total.alias("total"), positives.alias("fraud_count"), (total - positives).alias("legit_count"),
        rate(label).alias("fraud_pct"), F.round(F.avg(amount), 2).alias("avg_amt"),
        F.round((total - positives) / F.nullif(positives, F.lit(0)), 1).alias("imbalance"))
    middle = medians(df, [], amount).first()["median"]
    return totals.withColumn("med_amt", F.round(F.lit(middle), 2))


def null_rates(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(column, null_pct) from one pass over the table, however many columns there are."""
    columns = list(columns or df.columns)
    shares = df.agg(*[F.avg(F.col(c).isNull().cast("double")).alias(c) for c in columns])
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").alias("share")) for c in columns])
    return shares.select(F.explode(pairs).alias("p")).select(
        "p.column", F.round(F.col("p.share") * 100, 4).alias("null_pct"))


def mostly_null(df: DataFrame, over_pct: float = 40, top: int = 20) -> DataFrame:
    return (null_rates(df).filter(F.col("null_pct") > over_pct)
            .orderBy(F.desc("null_pct"), "column").limit(top))


def describe_amounts(df: DataFrame, column: str = "TransactionAmt") -> DataFrame:
    """count, mean, sample deviation, min, quartiles, max as one row."""
    stats = df.agg(F.count(column).alias("n"), F.round(F.avg(column), 6).alias("mean"),
                   F.round(F.stddev_samp(column), 6).alias("std"),
                   F.min(column).alias("min"), F.max(column).alias("max"))
    quartiles = quantiles(df, [], column, [0.25, 0.5, 0.75], "q").first()["q"]
    return stats.withColumns({
        name: F.round(F.lit(value), 6) for name, value in zip(["p25", "p50", "p75"], quartiles)})


def amounts_by_class(df: DataFrame, amount: str = "TransactionAmt", label: str = "isFraud") -> DataFrame:
    means = df.groupBy(label).agg(F.round(F.avg(amount), 4).alias("mean_amt"))
    middle = medians(df, [label], amount).select(label, F.round("median", 4).alias("median_amt"))
    return means.join(middle, label)


def class_counts(df: DataFrame, label: str = "isFraud") -> DataFrame:
    """Rows and share of each class. The window is over the counts: one row per class."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(W.partitionBy())
    return counts.select(label, "n", F.round(F.col("n") * 100 / total, 4).alias("pct"))


def rates_by_dims(df: DataFrame, dims: Sequence[str], label: str = "isFraud") -> DataFrame:
    """(dim, value, n, fraud_pct) for several dimensions at once; null values belong to no group.

    One pass with grouping sets. Partial counts are combined before the shuffle, so a value held by
    a third of the rows arrives as one row per task.
    """
    grouped = df.groupingSets([[F.col(d)] for d in dims], *[F.col(d) for d in dims]).agg(
        F.grouping_id().alias("_set"), F.count(F.lit(1)).alias("n"), rate(label).alias("fraud_pct"))
    # grouping_id has one bit per dimension, 0 where the dimension is part of the set.
    everything = (1 << len(dims)) - 1
    dim = value = F.lit(None).cast("string")
    for i, name in enumerate(dims):
        mine = F.col("_set") == everything - (1 << (len(dims) - 1 - i))
        dim = F.when(mine, F.lit(name)).otherwise(dim)
        value = F.when(mine, F.col(name).cast("string")).otherwise(value)
    return grouped.select(dim.alias("dim"), value.alias("value"), "n", "fraud_pct") \
                  .filter(F.col("value").isNotNull())


def riskiest(df: DataFrame, dim: str, min_rows: int, top: int, label: str = "isFraud") -> DataFrame:
    """The values of ``dim`` with the highest fraud rate among those with more than ``min_rows`` rows."""
    return (df.filter(F.col(dim).isNotNull()).groupBy(dim)
            .agg(F.count(F.lit(1)).alias("n"), F.avg(label).alias("_rate"))
            .filter(F.col("n") > min_rows)
            .orderBy(F.desc("_rate"), dim).limit(top)
            .select(dim, "n", F.round(F.col("_rate") * 100, 2).alias("fraud_pct")))


def amount_band(amount: Column) -> Column:
    band = F.lit(None).cast("string")
    for low, high, label in AMOUNT_BANDS:
        band = F.when((amount > low) & (amount <= high), label).otherwise(band)
    return band


def rates_by_amount(df: DataFrame, amount: str = "TransactionAmt", label: str = "isFraud") -> DataFrame:
    return (df.select(amount_band(F.col(amount)).alias("band"), label)
            .filter(F.col("band").isNotNull())
            .groupBy("band").agg(F.count(F.lit(1)).alias("n"), rate(label).alias("fraud_pct")))


def correlations(df: DataFrame, columns: Sequence[str], label: str = "isFraud") -> DataFrame:
    """Pearson correlation of each column with the label, over the rows where the column is present."""
    columns = [c for c in columns if c in df.columns]
    wide = df.agg(*[
        F.corr(F.when(F.col(c).isNotNull(), F.col(c).cast("double")), F.col(label).cast("double")).alias(c)
        for c in columns])
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("r")) for c in columns])
    return wide.select(F.explode(pairs).alias("p")).select(
        "p.column", F.round("p.r", 4).alias("corr")).orderBy(F.desc("corr"))


def smallest_types(df: DataFrame) -> dict[str, T.DataType]:
    """The narrowest type that holds each numeric column, from one pass of minima and maxima."""
    whole = [f.name for f in df.schema.fields if isinstance(f.dataType, T.IntegralType)]
    real = [f.name for f in df.schema.fields if isinstance(f.dataType, T.DoubleType)]
    if not whole and not real:
        return {}
    spans = df.agg(*[agg(c).alias(f"{tag}:{c}") for c in whole + real
                     for tag, agg in (("lo", F.min), ("hi", F.max))]).first()
    sizes = [(T.ByteType(), 1 << 7), (T.ShortType(), 1 << 15), (T.IntegerType(), 1 << 31), (T.LongType(), 1 << 63)]
    largest_float = 3.4028234663852886e38
    chosen: dict[str, T.DataType] = {}
    for name in whole + real:
        low, high = spans[f"lo:{name}"], spans[f"hi:{name}"]
        if low is None:
            continue
        if name in whole:
            chosen[name] = next(kind for kind, top in sizes if -top <= low and high < top)
        elif -largest_float <= low and high <= largest_float:
            chosen[name] = T.FloatType()
    return chosen


def narrow(df: DataFrame) -> DataFrame:
    chosen = smallest_types(df)
    return df.select(*[F.col(c).cast(chosen[c]).alias(c) if c in chosen else F.col(c) for c in df.columns])
