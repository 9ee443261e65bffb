"""The feature matrix: fitted on the training rows, then built for any split or for new payments."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T

from risklane.functions.clock import log_amount, time_columns
from risklane.operators import encode, shaping
from risklane.operators.ordered import TASK_ROWS
from risklane.operators.skew import attach, lookup
from risklane.staging import stage

KEYS = ["TransactionID", "isFraud"]
DERIVED = ["hour_sin", "hour_cos", "dow_sin", "dow_cos", "hour_raw", "log_TransactionAmt",
           "card1_velocity", "card1_amt_mean", "amt_deviation"]
ADDRESS_FLAGS = ["addr1_nullflag", "addr2_nullflag"]


@dataclass(frozen=True)
class Fitted:
    """What training fixes: input columns kept, categories, their codes, card profiles, feature order."""

    kept: list[str]
    categories: list[str]
    codes: DataFrame
    code_sizes: dict[str, int]
    profile: DataFrame
    names: list[str]


def card_profile(train: DataFrame) -> DataFrame:
    """Mean, spread and number of amounts per card; a single payment has no spread."""
    return train.groupBy("card1").agg(
        F.avg("TransactionAmt").alias("profile_mean"),
        (F.coalesce(F.stddev_samp("TransactionAmt"), F.lit(0.0)) + 1e-6).alias("profile_std"),
        F.count(F.lit(1)).alias("profile_count"))


def time_and_amount(df: DataFrame) -> DataFrame:
    return df.withColumns({**time_columns(F.col("TransactionDT")),
                           "log_TransactionAmt": log_amount(F.col("TransactionAmt"))})


def card_columns(count: Column, mean: Column) -> dict[str, Column]:
    return {"card1_velocity": count.cast("int"), "card1_amt_mean": mean.cast("float"),
            "amt_deviation": (F.col("TransactionAmt") - mean).cast("float")}


def card_groups(df: DataFrame, limit: int = TASK_ROWS) -> DataFrame:
    """Count and mean over all rows of the card in this table, and each amount's distance from the mean."""
    grouped = attach(df, ["card1"], limit, _count=F.count("TransactionID"), _mean=F.avg("TransactionAmt"))
    return grouped.withColumns(card_columns(F.col("_count"), F.col("_mean"))).drop("_count", "_mean")


def fit(train: DataFrame, limit: int = TASK_ROWS) -> Fitted:
    sparse = set(shaping.sparse_columns(train))
    categories = [c for c in shaping.present(train, shaping.CATEGORIES) if c not in sparse]
    numbers = [f.name for f in train.schema.fields if isinstance(f.dataType, T.NumericType) and f.name not in sparse]
    kept = [c for c in train.columns if c in numbers or c in categories]
    flags = ADDRESS_FLAGS if {"addr1", "addr2"} <= set(kept) else []
    names = [c for c in kept if c not in shaping.NOT_FEATURES] + DERIVED + flags
    codes = encode.fit_codes(train, categories, limit)
    return Fitted(kept, categories, codes, encode.code_sizes(codes), stage(card_profile(train), "profile"), names)


def build(df: DataFrame, fitted: Fitted, limit: int = TASK_ROWS, keep: tuple[str, ...] = tuple(KEYS)) -> DataFrame:
    """Features of one split, in the training order, next to the id and label (or the columns ``keep`` of the table)."""
    df = df.select(*[c for c in fitted.kept if c in df.columns])
    df = card_groups(time_and_amount(df), limit)
    return _finish(df, fitted, list(keep))


def build_all(parts: dict[str, DataFrame], fitted: Fitted, limit: int = TASK_ROWS) -> DataFrame:
    """Features of several splits in one table, each with card groups of its own, and the name of the split."""
    built = [build(df, fitted, limit).withColumn("split", F.lit(name)) for name, df in parts.items()]
    return reduce(lambda a, b: a.unionByName(b), built)


def serve(df: DataFrame, fitted: Fitted, keep: tuple[str, ...] = ("TransactionID",),
          limit: int = TASK_ROWS) -> DataFrame:
    """The same features for new payments: cards are looked up in the training profile.

    Columns a request lacks count as null. A card never seen has its own amount as mean and count one.
    """
    lacking = [c for c in fitted.kept if c not in df.columns and c not in KEYS]
    df = df.withColumns({c: F.lit(None).cast("string" if c in fitted.categories else "double") for c in lacking})
    df = df.withColumns({
        "TransactionDT": F.coalesce(F.col("TransactionDT").cast("double"), F.lit(0.0)),
        "TransactionAmt": F.coalesce(F.col("TransactionAmt").cast("double"), F.lit(0.0)),
        "card1": F.coalesce(F.col("card1").cast("long"), F.lit(-1).cast("long"))})
    df = lookup(time_and_amount(df), fitted.profile, ["card1"], limit)
    df = df.withColumns(card_columns(F.coalesce("profile_count", F.lit(1)),
                                     F.coalesce("profile_mean", "TransactionAmt")))
    return _finish(df, fitted, list(keep))


def _finish(df: DataFrame, fitted: Fitted, keep: list[str]) -> DataFrame:
    df = shaping.flag_addresses(df)
    df = encode.apply_codes(df, fitted.codes, [c for c in fitted.categories if c in df.columns], fitted.code_sizes)
    aligned = shaping.align(df, fitted.names, keep)
    numbers = [f.name for f in aligned.schema.fields if isinstance(f.dataType, T.NumericType) and f.name not in keep]
    return aligned.na.fill(shaping.SENTINEL, numbers)


REQUEST_START = 9_000_000       # seconds added to the hour of a request (fixed value)


def from_requests(requests: DataFrame, start: int = REQUEST_START) -> DataFrame:
    """Scoring requests as payments."""
    return requests.select(
        F.col("request_id").alias("TransactionID"),
        (F.col("hour").cast("long") * 3600 + start).alias("TransactionDT"),
        F.col("amount").cast("double").alias("TransactionAmt"), F.lit("W").alias("ProductCD"),
        F.col("card_id").cast("long").alias("card1"), F.col("network").alias("card4"),
        F.col("card_type").alias("card6"), F.col("email").alias("P_emaildomain"),
        F.col("device").alias("DeviceType"), "tx_type")
