"""Column selection, null handling and sampling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

SENTINEL = -999

# Columns treated as categories when present (fixed values).
CATEGORIES = [
    "ProductCD", "card4", "card6", "P_emaildomain", "R_emaildomain",
    "M1", "M2", "M3", "M4", "M5", "M6", "M7", "M8", "M9",
    "id_12", "id_15", "id_16", "id_23", "id_27", "id_28", "id_29", "id_30", "id_31", "id_33", "id_34",
    "id_35", "id_36", "id_37", "id_38", "DeviceType", "DeviceInfo",
]
NOT_FEATURES = ["TransactionID", "TransactionDT", "TransactionAmt", "isFraud"]


def sparse_columns(df: DataFrame, over: float = 0.80, never: Sequence[str] = ("isFraud",)) -> list[str]:
    """Columns with a null share above ``over``, from one pass; fit on train, apply to all splits."""
    shares = df.agg(*[F.avg(F.col(c).isNull().cast("double")).alias(c) for c in df.columns]).first()
    return [c for c in df.columns if c not in never and (shares[c] or 0) > over]


def present(df: DataFrame, names: Sequence[str]) -> list[str]:
    return [c for c in names if c in df.columns]


def with_prefix(df: DataFrame, prefix: str, *keys: str) -> DataFrame:
    return df.select(*keys, *[c for c in df.columns if c.startswith(prefix) and c not in keys])


def flag_addresses(df: DataFrame) -> DataFrame:
    """Null flags for addr1/addr2, then -1 for their nulls; only when the table has both."""
    pair = ["addr1", "addr2"]
    if len(present(df, pair)) < 2:
        return df
    flags = {f"{c}_nullflag": F.col(c).isNull().cast("byte") for c in pair}
    filled = {c: F.coalesce(F.col(c), F.lit(-1.0)).cast("float") for c in pair}
    return df.withColumns(flags).withColumns(filled)


def fill_numbers(df: DataFrame, value: int = SENTINEL) -> DataFrame:
    numeric = [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]
    return df.na.fill(value, numeric)


def align(df: DataFrame, columns: Sequence[str], keep: Sequence[str] = (), value: int = SENTINEL) -> DataFrame:
    """Exactly ``columns`` in that order; those the table lacks become ``value``."""
    return df.select(*keep, *[F.col(c) if c in df.columns else F.lit(value).alias(c) for c in columns])


def first_of_each_class(df: DataFrame, n: int, label: str = "isFraud", order: str = "TransactionID") -> DataFrame:
    """The first ``n`` rows of either class. Each half keeps only ``n`` rows per task before merging."""
    halves = [df.filter(F.col(label) == value).orderBy(order).limit(n) for value in (1, 0)]
    return halves[0].unionByName(halves[1])


def hash_rank(ident: str, seed: int) -> Column:
    """In [0, 1), decided by (seed, id) alone."""
    return F.pmod(F.xxhash64(F.lit(seed), F.col(ident)), F.lit(1 << 52)) / float(1 << 52)


def hash_sample(df: DataFrame, n: int, ident: str = "TransactionID", seed: int = 42) -> DataFrame:
    """``n`` random rows without replacement, the same ones whatever the partitioning.

    They are the rows of smallest hash. A bound on the hash that leaves a little more than ``n`` rows
    is found first, so each task sends only its share of those to the final ordering.
    """
    rank = hash_rank(ident, seed)
    total = df.count()
    bound = 1.0 if total <= n else min(1.0, 1.2 * n / total + 50 / total)
    while bound < 1.0 and df.filter(rank < bound).limit(n).count() < n:
        bound = min(1.0, bound * 2)
    chosen = df.filter(rank < bound) if bound < 1.0 else df
    return chosen.orderBy(rank, ident).limit(n)
