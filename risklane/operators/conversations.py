"""Jobs over conversation turns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window as W, functions as F

from risklane.functions import dialogue


def questions(turns: DataFrame) -> DataFrame:
    """Intent and chart topic of every user turn."""
    return turns.filter(F.col("role") == "user").select(
        "conv_id", "turn", dialogue.intent(F.col("text")).alias("intent"), dialogue.topic(F.col("text")).alias("topic"))


def check_claims(turns: DataFrame, payments: DataFrame, label: str = "isFraud") -> DataFrame:
    """Compare fraud rates stated in the turns with the true rate of the payments."""
    rate = payments.agg(F.round(F.avg(label) * 100, 2).alias("rate")).first()["rate"]
    checked = turns.withColumns({"claims": dialogue.claims(F.col("text")),
                                 "corrections": dialogue.corrections(F.col("text"), F.lit(rate))})
    return checked.select("conv_id", "turn", F.size("claims").alias("n_claims"),
                          (F.size("corrections") == 0).alias("verified"), "corrections")


def latest(df: DataFrame, keys: Sequence[str], order: str, n: int = 8) -> DataFrame:
    """The last ``n`` rows of each key.

    The rank filter lets Spark keep at most ``n`` rows per key and task before the shuffle.
    """
    newest_first = W.partitionBy(*keys).orderBy(F.desc(order))
    return df.withColumn("_rank", F.row_number().over(newest_first)).filter(F.col("_rank") <= n).drop("_rank")
