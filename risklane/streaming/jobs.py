"""Streaming jobs. Each writes one folder per micro-batch, so a retried batch replaces its own output.

Aggregates run as Structured Streaming state; scoring runs the batch operators on every micro-batch. Velocity has keyed
state of its own (``velocity``).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from risklane.operators.ordered import if_small
from risklane.staging import new_path

Sink = Callable[[DataFrame, int], None]


def start(stream: DataFrame, sink: Sink, mode: str, checkpoint: str | None = None) -> StreamingQuery:
    """Process what is there now, batch by batch, and stop."""
    return (stream.writeStream.outputMode(mode).foreachBatch(sink)
            .option("checkpointLocation", checkpoint or new_path(stream.sparkSession, "offsets"))
            .trigger(availableNow=True).start())


def into(path: str) -> Sink:
    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")
    return write


def arrived_rows(query: StreamingQuery) -> int:
    """Rows that the batches of a stopped query read."""
    return sum(progress["numInputRows"] for progress in query.recentProgress)


def newest(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """The last version of each key that an update-mode query wrote."""
    rows = spark.read.parquet(path)
    values = [c for c in rows.columns if c not in (*keys, "batch")]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch").alias("_last")).select(*keys, "_last.*")


def running_posterior(outcomes: DataFrame, prior: DataFrame | None = None) -> DataFrame:
    """The Beta posterior of every arm after each micro-batch, on top of a saved state."""
    wins = F.sum(F.col("success").cast("long"))
    seen = outcomes.groupBy("tx_type", "gateway").agg(wins.alias("_wins"), F.count(F.lit(1)).alias("_n"))
    alpha, beta = F.col("_wins") + 1, F.col("_n") - F.col("_wins") + 1
    if prior is not None:
        seen = seen.join(if_small(prior.select("tx_type", "gateway", "alpha", "beta")), ["tx_type", "gateway"], "left")
        alpha, beta = alpha + F.coalesce(F.col("alpha") - 1, F.lit(0)), beta + F.coalesce(F.col("beta") - 1, F.lit(0))
    return seen.select("tx_type", "gateway", alpha.cast("long").alias("alpha"), beta.cast("long").alias("beta"),
                       (alpha + beta - 2).cast("long").alias("n_trials"))


def daily_monitor(payments: DataFrame, late: str = "1 hour") -> DataFrame:
    """Payments, fraud rate and success rate per day of event time; rows later than ``late`` are dropped."""
    ok = (F.col("event_type") != "error").cast("int")
    return payments.withWatermark("ts", late).groupBy(F.window("ts", "1 day")).agg(
        F.count(F.lit(1)).alias("n"), F.avg("isFraud").alias("fraud_rate"), F.avg(ok).alias("success_rate")) \
        .select(F.col("window.start").alias("day_start"), "n", "fraud_rate", "success_rate")
