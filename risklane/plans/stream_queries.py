"""Registered streaming queries: the events replayed as a stream, checked against the batch definitions."""

from __future__ import annotations

from pyspark.sql import functions as F

from risklane.operators import decisions as D, routing as R
from risklane.plans import saved, scoring
from risklane.plans.decision_queries import _FORCED, _RISK
from risklane.plans.model_queries import fitted_chain, with_amount_text
from risklane.plans.registry import query
from risklane.plans.routing_queries import _ARMS, arms
from risklane.plans.velocity_queries import _EXACT, _PRIOR, FORCED_SPLIT, _rounded
from risklane.sources.views import DIALECT, view
from risklane.staging import new_path, spread
from risklane.streaming import jobs, sources, velocity


SLICES = 3


def _payments(spark, sf_dir):
    return sources.payments(sources.event_stream(spark, sf_dir, "events.parquet"))


def _replayed(spark, sf_dir, run, held=None):
    """``run(payments, checkpoint)`` over the events in slices of time: each slice arrives after the query has stopped,
    and the restarted query goes on from its checkpoint. Every ``held``-th event of the first slice arrives with the last."""
    events = view(spark, sf_dir, "events")
    seconds = F.expr(DIALECT["spark"]["event_seconds"])
    first, last = events.agg(F.min(seconds), F.max(seconds)).first()
    folder, checkpoint = new_path(spark, "slices"), new_path(spark, "offsets")
    width = ((last or 0) - (first or 0)) // SLICES + 1
    slot = F.floor((seconds - (first or 0)) / width)
    if held:
        slot = F.when((slot == 0) & (F.col("event_id") % held == 0), SLICES - 1).otherwise(slot)
    for i in range(SLICES):
        part = events.filter(slot == i)
        part.write.mode("append").parquet(folder)
        run(sources.payments(sources.event_stream(spark, folder)), checkpoint)


_POSTERIOR = """
SELECT tx_type, gateway, CAST(2 * sum(success) + 1 AS BIGINT) AS alpha, CAST(2 * (count(*) - sum(success)) + 1 AS BIGINT) AS beta,
  2 * count(*) AS n_trials FROM outcomes GROUP BY tx_type, gateway"""


@query("stream_posterior", "outcomes", _POSTERIOR)
def stream_posterior(spark, sf_dir):
    """Starts from a saved state (the same log, seen in batch) and adds the streamed outcomes."""
    path = new_path(spark, "posterior")
    state = jobs.running_posterior(sources.from_payments("outcomes", _payments(spark, sf_dir)), prior=arms(spark, sf_dir))
    jobs.start(state, jobs.into(path), "update").awaitTermination()
    return jobs.newest(spark, path, R.ARM)


@query("stream_posterior_slices", "outcomes", _POSTERIOR)
def stream_posterior_slices(spark, sf_dir):
    path, prior = new_path(spark, "posterior"), arms(spark, sf_dir)

    def run(payments, checkpoint):
        state = jobs.running_posterior(sources.from_payments("outcomes", payments), prior=prior)
        jobs.start(state, jobs.into(path), "update", checkpoint).awaitTermination()

    _replayed(spark, sf_dir, run)
    return jobs.newest(spark, path, R.ARM)


_DAILY = """
SELECT CAST(date_trunc('day', ts) AS VARCHAR) AS day_start, count(*) AS n,
  round(avg(CASE WHEN event_type = 'error' AND CAST(json_extract_string(props, '$.k') AS INT) % 6 = 0 THEN 1 ELSE 0 END), 6) AS fraud_rate,
  round(avg(CASE WHEN event_type <> 'error' THEN 1 ELSE 0 END), 6) AS success_rate FROM events GROUP BY 1"""


@query("stream_daily", "", _DAILY)
def stream_daily(spark, sf_dir):
    path = new_path(spark, "daily")
    jobs.start(jobs.daily_monitor(_payments(spark, sf_dir)), jobs.into(path), "update").awaitTermination()
    return _days(spark, path)


def _days(spark, path):
    return jobs.newest(spark, path, ["day_start"]).select(
        F.date_format("day_start", "yyyy-MM-dd HH:mm:ss").alias("day_start"), "n",
        F.round("fraud_rate", 6).alias("fraud_rate"), F.round("success_rate", 6).alias("success_rate"))


@query("stream_daily_slices", "", _DAILY)
def stream_daily_slices(spark, sf_dir):
    path = new_path(spark, "daily")
    _replayed(spark, sf_dir, lambda payments, checkpoint: jobs.start(
        jobs.daily_monitor(payments), jobs.into(path), "update", checkpoint).awaitTermination())
    return _days(spark, path)


@query("stream_velocity", "txn", _PRIOR.format(source="txn") + _EXACT)
def stream_velocity(spark, sf_dir):
    stream = velocity.VelocityStream(_payments(spark, sf_dir), new_path(spark, "velocity"))
    stream.run()
    return _rounded(stream.output())


@query("stream_velocity_slices", "txn", _PRIOR.format(source="txn") + _EXACT)
def stream_velocity_slices(spark, sf_dir):
    """Cards become hot between the slices (the limit is far below the tables' card sizes)."""
    root = new_path(spark, "velocity")
    _replayed(spark, sf_dir, lambda payments, _: velocity.VelocityStream(payments, root, limit=FORCED_SPLIT).run())
    return _rounded(spark.read.parquet(f"{root}/out").drop("batch"))


# Some payments of the first slice arrive with the last one: later than the watermark, so they are dropped.
_HELD = 97
_IN_TIME = f"""WITH bounds AS (SELECT min(TransactionDT) AS low, (max(TransactionDT) - min(TransactionDT)) // {SLICES} + 1 AS width FROM txn),
timely AS (SELECT txn.* FROM txn, bounds WHERE NOT (TransactionID % {_HELD} = 0 AND TransactionDT < low + width)),
"""


def _timely(sql):
    return _IN_TIME + sql.strip().removeprefix("WITH ")


@query("stream_velocity_late", "txn", _timely(_PRIOR.format(source="timely")) + _EXACT)
def stream_velocity_late(spark, sf_dir):
    root = new_path(spark, "velocity")
    _replayed(spark, sf_dir, lambda payments, _: velocity.VelocityStream(payments, root).run(), held=_HELD)
    return _rounded(spark.read.parquet(f"{root}/out").drop("batch"))


@query("stream_daily_late", "txn", _timely(f"""WITH late AS (SELECT count(*) AS dropped FROM txn, bounds
  WHERE TransactionID % {_HELD} = 0 AND TransactionDT < low + width)
SELECT CAST(make_timestamp((1704067200 + TransactionDT // 86400 * 86400) * 1000000) AS VARCHAR) AS day_start, count(*) AS n,
  round(avg(isFraud), 6) AS fraud_rate, round(avg(CASE WHEN event_type <> 'error' THEN 1 ELSE 0 END), 6) AS success_rate,
  CAST(any_value(dropped) AS BIGINT) AS dropped FROM timely, late GROUP BY 1"""))
def stream_daily_late(spark, sf_dir):
    """Days without the late payments, and how many arrived that no day counts."""
    path, arrived = new_path(spark, "daily"), []

    def run(payments, checkpoint):
        state = jobs.start(jobs.daily_monitor(payments), jobs.into(path), "update", checkpoint)
        state.awaitTermination()
        arrived.append(jobs.arrived_rows(state))

    _replayed(spark, sf_dir, run, held=_HELD)
    days = _days(spark, path)
    counted = days.agg(F.sum("n")).first()[0] or 0
    return days.withColumn("dropped", F.lit(sum(arrived) - counted).cast("bigint"))


@query("stream_score", "scored outcomes", _RISK.rstrip() + "," + _ARMS.strip()[4:] + f""",
best AS (SELECT tx_type, gateway FROM arms QUALIFY row_number() OVER (PARTITION BY tx_type ORDER BY posterior_mean DESC, gateway) = 1)
SELECT CAST(TransactionID AS VARCHAR) AS transaction_id, decision AS fraud_decision, risk AS fraud_risk_level,
  action AS recommended_action, CASE WHEN risk IN ('HIGH', 'CRITICAL') THEN {_FORCED.format(t="e.tx_type")}
  ELSE best.gateway END AS routed_gateway FROM e JOIN best ON best.tx_type = e.tx_type""")
def stream_score(spark, sf_dir):
    path = new_path(spark, "decisions")
    learned, rates = arms(spark, sf_dir), view(spark, sf_dir, "rates")

    def decide(batch, number):
        records = D.decide(sources.from_payments("scored", batch), "score_cal", "iso_score", 0.41, learned, rates)
        jobs.into(path)(records, number)

    jobs.start(_payments(spark, sf_dir), decide, "append").awaitTermination()
    return spark.read.parquet(path).select("transaction_id", "fraud_decision", "fraud_risk_level",
                                           "recommended_action", "routed_gateway")


@query("stream_score_models")
def stream_score_models(spark, sf_dir):
    """Raw payments from the stream through the fitted models, batch by batch; the models come from where training saved them."""
    path, kept = new_path(spark, "scored"), new_path(spark, "chain")
    saved.save(fitted_chain(spark, sf_dir), kept, spark)
    chain, learned, rates = saved.load(spark, kept), arms(spark, sf_dir), view(spark, sf_dir, "rates")

    def score(batch, number):
        jobs.into(path)(scoring.score_payments(with_amount_text(spread(batch)), chain, learned, rates), number)

    jobs.start(_payments(spark, sf_dir), score, "append").awaitTermination()
    return spark.read.parquet(path).drop("batch")
