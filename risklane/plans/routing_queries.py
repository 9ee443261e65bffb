"""Registered routing queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from risklane.operators import routing as R
from risklane.plans.registry import query
from risklane.sources.views import view
from risklane.staging import spread, stage

_ARMS = """
WITH arms AS (SELECT tx_type, gateway, CAST(1 + sum(success) AS BIGINT) AS alpha,
  CAST(1 + count(*) - sum(success) AS BIGINT) AS beta,
  (1 + sum(success))::DOUBLE / (2 + count(*)) AS posterior_mean, count(*) AS n_trials
  FROM outcomes GROUP BY tx_type, gateway)
"""


def arms(spark, sf_dir):
    """The learned state, written once: the log is read for it a single time."""
    return stage(R.posterior(view(spark, sf_dir, "outcomes")), "arms")


@query("posterior_state", "outcomes", _ARMS + """
SELECT tx_type, gateway, alpha, beta, round(posterior_mean, 6) AS posterior_mean, n_trials FROM arms""")
def posterior_state(spark, sf_dir):
    return arms(spark, sf_dir).withColumn("posterior_mean", F.round("posterior_mean", 6))


@query("posterior_continued", "outcomes", """
SELECT tx_type, gateway, CAST(1 + sum(success) AS BIGINT) AS alpha, CAST(1 + count(*) - sum(success) AS BIGINT) AS beta,
  count(*) AS n_trials FROM outcomes WHERE policy IN ('A', 'B') GROUP BY tx_type, gateway""")
def posterior_continued(spark, sf_dir):
    log = view(spark, sf_dir, "outcomes")
    first = R.posterior(log.filter(F.col("policy") == "A"))
    return R.posterior(log.filter(F.col("policy") == "B"), prior=first).drop("posterior_mean")


@query("posterior_interval")
def posterior_interval(spark, sf_dir):
    return R.with_interval(arms(spark, sf_dir))


@query("posterior_summary", "outcomes rates", _ARMS + """
SELECT tx_type, gateway, rate::DOUBLE AS true_rate, round(posterior_mean, 4) AS posterior_mean, n_trials,
  round(abs(posterior_mean - rate::DOUBLE), 4) AS error FROM arms JOIN rates USING (tx_type, gateway)""")
def posterior_summary(spark, sf_dir):
    return R.posterior_errors(arms(spark, sf_dir), view(spark, sf_dir, "rates"))


@query("policy_lift", "outcomes", """
WITH r AS (SELECT policy, count(*) AS n, avg(success) AS rate FROM outcomes GROUP BY policy)
SELECT policy, n, round(rate * 100, 4) AS success_pct,
  round((rate - (SELECT rate FROM r WHERE policy = 'C')) / (SELECT rate FROM r WHERE policy = 'C') * 100, 4) AS lift_pct
FROM r""")
def policy_lift(spark, sf_dir):
    return R.policy_lift(view(spark, sf_dir, "outcomes"), "C")


_REGRET = """
WITH g AS (SELECT o.policy, o.step, b.best - r.rate AS regret FROM outcomes o JOIN rates r USING (tx_type, gateway)
  JOIN (SELECT tx_type, max(rate) AS best FROM rates GROUP BY tx_type) b USING (tx_type))
SELECT policy, step, regret::DOUBLE AS regret,
  round((sum(regret) OVER (PARTITION BY policy ORDER BY step))::DOUBLE, 6) AS cum_regret FROM g"""


@query("cumulative_regret", "outcomes rates", _REGRET)
def cumulative_regret(spark, sf_dir):
    return R.cumulative_regret(view(spark, sf_dir, "outcomes"), view(spark, sf_dir, "rates"))


@query("cumulative_regret_split", "outcomes rates", _REGRET)
def cumulative_regret_split(spark, sf_dir):
    return R.cumulative_regret(view(spark, sf_dir, "outcomes"), view(spark, sf_dir, "rates"), limit=100)


_ROLLING = """
SELECT {by}, step, CAST(success AS BIGINT) AS success, CASE WHEN row_number() OVER w >= {size} THEN
  (sum(success) OVER (PARTITION BY {by} ORDER BY step ROWS {size} - 1 PRECEDING))::DOUBLE / {size} END AS rolling_rate
FROM outcomes WINDOW w AS (PARTITION BY {by} ORDER BY step)"""


@query("rolling_success", "outcomes", _ROLLING.format(by="policy", size=200))
def rolling_success(spark, sf_dir):
    return R.rolling_success(view(spark, sf_dir, "outcomes"))


@query("rolling_success_split", "outcomes", _ROLLING.format(by="policy", size=200))
def rolling_success_split(spark, sf_dir):
    return R.rolling_success(view(spark, sf_dir, "outcomes"), limit=250)


@query("outage_window", "outcomes", "SELECT * FROM (" + _ROLLING.format(by="policy, tx_type", size=50)
       + ") r WHERE tx_type = 'UPI' AND step BETWEEN 3500 AND 6500")
def outage_window(spark, sf_dir):
    return R.outage_view(view(spark, sf_dir, "outcomes"), "UPI", 4000, 6000)


_ROBIN = """
SELECT step, tx_type, CASE (row_number() OVER (ORDER BY step) - 1) % 4 WHEN 0 THEN 'Razorpay' WHEN 1 THEN 'PayU'
  WHEN 2 THEN 'Stripe' ELSE 'CCAvenue' END AS assigned FROM outcomes"""


@query("round_robin", "outcomes", _ROBIN)
def round_robin(spark, sf_dir):
    return R.round_robin(view(spark, sf_dir, "outcomes").select("step", "tx_type"), ["step"])


@query("round_robin_split", "outcomes", _ROBIN)
def round_robin_split(spark, sf_dir):
    return R.round_robin(view(spark, sf_dir, "outcomes").select("step", "tx_type"), ["step"], limit=100)


@query("second_best", "outcomes", _ARMS + """
SELECT tx_type, gateway AS second_gateway, round(posterior_mean, 6) AS second_rate FROM (SELECT *,
  row_number() OVER (PARTITION BY tx_type ORDER BY posterior_mean DESC, gateway) AS rk FROM arms) a WHERE rk = 2""")
def second_best(spark, sf_dir):
    return R.second_best(arms(spark, sf_dir)).withColumn("second_rate", F.round("second_rate", 6))


@query("best_arm_route", "outcomes", _ARMS + """
SELECT t.TransactionID, t.tx_type, a.gateway AS routed_gateway FROM txn t JOIN (SELECT *,
  row_number() OVER (PARTITION BY tx_type ORDER BY posterior_mean DESC, gateway) AS rk FROM arms) a
  ON a.tx_type = t.tx_type AND a.rk = 1""")
def best_arm_route(spark, sf_dir):
    best = R.best_by_mean(arms(spark, sf_dir)).select("tx_type", F.col("gateway").alias("routed_gateway"))
    return view(spark, sf_dir, "txn").select("TransactionID", "tx_type").join(F.broadcast(best), "tx_type")


_X = """
WITH x AS (SELECT tx_type, gateway, success, ln(1 + amt) / 10 AS x0, sin(2 * pi() * hour / 24) AS x1,
  cos(2 * pi() * hour / 24) AS x2, CASE WHEN amt > 500 THEN 1.0::DOUBLE ELSE 0 END AS x3, 1.0::DOUBLE AS x4 FROM outcomes)
SELECT tx_type, gateway, """ + ", ".join(
    [f"round(sum(x{i} * x{j}) + {1 if i == j else 0}, 5) AS a{i}{j}" for i in range(5) for j in range(i, 5)]
    + [f"round(sum(success * x{i}), 5) AS b{i}" for i in range(5)]) + " FROM x GROUP BY tx_type, gateway"


@query("linucb_stats", "outcomes", _X)
def linucb_stats(spark, sf_dir):
    stats = R.linear_statistics(view(spark, sf_dir, "outcomes"))
    return stats.select(*R.ARM, *[F.round(c, 5).alias(c) for c in stats.columns if c not in R.ARM])


@query("linucb_route")
def linucb_route(spark, sf_dir):
    log = view(spark, sf_dir, "outcomes")
    return R.linear_route(spread(log).select("step", "tx_type", "amt", "hour"), R.linear_statistics(log))


@query("thompson_route")
def thompson_route(spark, sf_dir):
    payments = spread(view(spark, sf_dir, "txn").select("TransactionID", "tx_type"))
    return R.thompson_route(payments, arms(spark, sf_dir))
