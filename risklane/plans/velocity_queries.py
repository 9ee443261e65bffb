"""Registered velocity queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from risklane.operators import velocity as V
from risklane.plans.registry import query
from risklane.sources.views import view

# Rows per card above which the test runs take the split path, far below the tables' card sizes.
FORCED_SPLIT = 10

# Brute force: every payment against all earlier payments of its card.
_PRIOR = """
WITH pairs AS (
  SELECT a.TransactionID, a.card1, a.TransactionDT, a.cents, a.isFraud,
    b.cents AS bc, a.TransactionDT - b.TransactionDT AS age, b.TransactionID AS b_id
  FROM {source} a LEFT JOIN {source} b ON a.card1 = b.card1 AND
    (b.TransactionDT < a.TransactionDT OR (b.TransactionDT = a.TransactionDT AND b.TransactionID < a.TransactionID))
), prior AS (
  SELECT TransactionID, card1, TransactionDT, cents, isFraud,
    count(b_id) AS n, coalesce(sum(bc), 0) AS s, coalesce(sum(bc::HUGEINT * bc), 0) AS q,
    count(b_id) FILTER (WHERE age <= 3600) AS n1, count(b_id) FILTER (WHERE age <= 86400) AS n24,
    count(b_id) FILTER (WHERE age <= 604800) AS n7,
    coalesce(sum(bc) FILTER (WHERE age <= 3600), 0) AS s1,
    coalesce(sum(bc) FILTER (WHERE age <= 86400), 0) AS s24
  FROM pairs GROUP BY ALL
), vel AS (
  SELECT TransactionID, card1, TransactionDT, isFraud, n1 AS vel_tx_1h, n24 AS vel_tx_24h, n7 AS vel_tx_7d,
    n AS vel_tx_prior, s1 / 100.0::DOUBLE AS vel_amt_1h, s24 / 100.0::DOUBLE AS vel_amt_24h,
    CASE WHEN n >= 2 THEN (cents / 100.0::DOUBLE - s::DOUBLE / n / 100)
      / (sqrt((n * q - s * s)::DOUBLE / (n * n)::DOUBLE) / 100 + 1e-6) ELSE 0 END AS vel_amt_zscore
  FROM prior
)"""

_EXACT = """
SELECT TransactionID, card1, TransactionDT, vel_tx_1h, vel_tx_24h, vel_tx_7d, vel_tx_prior,
  vel_amt_1h, vel_amt_24h, round(vel_amt_zscore, 4) AS vel_amt_zscore FROM vel"""


def _rounded(df):
    from pyspark.sql import functions as F
    return df.withColumn("vel_amt_zscore", F.round("vel_amt_zscore", 4))


@query("velocity_exact", "txn", _PRIOR.format(source="txn") + _EXACT)
def velocity_exact(spark, sf_dir):
    return _rounded(V.exact_velocity(view(spark, sf_dir, "txn")))


@query("velocity_exact_split", "txn", _PRIOR.format(source="txn") + _EXACT)
def velocity_exact_split(spark, sf_dir):
    return _rounded(V.exact_velocity(view(spark, sf_dir, "txn"), limit=FORCED_SPLIT))


_TIES = _PRIOR.format(source="txn_orders") + _EXACT


@query("velocity_ties", "txn_orders", _TIES)
def velocity_ties(spark, sf_dir):
    return _rounded(V.exact_velocity(view(spark, sf_dir, "txn_orders")))


@query("velocity_ties_split", "txn_orders", _TIES)
def velocity_ties_split(spark, sf_dir):
    return _rounded(V.exact_velocity(view(spark, sf_dir, "txn_orders"), limit=FORCED_SPLIT))


_BUCKETED = """
WITH pairs AS (
  SELECT a.TransactionID, a.card1, a.TransactionDT, a.cents, b.cents AS bc, b.TransactionID AS b_id,
    a.TransactionDT // 3600 = b.TransactionDT // 3600 AS same_hour,
    a.TransactionDT // 86400 = b.TransactionDT // 86400 AS same_day
  FROM txn a LEFT JOIN txn b ON a.card1 = b.card1 AND
    (b.TransactionDT < a.TransactionDT OR (b.TransactionDT = a.TransactionDT AND b.TransactionID < a.TransactionID))
), prior AS (
  SELECT TransactionID, card1, TransactionDT, cents, count(b_id) AS n, coalesce(sum(bc), 0) AS s,
    coalesce(sum(bc::HUGEINT * bc), 0) AS q,
    count(b_id) FILTER (WHERE same_hour) AS n1, count(b_id) FILTER (WHERE same_day) AS n24,
    coalesce(sum(bc) FILTER (WHERE same_hour), 0) AS s1, coalesce(sum(bc) FILTER (WHERE same_day), 0) AS s24
  FROM pairs GROUP BY ALL
)
SELECT TransactionID, card1, TransactionDT, n1 AS vel_tx_1h, n24 AS vel_tx_24h, n AS vel_tx_prior,
  s1 / 100.0::DOUBLE AS vel_amt_1h, s24 / 100.0::DOUBLE AS vel_amt_24h,
  round(CASE WHEN n >= 2 THEN (cents / 100.0::DOUBLE - s::DOUBLE / n / 100)
    / (sqrt((n * q - s * s)::DOUBLE / (n * (n - 1))::DOUBLE) / 100 + 1e-6) ELSE 0 END, 4) AS vel_amt_zscore
FROM prior"""


@query("velocity_bucketed", "txn", _BUCKETED)
def velocity_bucketed(spark, sf_dir):
    return _rounded(V.bucketed_velocity(view(spark, sf_dir, "txn")))


@query("velocity_bucketed_split", "txn", _BUCKETED)
def velocity_bucketed_split(spark, sf_dir):
    return _rounded(V.bucketed_velocity(view(spark, sf_dir, "txn"), limit=FORCED_SPLIT))


def flagship(spark, sf_dir):
    return V.fraud_by_band(V.exact_velocity(view(spark, sf_dir, "txn"), keep=["isFraud"]))


query("velocity_bands", "txn", _PRIOR.format(source="txn") + """
SELECT band, band_order, count(*) AS n, CAST(sum(isFraud) AS BIGINT) AS frauds,
  round(avg(isFraud) * 100, 4) AS fraud_pct
FROM (SELECT *, CASE WHEN vel_tx_24h = 1 THEN '1' WHEN vel_tx_24h IN (2, 3) THEN '2-3'
        WHEN vel_tx_24h IN (4, 5) THEN '4-5' WHEN vel_tx_24h BETWEEN 6 AND 10 THEN '6-10'
        WHEN vel_tx_24h BETWEEN 11 AND 999 THEN '11-999' END AS band,
      CASE WHEN vel_tx_24h = 1 THEN 0 WHEN vel_tx_24h IN (2, 3) THEN 1
        WHEN vel_tx_24h IN (4, 5) THEN 2 WHEN vel_tx_24h BETWEEN 6 AND 10 THEN 3
        WHEN vel_tx_24h BETWEEN 11 AND 999 THEN 4 END AS band_order FROM vel) v
WHERE band IS NOT NULL GROUP BY band, band_order""")(flagship)


@query("velocity_alarms", "txn", _PRIOR.format(source="txn") + """
SELECT count(*) FILTER (WHERE vel_tx_24h > 5) AS high_velocity,
  count(*) FILTER (WHERE vel_amt_zscore > 3) AS amount_spikes FROM vel""")
def velocity_alarms(spark, sf_dir):
    return V.alarms(V.exact_velocity(view(spark, sf_dir, "txn")))


@query("velocity_joined", "txn", _PRIOR.format(source="txn") + """
SELECT t.TransactionID, t.ProductCD, t.tx_type, t.isFraud, v.vel_tx_1h, v.vel_tx_24h, v.vel_amt_24h
FROM txn t LEFT JOIN vel v USING (TransactionID)""")
def velocity_joined(spark, sf_dir):
    txn = view(spark, sf_dir, "txn")
    vel = V.exact_velocity(txn).select("TransactionID", "vel_tx_1h", "vel_tx_24h", "vel_amt_24h")
    return txn.select("TransactionID", "ProductCD", "tx_type", "isFraud").join(vel, "TransactionID", "left")


_EMAILS = """
WITH d AS (SELECT *, {bucket} AS {name} FROM (SELECT *, TransactionDT // 86400 AS day FROM txn) t),
e AS (SELECT card1, {name}, count(DISTINCT P_emaildomain) AS vel_unique_emails FROM d GROUP BY ALL)
SELECT d.TransactionID, d.card1, d.TransactionDT, d.P_emaildomain, d.day{extra}, e.vel_unique_emails
FROM d JOIN e ON d.card1 = e.card1 AND d.{name} = e.{name}"""
_DAY = _EMAILS.format(bucket="day", name="the_day", extra="")
_BIN = _EMAILS.format(bucket="""greatest(1, CAST(ceil((day - min(day) OVER ()) * 50
  / (max(day) OVER () - min(day) OVER ())) AS BIGINT))""", name="bin", extra=", d.bin")


@query("emails_per_card_day", "txn", _DAY)
def emails_per_card_day(spark, sf_dir):
    return V.emails_per_card_day(view(spark, sf_dir, "txn"))


@query("emails_per_card_day_split", "txn", _DAY)
def emails_per_card_day_split(spark, sf_dir):
    return V.emails_per_card_day(view(spark, sf_dir, "txn"), limit=2)


@query("emails_per_card_bin", "txn", _BIN)
def emails_per_card_bin(spark, sf_dir):
    return V.emails_per_card_bin(view(spark, sf_dir, "txn"))


_PRIOR_EMAILS = """
SELECT a.TransactionID, a.card1, a.TransactionDT, count(DISTINCT b.P_emaildomain) AS vel_emails_prior_24h
FROM {source} a LEFT JOIN {source} b ON a.card1 = b.card1 AND a.TransactionDT - b.TransactionDT <= 86400 AND
  (b.TransactionDT < a.TransactionDT OR (b.TransactionDT = a.TransactionDT AND b.TransactionID < a.TransactionID))
GROUP BY a.TransactionID, a.card1, a.TransactionDT"""
# Orders with a domain by their customer: days of one card hold many payments of the same second.
_TIED = """(SELECT *, CASE cents % 5 WHEN 0 THEN 'a.com' WHEN 1 THEN 'b.com' WHEN 2 THEN 'c.com' WHEN 3 THEN 'd.com' END AS P_emaildomain FROM txn_orders)"""


def _tied(spark, sf_dir):
    domain = F.element_at(F.array(*[F.lit(x) for x in ("a.com", "b.com", "c.com", "d.com")], F.lit(None)), (F.col("cents") % 5 + 1).cast("int"))
    return view(spark, sf_dir, "txn_orders").withColumn("P_emaildomain", domain)


@query("emails_prior_24h", "txn", _PRIOR_EMAILS.format(source="txn"))
def emails_prior_24h(spark, sf_dir):
    return V.emails_prior_24h(view(spark, sf_dir, "txn"))


@query("emails_prior_24h_ties", "txn_orders", _PRIOR_EMAILS.format(source=_TIED))
def emails_prior_24h_ties(spark, sf_dir):
    return V.emails_prior_24h(_tied(spark, sf_dir))


@query("emails_prior_24h_split", "txn_orders", _PRIOR_EMAILS.format(source=_TIED))
def emails_prior_24h_split(spark, sf_dir):
    return V.emails_prior_24h(_tied(spark, sf_dir), limit=FORCED_SPLIT)
