"""Registered decision, explanation and conversation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from risklane.functions import dialogue, rules, wording
from risklane.operators import conversations as C, decisions as D, routing as R
from risklane.plans.registry import query
from risklane.plans.routing_queries import _ARMS, arms
from risklane.sources.views import view

THRESHOLD = 0.41


def _signals(spark, sf_dir):
    return D.two_stage_signals(view(spark, sf_dir, "scored"), "score_raw", "iso_score", THRESHOLD)


def _decision_sql(score):
    return f"""CASE WHEN {score} >= 410 AND iso_milli >= 500 THEN 'CONFIRMED_FRAUD' WHEN iso_milli >= 500 THEN 'NOVEL_ANOMALY'
    WHEN {score} >= 410 THEN 'KNOWN_FRAUD' ELSE 'LEGITIMATE' END"""


_SIGNALS = f"WITH d AS (SELECT *, {_decision_sql('milli')} AS decision FROM scored)\n"


@query("two_stage", "scored", _SIGNALS + """SELECT TransactionID, score_raw, iso_score,
  CAST(milli >= 410 AS INT) AS score_pred, CAST(iso_milli >= 500 AS INT) AS iso_pred, decision FROM d""")
def two_stage(spark, sf_dir):
    return _signals(spark, sf_dir).select("TransactionID", "score_raw", "iso_score", "score_pred", "iso_pred", "decision")


@query("decision_counts", "scored", _SIGNALS + "SELECT decision, count(*) AS n FROM d GROUP BY decision")
def decision_counts(spark, sf_dir):
    return _signals(spark, sf_dir).groupBy("decision").agg(F.count(F.lit(1)).alias("n"))


@query("decision_matrix", "scored", _SIGNALS + """SELECT decision, count(*) FILTER (WHERE isFraud = 1) AS fraud,
  count(*) FILTER (WHERE isFraud = 0) AS legit, round(avg(isFraud) * 100, 4) AS fraud_pct FROM d GROUP BY decision""")
def decision_matrix(spark, sf_dir):
    return D.decision_matrix(_signals(spark, sf_dir))


@query("novel_capture", "scored", _SIGNALS + """SELECT count(*) FILTER (WHERE isFraud = 1) AS novel_fraud,
  count(*) AS novel_total FROM d WHERE decision = 'NOVEL_ANOMALY'""")
def novel_capture(spark, sf_dir):
    return D.novel_capture(_signals(spark, sf_dir))


def _risk_sql(score, cuts):
    low, mid, high = cuts
    return (f"CASE WHEN {score} < {low} THEN 'LOW' WHEN {score} < {mid} THEN 'MEDIUM' "
            f"WHEN {score} < {high} THEN 'HIGH' ELSE 'CRITICAL' END")


_RISK = f"""WITH d AS (SELECT *, CAST(round(score_cal * 1000) AS BIGINT) AS cal,
  CAST(round(score_cal * 1000) AS BIGINT) AS p FROM scored),
k AS (SELECT *, {_decision_sql('cal')} AS decision, {_risk_sql('p', (300, 550, 750))} AS risk FROM d),
e AS (SELECT *, CASE WHEN decision = 'CONFIRMED_FRAUD' THEN 'BLOCK' WHEN decision = 'NOVEL_ANOMALY' THEN 'REVIEW'
  WHEN risk IN ('HIGH', 'CRITICAL') THEN 'REVIEW' ELSE 'ALLOW' END AS action FROM k)
"""


@query("risk_action", "scored", _RISK + f"""
SELECT TransactionID, decision, risk, {_risk_sql('p', (300, 600, 800))} AS scoring_risk, action FROM e""")
def risk_action(spark, sf_dir):
    score = F.col("score_cal")
    df = view(spark, sf_dir, "scored").withColumns({
        "decision": rules.two_stage(score, F.col("iso_score"), THRESHOLD), "risk": rules.risk_level(score)})
    return df.select("TransactionID", "decision", "risk", rules.risk_level(score, rules.SCORING_CUTS).alias("scoring_risk"),
                     rules.action(F.col("decision"), F.col("risk")).alias("action"))


_FORCED = """CASE {t} WHEN 'CARD' THEN 'Stripe' WHEN 'UPI' THEN 'Razorpay' WHEN 'NETBANKING' THEN 'CCAvenue' WHEN 'WALLET' THEN 'Razorpay'
  ELSE 'Razorpay' END"""


@query("route_override", "scored", _RISK + f"""SELECT TransactionID, risk, CASE WHEN TransactionID % 50 = 3 THEN 'crypto' ELSE lower(tx_type) END AS tx_type,
  CASE WHEN risk IN ('HIGH', 'CRITICAL') THEN {_FORCED.format(t="(CASE WHEN TransactionID % 50 = 3 THEN '?' ELSE tx_type END)")}
  ELSE 'learned' END AS routed_gateway FROM e""")
def route_override(spark, sf_dir):
    odd = F.when(F.col("TransactionID") % 50 == 3, "crypto").otherwise(F.lower("tx_type"))
    df = view(spark, sf_dir, "scored").select("TransactionID", rules.risk_level(F.col("score_cal")).alias("risk"),
                                              odd.alias("tx_type"))
    return D.route_by_risk(df, F.lit("learned"))


@query("score_record", "scored", f"""SELECT TransactionID, round(score_raw, 4) AS probability, CAST(milli >= 410 AS INT) AS label,
  CASE WHEN milli >= 410 THEN 'FRAUD' ELSE 'LEGITIMATE' END AS label_str, {_risk_sql('milli', (300, 600, 800))} AS risk_level,
  0.41::DOUBLE AS threshold FROM scored""")
def score_record(spark, sf_dir):
    return D.score_record(view(spark, sf_dir, "scored"), "score_raw", THRESHOLD)


def _raw(spark, sf_dir):
    """Payments as they arrive: amounts as text, some unreadable, types in any case, some unknown."""
    bad = F.col("TransactionID") % 40 == 7
    odd = F.when(F.col("TransactionID") % 50 == 3, "crypto").otherwise(F.lower("tx_type"))
    return view(spark, sf_dir, "scored").withColumns({
        "amount_text": F.when(bad, F.concat(F.lit("n/a "), "TransactionID")).otherwise(F.col("TransactionAmt").cast("string")),
        "tx_type": odd}).drop("TransactionAmt")


def _records(spark, sf_dir, state):
    return D.decide(D.checked_amounts(_raw(spark, sf_dir)), "score_cal", "iso_score", THRESHOLD, state,
                    view(spark, sf_dir, "rates"))


_RECORDS = _RISK.rstrip() + "," + _ARMS.strip()[4:] + f""",
ranked AS (SELECT *, row_number() OVER (PARTITION BY tx_type ORDER BY posterior_mean DESC, gateway) AS rk FROM arms),
t AS (SELECT *, CASE WHEN TransactionID % 50 = 3 THEN 'CRYPTO' ELSE tx_type END AS given,
  CASE WHEN TransactionID % 50 = 3 THEN 'CARD' ELSE tx_type END AS kind, TransactionID % 40 = 7 AS bad FROM e),
g AS (SELECT t.*, CASE WHEN risk IN ('HIGH', 'CRITICAL') THEN {_FORCED.format(t='given')} ELSE b.gateway END AS gw
  FROM t JOIN ranked b ON b.tx_type = t.kind AND b.rk = 1),
h AS (SELECT g.*, a.posterior_mean AS pm, a.n_trials AS trials,
  CASE WHEN given = 'CRYPTO' THEN c.rate::DOUBLE ELSE a.posterior_mean END AS sr FROM g
  JOIN arms a ON a.tx_type = g.kind AND a.gateway = g.gw JOIN rates c ON c.tx_type = 'CARD' AND c.gateway = g.gw),
rec AS (SELECT TransactionID, given, CASE WHEN NOT bad THEN round(score_cal, 4) END AS fraud_probability,
  CASE WHEN NOT bad THEN round(iso_score, 4) END AS iso_anomaly_score, CASE WHEN NOT bad THEN decision END AS fraud_decision,
  CASE WHEN NOT bad THEN risk END AS fraud_risk_level, CASE WHEN NOT bad THEN action END AS recommended_action,
  CASE WHEN NOT bad THEN gw END AS routed_gateway, CASE WHEN NOT bad THEN
    CASE WHEN risk IN ('HIGH', 'CRITICAL') THEN 'Fraud-risk override (' || risk || ') → strongest-auth gateway'
    ELSE printf('Thompson Sampling → %s (posterior mean: %.3f, trials: %d)', gw, pm, trials) END END AS routing_reason,
  CASE WHEN NOT bad THEN round(sr, 4) END AS expected_success_rate,
  CASE WHEN bad THEN 'could not convert string to float: ''n/a ' || TransactionID || '''' END AS error FROM h)
"""


@query("decision_record", "scored outcomes rates", _RECORDS + """
SELECT CAST(TransactionID AS VARCHAR) AS transaction_id, given AS tx_type, fraud_probability, iso_anomaly_score, fraud_decision,
  fraud_risk_level, recommended_action, routed_gateway, routing_reason, expected_success_rate, error FROM rec""")
def decision_record(spark, sf_dir):
    return _records(spark, sf_dir, arms(spark, sf_dir))


# A log in which one gateway and one payment type were never tried: their arms have the flat prior.
_UNTRIED = _RECORDS.replace("FROM outcomes GROUP BY tx_type, gateway)", """FROM outcomes
  WHERE gateway <> 'Stripe' AND tx_type <> 'WALLET' GROUP BY tx_type, gateway),
arms AS (SELECT p.tx_type, p.gateway, coalesce(alpha, 1) AS alpha, coalesce(beta, 1) AS beta,
  coalesce(posterior_mean, 0.5) AS posterior_mean, coalesce(n_trials, 0) AS n_trials
  FROM (SELECT DISTINCT tx_type, gateway FROM rates) p LEFT JOIN tried USING (tx_type, gateway))""", 1) \
    .replace("arms AS (SELECT tx_type, gateway, CAST(1 + sum", "tried AS (SELECT tx_type, gateway, CAST(1 + sum", 1)


@query("decision_record_untried", "scored outcomes rates", _UNTRIED + """
SELECT CAST(TransactionID AS VARCHAR) AS transaction_id, given AS tx_type, fraud_probability, iso_anomaly_score, fraud_decision,
  fraud_risk_level, recommended_action, routed_gateway, routing_reason, expected_success_rate, error FROM rec""")
def decision_record_untried(spark, sf_dir):
    log = view(spark, sf_dir, "outcomes").filter("gateway <> 'Stripe' and tx_type <> 'WALLET'")
    return _records(spark, sf_dir, R.posterior(log))

@query("decision_record_thompson")
def decision_record_thompson(spark, sf_dir):
    return D.decide(D.checked_amounts(_raw(spark, sf_dir)), "score_cal", "iso_score", THRESHOLD, arms(spark, sf_dir),
                    view(spark, sf_dir, "rates"), thompson_seed=42)


# Stand-in contributions of three columns, so the texts can be formed in both engines.
def _contributions():
    return wording.drivers({
        "log_TransactionAmt": (F.col("TransactionID") % 97 - 40) / 64,
        "hour_raw": (F.col("TransactionID") % 89 - 50) / 32,
        "P_emaildomain": (F.col("TransactionID") % 83 - 30) / 128})


_PHI = """phi AS (SELECT TransactionID, f, v FROM (
  SELECT TransactionID, 'log_TransactionAmt' AS f, (TransactionID % 97 - 40)::DOUBLE / 64 AS v FROM scored
  UNION ALL SELECT TransactionID, 'hour_raw', (TransactionID % 89 - 50)::DOUBLE / 32 FROM scored
  UNION ALL SELECT TransactionID, 'P_emaildomain', (TransactionID % 83 - 30)::DOUBLE / 128 FROM scored) x),
top AS (SELECT *, row_number() OVER (PARTITION BY TransactionID ORDER BY abs(v) DESC, f) AS rk FROM phi)
"""


@query("top_drivers", "scored", "WITH " + _PHI + """
SELECT TransactionID, rk AS rank, f AS feature, v AS value,
  CASE WHEN v > 0 THEN '↑ increases fraud' ELSE '↓ decreases fraud' END AS direction FROM top WHERE rk <= 2""")
def top_drivers(spark, sf_dir):
    best = view(spark, sf_dir, "scored").select("TransactionID", wording.strongest(_contributions(), 2).alias("top"))
    return best.select("TransactionID", F.posexplode("top").alias("pos", "d")).select(
        "TransactionID", (F.col("pos") + 1).cast("long").alias("rank"), "d.*")


_EXPLAIN = _RECORDS.rstrip() + ",\n" + _PHI.rstrip() + """,
kd AS (SELECT TransactionID, ' Key drivers: ' || string_agg(f || ' (' || CASE WHEN v > 0 THEN '+' ELSE '' END
  || printf('%.3f', v) || ')', ', ' ORDER BY rk) AS k FROM top WHERE rk <= 3 GROUP BY TransactionID),
sec AS (SELECT tx_type, gateway AS g2, round(posterior_mean, 4) AS m2 FROM ranked WHERE rk = 2)
SELECT CAST(rec.TransactionID AS VARCHAR) AS transaction_id,
  CASE fraud_decision
    WHEN 'CONFIRMED_FRAUD' THEN printf('Both fraud detection systems flagged this transaction. Calibrated fraud probability: %.1f%%. Risk level: %s.%s Recommended action: %s.', fraud_probability * 100, fraud_risk_level, k, recommended_action)
    WHEN 'NOVEL_ANOMALY' THEN printf('This transaction shows unusual patterns not seen in historical fraud data. Fraud probability: %.1f%%. The anomaly detector flagged it as statistically unusual.%s Recommended action: %s — manual review advised.', fraud_probability * 100, k, recommended_action)
    WHEN 'KNOWN_FRAUD' THEN printf('This transaction matches known fraud patterns. Fraud probability: %.1f%%.%s Recommended action: %s.', fraud_probability * 100, k, recommended_action)
    ELSE printf('Transaction appears legitimate. Fraud probability: %.1f%% (below threshold).%s Recommended action: ALLOW.', fraud_probability * 100, k) END AS explanation,
  CASE WHEN fraud_risk_level IN ('HIGH', 'CRITICAL') THEN printf('Routed to %s due to elevated fraud risk (%s). This gateway provides strongest authentication for %s transactions. Expected success rate: %.1f%%.', routed_gateway, fraud_risk_level, given, expected_success_rate * 100)
    ELSE printf('Routed to %s via Thompson Sampling policy. Learned success rate for %s: %.1f%%. This gateway is currently optimal for this transaction type.', routed_gateway, given, expected_success_rate * 100) END AS routing_explanation,
  coalesce(printf('If routed to %s instead, expected success rate would be %.1f%% (%+.1f%% difference).', g2, m2 * 100, (expected_success_rate - m2) * 100), '') AS counterfactual
FROM rec JOIN kd USING (TransactionID) LEFT JOIN sec ON sec.tx_type = rec.given WHERE error IS NULL"""


@query("explanations", "scored outcomes rates", _EXPLAIN)
def explanations(spark, sf_dir):
    state = arms(spark, sf_dir)
    good = _records(spark, sf_dir, state).filter(F.col("error").isNull())
    with_id = good.withColumn("TransactionID", F.col("transaction_id").cast("long"))
    return D.explain(with_id, wording.strongest(_contributions(), 3), state)


def _match_sql(lists, otherwise):
    cases = " ".join(f"WHEN " + " OR ".join(f"contains(lower(text), '{w}')" for w in words) + f" THEN '{name}'"
                     for name, words in lists.items())
    return f"CASE {cases} ELSE {otherwise} END"


@query("intent", "claims", f"""SELECT conv_id, turn, {_match_sql(dialogue.INTENTS, "'general'")} AS intent,
  {_match_sql(dialogue.TOPICS, "NULL")} AS topic FROM claims WHERE role = 'user'""")
def intent(spark, sf_dir):
    return C.questions(view(spark, sf_dir, "claims"))


@query("claim_check", "claims txn", r"""
WITH a AS (SELECT round(avg(isFraud) * 100, 2) AS rate FROM txn),
c AS (SELECT conv_id, turn, rate,
  list_transform(regexp_extract_all(lower(text), '(\d+\.?\d*)\s*%\s*(?:fraud)', 1), lambda x: CAST(x AS DOUBLE)) AS v FROM claims, a),
w AS (SELECT *, list_filter(v, lambda x: abs(x - rate) > 1.5) AS wrong FROM c)
SELECT conv_id, turn, CAST(len(v) AS INT) AS n_claims, len(wrong) = 0 AS verified, array_to_string(list_transform(wrong,
  lambda x: 'Fraud rate is ' || CAST(rate AS VARCHAR) || '%, not ' || CAST(x AS VARCHAR) || '%.'), ' ') AS corrections FROM w""")
def claim_check(spark, sf_dir):
    checked = C.check_claims(view(spark, sf_dir, "claims"), view(spark, sf_dir, "txn"))
    return checked.withColumn("corrections", F.array_join("corrections", " "))


@query("last_turns", "", """SELECT conv_id, turn, role, text FROM (SELECT *,
  row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rk FROM conversations) c WHERE rk <= 4""")
def last_turns(spark, sf_dir):
    return C.latest(view(spark, sf_dir, "conversations"), ["conv_id"], "turn", 4)


@query("last_decisions", "scored", _SIGNALS + """SELECT tx_type, TransactionID, decision FROM (SELECT *,
  row_number() OVER (PARTITION BY tx_type ORDER BY TransactionID DESC) AS rk FROM d) x WHERE rk <= 8""")
def last_decisions(spark, sf_dir):
    return C.latest(_signals(spark, sf_dir).select("tx_type", "TransactionID", "decision"), ["tx_type"], "TransactionID")
