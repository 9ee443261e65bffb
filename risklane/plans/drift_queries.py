"""Registered drift queries: the first 70% of the payments against ten batches of the last 15%."""

from __future__ import annotations

from pyspark.sql import functions as F

from risklane.operators import boosting as B, calibration, drift as D, features as X, splits
from risklane.plans.feature_queries import CATEGORIES, MATRIX_NAMES, MATRIX_SQL, _doubles, payments
from risklane.plans.model_queries import fitted_models
from risklane.plans.profile_queries import SPLIT_SQL
from risklane.plans.registry import query
from risklane.sources import files
from risklane.sources.views import view
from risklane.staging import new_path, stage

FEATURES = ["TransactionAmt", "hour", "weekday", "addr1", "card1"]


def _payments(spark, sf_dir):
    return splits.train_and_batches(view(spark, sf_dir, "txn").withColumns({
        "hour": (F.col("TransactionDT") % 86400) / 3600,
        "weekday": F.floor(F.col("TransactionDT") / 86400) % 7}))


def _scored(spark, sf_dir):
    return splits.train_and_batches(view(spark, sf_dir, "scored"))


_BATCHES = """,
t AS (SELECT *, row_number() OVER (ORDER BY TransactionDT, TransactionID) - 1 AS brn, count(*) OVER () AS bn
  FROM s WHERE split = 'test'),
b AS (SELECT *, CAST(brn // (bn // 10) + 1 AS INT) AS batch FROM t WHERE brn // (bn // 10) < 10)
"""
_PAYMENTS = SPLIT_SQL.format(source="""(SELECT *, (TransactionDT % 86400)::DOUBLE / 3600 AS hour,
  TransactionDT // 86400 % 7 AS weekday FROM txn) x""").rstrip() + _BATCHES.rstrip()


def _psi_sql(rows, features):
    """PSI of ``features`` from the rows ``s`` (with their split) and ``b`` (with their batch) that ``rows`` defines."""
    long = "UNION ALL ".join('SELECT {{extra}}\'{0}\' AS feature, "{0}"::DOUBLE AS v FROM {{source}} AND "{0}" IS NOT NULL\n'.format(f)
                             for f in features)
    return rows + f""",
el AS ({long.format(extra="", source="s WHERE split = 'train'")}),
al AS ({long.format(extra="batch, ", source="b WHERE TRUE")}),
ed AS (SELECT feature, list_sort(list_distinct(quantile_cont(v, [0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1]))) AS e
  FROM el GROUP BY feature),
eb AS (SELECT feature, i, e[i] AS lo, e[i + 1] AS hi, i = len(e) - 1 AS closed FROM ed, range(1, 11) r(i) WHERE i < len(e)),
en AS (SELECT feature, count(*) AS n FROM el GROUP BY feature),
an AS (SELECT feature, batch, count(*) AS n FROM al GROUP BY feature, batch),
ec AS (SELECT eb.feature, eb.i, count(el.v) AS c FROM eb LEFT JOIN el ON el.feature = eb.feature AND el.v >= lo
  AND (el.v < hi OR (closed AND el.v = hi)) GROUP BY eb.feature, eb.i),
ac AS (SELECT eb.feature, an.batch, eb.i, count(al.v) AS c FROM eb JOIN an ON an.feature = eb.feature
  LEFT JOIN al ON al.feature = eb.feature AND al.batch = an.batch AND al.v >= lo AND (al.v < hi OR (closed AND al.v = hi))
  GROUP BY eb.feature, an.batch, eb.i),
p AS (SELECT ac.feature, ac.batch, CASE WHEN ec.c = 0 THEN 1e-4 ELSE ec.c::DOUBLE / en.n END AS e,
    CASE WHEN ac.c = 0 THEN 1e-4 ELSE ac.c::DOUBLE / an.n END AS a
  FROM ac JOIN ec USING (feature, i) JOIN en USING (feature) JOIN an ON an.feature = ac.feature AND an.batch = ac.batch),
psi AS (SELECT feature, batch, round(sum((a - e) * ln(a / e)), 4) AS psi FROM p GROUP BY feature, batch)
"""


_PSI = _psi_sql(_PAYMENTS, FEATURES)


@query("psi_matrix", "txn", _PSI + "SELECT feature, batch, round(psi, 3) AS psi FROM psi")
def psi_matrix(spark, sf_dir):
    train, batches = _payments(spark, sf_dir)
    return D.psi(train, batches, FEATURES).withColumn("psi", F.round("psi", 3))


@query("psi_wide", "txn", _PSI + "SELECT feature, " + ", ".join(
    f"round(max(psi) FILTER (WHERE batch = {i}), 3) AS Batch_{i}" for i in range(1, 11)) + " FROM psi GROUP BY feature")
def psi_wide(spark, sf_dir):
    train, batches = _payments(spark, sf_dir)
    wide = D.psi_matrix(D.psi(train, batches, FEATURES, limit=500))
    return wide.select("feature", *[F.round(c, 3).alias(c) for c in wide.columns[1:]])


_SCORED = SPLIT_SQL.format(source="scored").rstrip() + _BATCHES.rstrip()
_PRIOR = """,
pr AS (SELECT batch, avg(isFraud) AS fraud_rate FROM b GROUP BY batch),
base AS (SELECT avg(isFraud) AS rate FROM s WHERE split = 'train')
"""
_CONCEPT = """,
bc AS (SELECT batch, count(*) FILTER (WHERE score_cal >= 0.2::DOUBLE AND isFraud = 1) AS tp,
  count(*) FILTER (WHERE score_cal >= 0.2::DOUBLE AND isFraud = 0) AS fp,
  count(*) FILTER (WHERE score_cal < 0.2::DOUBLE AND isFraud = 1) AS fn, avg(isFraud) AS rate,
  sum(isFraud) AS pos, count(*) - sum(isFraud) AS neg FROM b GROUP BY batch HAVING sum(isFraud) >= 5),
br AS (SELECT batch, isFraud, rank() OVER (PARTITION BY batch ORDER BY score_cal)
  + (count(*) OVER (PARTITION BY batch, score_cal) - 1) / 2.0::DOUBLE AS rk FROM b),
ba AS (SELECT batch, sum(rk) FILTER (WHERE isFraud = 1) AS ranks FROM br GROUP BY batch),
cd AS (SELECT batch, round((ranks - pos * (pos + 1) / 2.0::DOUBLE) / (pos * neg)::DOUBLE, 4) AS auc,
  round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0)::DOUBLE, 0), 4) AS f1,
  round(coalesce(tp / nullif(tp + fp, 0)::DOUBLE, 0), 4) AS precision,
  round(coalesce(tp / nullif(tp + fn, 0)::DOUBLE, 0), 4) AS recall, round(rate, 4) AS fraud_rate
  FROM bc JOIN ba USING (batch))
"""


@query("prior_shift", "scored", _SCORED + _PRIOR + """
SELECT batch, round(fraud_rate, 6) AS fraud_rate, round(rate, 6) AS baseline_rate,
  round((fraud_rate - rate) / rate * 100, 4) AS shift_pct FROM pr, base""")
def prior_shift(spark, sf_dir):
    train, batches = _scored(spark, sf_dir)
    shift = D.prior_shift(train, batches)
    return shift.select("batch", F.round("fraud_rate", 6).alias("fraud_rate"),
                        F.round("baseline_rate", 6).alias("baseline_rate"), F.round("shift_pct", 4).alias("shift_pct"))


@query("concept_drift", "scored", _SCORED + _CONCEPT + "SELECT * FROM cd")
def concept_drift(spark, sf_dir):
    return D.concept_drift(_scored(spark, sf_dir)[1], "score_cal", 0.2)


def _rule(spark, sf_dir):
    train, batches = _payments(spark, sf_dir)
    scored_train, scored_batches = _scored(spark, sf_dir)
    return D.retrain_rule(D.psi(train, batches, FEATURES), D.concept_drift(scored_batches, "score_cal", 0.2),
                          D.prior_shift(scored_train, scored_batches), FEATURES)


# The payment view and the scored view have the same rows, so one split serves both.
_RULE = _PSI.replace("FROM txn) x", "FROM txn JOIN (SELECT TransactionID, score_cal FROM scored) sc USING (TransactionID)) x") \
    .rstrip() + _PRIOR.rstrip() + _CONCEPT.rstrip() + """,
hi AS (SELECT coalesce(list(feature ORDER BY list_position({names}, feature)) FILTER (WHERE psi > 0.2), []) AS f, max(psi) AS m
  FROM psi WHERE batch = (SELECT max(batch) FROM psi)),
au AS (SELECT count(*) AS n, min_by(auc, batch) AS a0, max_by(auc, batch) AS a1 FROM cd),
ra AS (SELECT min_by(fraud_rate, batch) AS r0, max_by(fraud_rate, batch) AS r1 FROM pr),
rule AS (SELECT f, m, CASE WHEN n >= 2 THEN a0 - a1 ELSE 0 END AS drop_, a1, CASE WHEN r0 > 0 THEN abs(r1 - r0) / r0 WHEN r1 > 0 THEN 'inf'::DOUBLE END AS shift FROM hi, au, ra),
verdict AS (SELECT *, len(f) >= 3 OR drop_ > 0.05 OR coalesce(shift > 0.30, FALSE) AS retrain,
  CASE WHEN shift IS NULL THEN 'nan' WHEN shift = 'inf'::DOUBLE THEN 'inf' ELSE printf('%.1f', shift * 100) END AS shift_text,
  CASE WHEN shift IS NULL THEN 'nan' WHEN shift = 'inf'::DOUBLE THEN 'inf' ELSE printf('%.1f', round(shift * 100, 1)) END AS shift_rounded FROM rule)
""".format(names=str(FEATURES))


_VERDICT = """
SELECT retrain AS should_retrain, array_to_string(f, ',') AS high_psi_features, CAST(len(f) AS INT) AS n_high_psi_features,
  round(drop_, 4) AS auc_degradation, round(shift * 100, 1) AS fraud_rate_shift_pct,
  CASE WHEN retrain THEN 'RETRAIN' ELSE 'MONITOR' END AS recommendation,
  CASE WHEN retrain THEN printf('PSI > 0.20 on %d features: [%s]. AUC degradation: %.4f. Fraud rate shift: %s%%.', len(f),
      CASE WHEN len(f) = 0 THEN '' ELSE '''' || array_to_string(f[1:5], ''', ''') || '''' END, drop_, shift_text)
    ELSE printf('No significant drift detected. Max PSI: %.3f. AUC stable at %.4f.', m, a1) END AS reason
FROM verdict"""


@query("retrain_rule", "txn scored", _RULE + _VERDICT)
def retrain_rule(spark, sf_dir):
    return _rule(spark, sf_dir).withColumn("high_psi_features", F.array_join("high_psi_features", ","))


@query("artifact_recommendation", "txn scored", _RULE + _VERDICT)
def artifact_recommendation(spark, sf_dir):
    """The retraining rule's verdict, written as a JSON object and read back."""
    path, rule = new_path(spark, "recommendation"), _rule(spark, sf_dir)
    files.write_object(rule, path)
    held = files.read_object(spark, path, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rule.schema.fields))
    return held.withColumn("high_psi_features", F.array_join("high_psi_features", ","))


@query("drift_report", "txn scored", _RULE + """
SELECT CASE WHEN retrain THEN 'RETRAIN' ELSE 'MONITOR' END AS status,
  CASE WHEN retrain THEN printf('Model drift detected. %d features show significant distribution shift (PSI > 0.20). '
      || 'Model AUC has degraded by %.4f. Fraud rate has shifted +%s%% from training baseline. '
      || 'Recommendation: retrain on recent data (last 90 days).', len(f), round(drop_, 4), shift_rounded)
    ELSE 'Model health nominal. No significant drift detected. AUC stable, feature distributions within acceptable bounds.'
  END AS report FROM verdict""")
def drift_report(spark, sf_dir):
    return D.drift_text(_rule(spark, sf_dir))


def _matrix(spark, sf_dir):
    """The model's features of the training rows, and of the test rows in batches; what the model was fitted on goes along."""
    parts = splits.parts(payments(spark, sf_dir))
    fitted = X.fit(parts["train"])
    keep = (*X.KEYS, "TransactionDT")
    return X.build(parts["train"], fitted, keep=keep), splits.with_batch(stage(X.build(parts["test"], fitted, keep=keep), "test")), fitted


_MATRIX = SPLIT_SQL.format(source=f"""(SELECT fm.* EXCLUDE (split), txn.TransactionDT FROM ({MATRIX_SQL}) fm
  JOIN txn ON txn.TransactionID = fm.TransactionID) x""").rstrip() + _BATCHES.rstrip()


@query("psi_features", "txn", _psi_sql(_MATRIX, MATRIX_NAMES) + """
SELECT an.feature, an.batch, round(coalesce(psi, 0), 3) AS psi FROM an LEFT JOIN psi ON psi.feature = an.feature AND psi.batch = an.batch""")
def psi_features(spark, sf_dir):
    """PSI of every feature the model reads, to three places like the values compared."""
    train, batches, fitted = _matrix(spark, sf_dir)
    return D.psi(stage(_doubles(train), "train"), _doubles(batches), fitted.names).select(
        "feature", F.col("batch").cast("int").alias("batch"), F.round("psi", 3).alias("psi"))


_SHARES = SPLIT_SQL.format(source="txn").rstrip() + _BATCHES.rstrip() + """,
el AS ({known}),
al AS ({seen}),
e AS (SELECT feature, v, count(*)::DOUBLE / any_value(n) AS e FROM (SELECT *, count(*) OVER (PARTITION BY feature) AS n FROM el) q GROUP BY feature, v),
an AS (SELECT feature, batch, count(*) AS n FROM al GROUP BY feature, batch),
a AS (SELECT al.feature, al.batch, CASE WHEN e.v IS NULL THEN '?new' ELSE al.v END AS v, count(*) AS c
  FROM al LEFT JOIN e ON e.feature = al.feature AND e.v = al.v GROUP BY 1, 2, 3),
bins AS (SELECT feature, v, e FROM e UNION ALL SELECT DISTINCT feature, '?new', 1e-4::DOUBLE FROM e),
p AS (SELECT an.feature, an.batch, bins.e, coalesce(a.c / an.n::DOUBLE, 1e-4::DOUBLE) AS a FROM an JOIN bins ON bins.feature = an.feature
  LEFT JOIN a ON a.feature = an.feature AND a.batch = an.batch AND a.v = bins.v)
SELECT feature, batch, round(round(sum((a - e) * ln(a / e)), 4), 3) AS psi FROM p GROUP BY feature, batch"""


def _texts(extra, rows):
    return " UNION ALL ".join(f"SELECT {extra}'{c}' AS feature, coalesce({c}, '__nan__') AS v FROM {rows}" for c in CATEGORIES)


@query("psi_categories", "txn", _SHARES.format(known=_texts("", "s WHERE split = 'train'"), seen=_texts("batch, ", "b")))
def psi_categories(spark, sf_dir):
    """PSI of the text columns by value, new values in a bin of their own."""
    train, batches = splits.train_and_batches(payments(spark, sf_dir))
    return D.category_psi(train, batches, CATEGORIES).withColumn("psi", F.round("psi", 3))


MONITORED = 20      # fixed value: the strongest features of the model are monitored


@query("model_drift")
def model_drift(spark, sf_dir):
    """The retraining rule on the fitted model: its strongest features, and its own calibrated scores at its own threshold."""
    train, batches, fitted = _matrix(spark, sf_dir)
    train = stage(train, "train")
    models = fitted_models(spark, sf_dir)
    strongest = [row["feature"] for row in B.top_features(B.importance(models.booster, fitted.names, train), MONITORED).collect()]
    rows = B.assemble(batches, fitted.names, ("TransactionID", "TransactionDT", "isFraud", "batch"))
    scored = stage(calibration.apply(models.calibrator, B.score(models.booster, rows).drop("features")), "scored")
    rule = D.retrain_rule(D.psi(train, batches, strongest), D.concept_drift(scored, "score_cal", models.threshold),
                          D.prior_shift(train, batches), strongest)
    return rule.withColumn("high_psi_features", F.array_join("high_psi_features", ","))
