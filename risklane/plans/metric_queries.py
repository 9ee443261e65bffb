"""Registered evaluation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from risklane.operators import metrics as M
from risklane.plans.registry import query
from risklane.sources import files
from risklane.sources.views import view
from risklane.staging import new_path

THRESHOLD = 0.41


def _scored(spark, sf_dir):
    return view(spark, sf_dir, "scored")


def _round(df, digits=6, *names):
    return df.withColumns({n: F.round(n, digits) for n in names})


_COUNTS = """
WITH c AS (SELECT count(*) FILTER (WHERE f AND isFraud = 1) AS tp, count(*) FILTER (WHERE f AND isFraud = 0) AS fp,
  count(*) FILTER (WHERE NOT f AND isFraud = 1) AS fn, count(*) FILTER (WHERE NOT f AND isFraud = 0) AS tn
  FROM (SELECT isFraud, {flag} AS f FROM scored) s)
"""
_CAL = "score_cal >= 0.41::DOUBLE"


@query("cost_model", "scored", _COUNTS.format(flag=_CAL) + """
SELECT tp, fp, fn, tn, fp * 1200 AS cost_false_positives, fn * 2400 AS cost_false_negatives, (tp + fp) * 200 AS cost_review,
  (tp + fn) * 2400 AS baseline_cost, tp * 2400 AS value_prevented, tp * 2400 - fp * 1200 - (tp + fp) * 200 AS net_benefit,
  round((tp * 2400 - fp * 1200 - (tp + fp) * 200) * 100 / greatest((tp + fn) * 2400, 1), 1) AS roi_pct FROM c""")
def cost_model(spark, sf_dir):
    return M.cost_model(M.confusion(_scored(spark, sf_dir), F.col("score_cal") >= THRESHOLD))


_IMPACT = """
SELECT tp, fp, fn, tn, fp * 1200 AS cost_false_positives, fn * 2400 AS cost_false_negatives, (tp + fp) * 200 AS cost_review,
  (tp + fn) * 2400 AS baseline_cost, tp * 2400 AS value_prevented, tp * 2400 - fp * 1200 - (tp + fp) * 200 AS net_benefit,
  round((tp * 2400 - fp * 1200 - (tp + fp) * 200) * 100 / greatest((tp + fn) * 2400, 1), 1) AS roi_pct,
  (SELECT round(avg((score_raw - isFraud) ** 2), 4) FROM scored) AS brier_raw,
  (SELECT round(avg((score_cal - isFraud) ** 2), 4) FROM scored) AS brier_cal FROM c"""


@query("artifact_impact", "scored", _COUNTS.format(flag=_CAL) + _IMPACT)
def artifact_impact(spark, sf_dir):
    """Costs and Brier scores of a threshold, written as a JSON object and read back."""
    path, scored = new_path(spark, "impact"), _scored(spark, sf_dir)
    costs = M.cost_model(M.confusion(scored, F.col("score_cal") >= THRESHOLD))
    brier = scored.agg(*[F.round(F.avg((F.col(f"score_{kind}") - F.col("isFraud")) ** 2), 4).alias(f"brier_{kind}")
                         for kind in ("raw", "cal")])
    # Two tables of one row each.
    row = costs.withColumn("_row", F.lit(1)).join(brier.withColumn("_row", F.lit(1)), "_row").drop("_row")
    files.write_object(row, path)
    return files.read_object(spark, path, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in row.schema.fields))


_SWEEP = """
WITH w AS (SELECT i / 100.0::DOUBLE AS threshold, count(*) FILTER (WHERE {score} >= i / 100.0::DOUBLE AND isFraud = 1) AS tp,
  count(*) FILTER (WHERE {score} >= i / 100.0::DOUBLE AND isFraud = 0) AS fp,
  count(*) FILTER (WHERE {score} < i / 100.0::DOUBLE AND isFraud = 1) AS fn,
  count(*) FILTER (WHERE {score} < i / 100.0::DOUBLE AND isFraud = 0) AS tn
  FROM scored, range({low}, {high}) r(i) GROUP BY i),
v AS (SELECT *, tp * 2400 - fp * 1200 - (tp + fp) * 200 AS net_benefit,
  coalesce(2 * tp / nullif(2 * tp + fp + fn, 0)::DOUBLE, 0) AS f1 FROM w)
"""
_COST_SWEEP = _SWEEP.format(score="score_cal", low=5, high=96)
_F1_SWEEP = _SWEEP.format(score="score_raw", low=10, high=91)


@query("cost_curve", "scored", _COST_SWEEP + "SELECT threshold, net_benefit, round(f1, 6) AS f1 FROM v")
def cost_curve(spark, sf_dir):
    return _round(M.cost_curve(_scored(spark, sf_dir), "score_cal"), 6, "f1")


@query("cost_curve_best", "scored", _COST_SWEEP + """
SELECT threshold, net_benefit FROM v ORDER BY net_benefit DESC, threshold LIMIT 1""")
def cost_curve_best(spark, sf_dir):
    return M.best_threshold(M.cost_curve(_scored(spark, sf_dir), "score_cal"), "net_benefit")


@query("f1_sweep", "scored", _F1_SWEEP + "SELECT threshold, tp, fp, fn, tn, round(f1, 6) AS f1 FROM v")
def f1_sweep(spark, sf_dir):
    swept = M.f1_sweep(_scored(spark, sf_dir), "score_raw")
    return _round(swept.withColumns({c: F.col(c).cast("long") for c in ("tp", "fp", "fn", "tn")}), 6, "f1")


@query("f1_best", "scored", _F1_SWEEP + "SELECT threshold, round(f1, 6) AS f1 FROM v ORDER BY v.f1 DESC, threshold LIMIT 1")
def f1_best(spark, sf_dir):
    return _round(M.best_threshold(M.f1_sweep(_scored(spark, sf_dir), "score_raw"), "f1"), 6, "f1")


_CURVE = """
WITH g AS (SELECT score_cal AS s, sum(isFraud) AS pos, count(*) - sum(isFraud) AS neg FROM scored GROUP BY score_cal),
k AS (SELECT s, pos, neg, sum(pos) OVER (ORDER BY s DESC) AS tp, sum(neg) OVER (ORDER BY s DESC) AS fp,
  sum(pos) OVER () AS p, sum(neg) OVER () AS n FROM g)
"""
# Independent of the curve: midranks of the frauds.
_AUC = """
WITH r AS (SELECT isFraud, rank() OVER (ORDER BY score_cal) + (count(*) OVER (PARTITION BY score_cal) - 1) / 2.0::DOUBLE AS rk
  FROM scored)
SELECT round((sum(rk) FILTER (WHERE isFraud = 1) - sum(isFraud) * (sum(isFraud) + 1) / 2.0::DOUBLE)
  / (sum(isFraud) * (count(*) - sum(isFraud)))::DOUBLE, 6) AS auc FROM r"""


@query("roc_auc", "scored", _AUC)
def roc_auc(spark, sf_dir):
    return _round(M.auc(_scored(spark, sf_dir), "score_cal"), 6, "auc")


@query("roc_auc_split", "scored", _AUC)
def roc_auc_split(spark, sf_dir):
    return _round(M.auc(_scored(spark, sf_dir), "score_cal", limit=50), 6, "auc")


@query("avg_precision", "scored", _CURVE
       + "SELECT round(sum(pos::DOUBLE / p * tp / (tp + fp)), 6) AS avg_precision FROM k")
def avg_precision(spark, sf_dir):
    return _round(M.average_precision(_scored(spark, sf_dir), "score_cal"), 6, "avg_precision")


@query("pr_curve", "scored", _CURVE + """
SELECT s AS threshold, round(tp::DOUBLE / (tp + fp), 6) AS precision, round(tp::DOUBLE / p, 6) AS recall,
  round(2 * (tp::DOUBLE / (tp + fp)) * (tp::DOUBLE / p) / (tp::DOUBLE / (tp + fp) + tp::DOUBLE / p + 1e-9), 6) AS f1 FROM k""")
def pr_curve(spark, sf_dir):
    return _round(M.precision_recall_curve(_scored(spark, sf_dir), "score_cal"), 6, "precision", "recall", "f1")


@query("pr_best", "scored", _CURVE + """
SELECT threshold, round(pr, 6) AS precision, round(rc, 6) AS recall, round(f, 6) AS f1 FROM (SELECT s AS threshold,
  tp::DOUBLE / (tp + fp) AS pr, tp::DOUBLE / p AS rc,
  2 * (tp::DOUBLE / (tp + fp)) * (tp::DOUBLE / p) / (tp::DOUBLE / (tp + fp) + tp::DOUBLE / p + 1e-9) AS f FROM k) z
ORDER BY f DESC, threshold LIMIT 1""")
def pr_best(spark, sf_dir):
    curve = M.precision_recall_curve(_scored(spark, sf_dir), "score_cal")
    return _round(M.best_f1_point(curve), 6, "precision", "recall", "f1")


@query("roc_curve", "scored", _CURVE + """
SELECT s AS threshold, round(fp::DOUBLE / n, 6) AS fpr, round(tp::DOUBLE / p, 6) AS tpr FROM k
UNION ALL SELECT NULL, 0, 0""")
def roc_curve(spark, sf_dir):
    return _round(M.roc_curve(_scored(spark, sf_dir), "score_cal"), 6, "fpr", "tpr")


@query("threshold_metrics", "scored", _COUNTS.format(flag=_CAL) + """
SELECT round(2.0::DOUBLE * tp / (2 * tp + fp + fn), 6) AS f1, round(tp::DOUBLE / (tp + fp), 6) AS precision,
  round(tp::DOUBLE / (tp + fn), 6) AS recall FROM c""")
def threshold_metrics(spark, sf_dir):
    found = M.threshold_metrics(_scored(spark, sf_dir), F.col("score_cal") >= THRESHOLD)
    return _round(found, 6, "f1", "precision", "recall")


@query("class_report", "scored", _COUNTS.format(flag=_CAL).rstrip() + """,
l AS (SELECT 'Legit' AS class, tn::DOUBLE / (tn + fn) AS p, tn::DOUBLE / (tn + fp) AS r, tn + fp AS s FROM c
  UNION ALL SELECT 'Fraud', tp::DOUBLE / (tp + fp), tp::DOUBLE / (tp + fn), tp + fn FROM c),
m AS (SELECT *, 2 * p * r / (p + r) AS f FROM l),
a AS (SELECT class, p, r, f, s FROM m
  UNION ALL SELECT 'accuracy', (tp + tn)::DOUBLE / (tp + fp + fn + tn), (tp + tn)::DOUBLE / (tp + fp + fn + tn),
    (tp + tn)::DOUBLE / (tp + fp + fn + tn), tp + fp + fn + tn FROM c
  UNION ALL SELECT 'macro avg', avg(p), avg(r), avg(f), CAST(sum(s) AS BIGINT) FROM m
  UNION ALL SELECT 'weighted avg', sum(p * s) / sum(s), sum(r * s) / sum(s), sum(f * s) / sum(s), CAST(sum(s) AS BIGINT) FROM m)
SELECT class, round(p, 6) AS precision, round(r, 6) AS recall, round(f, 6) AS f1, s AS support FROM a""")
def class_report(spark, sf_dir):
    return _round(M.class_report(_scored(spark, sf_dir), F.col("score_cal") >= THRESHOLD),
                  6, "precision", "recall", "f1")


@query("brier", "scored", """SELECT round(avg((score_raw - isFraud) ** 2), 6) AS brier_raw,
  round(avg((score_cal - isFraud) ** 2), 6) AS brier_cal FROM scored""")
def brier(spark, sf_dir):
    return _round(M.brier(_scored(spark, sf_dir), brier_raw="score_raw", brier_cal="score_cal"),
                  6, "brier_raw", "brier_cal")


@query("reliability", "scored", """
SELECT bin, count(*) AS n, round(avg(score_raw), 6) AS mean_score, round(avg(isFraud), 6) AS fraud_share
FROM (SELECT *, CAST(greatest(0, (milli + 49) // 50 - 1) AS INT) AS bin FROM scored) b GROUP BY bin""")
def reliability(spark, sf_dir):
    return _round(M.reliability(_scored(spark, sf_dir), "score_raw"), 6, "mean_score", "fraud_share")


@query("score_hist", "scored", """
WITH s AS (SELECT isFraud, min(milli) AS lo, max(milli) AS hi, count(*) AS total FROM scored GROUP BY isFraud)
SELECT isFraud, bin, count(*) AS n, round(count(*) / (total * (hi - lo) / 1000 / 80), 4) AS density
FROM (SELECT d.isFraud, total, lo, hi, CAST(least((d.milli - lo) * 80 // (hi - lo), 79) AS INT) AS bin
  FROM scored d JOIN s ON d.isFraud = s.isFraud) b GROUP BY isFraud, bin, total, hi, lo""")
def score_hist(spark, sf_dir):
    # In thousandths, so bin edges are integers in both engines.
    hist = M.class_histogram(_scored(spark, sf_dir), "milli")
    return hist.withColumn("density", F.round(F.col("density") * 1000, 4))
