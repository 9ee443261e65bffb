"""Registered model jobs. Models are fitted on the payments of the given tables."""

from __future__ import annotations

from functools import lru_cache, reduce

from pyspark.sql import functions as F

from risklane.functions import wording
from risklane.operators import boosting as B, calibration, decisions as D, forest as I, metrics as M, oversample as O
from risklane.plans import scoring, training as T
from risklane.plans.feature_queries import payments
from risklane.plans.registry import query
from risklane.plans.routing_queries import arms
from risklane.sources import files
from risklane.sources.views import view
from risklane.staging import new_path, spread


@lru_cache(maxsize=4)
def _parts(spark, sf_dir):
    """Assembled splits, written once per session and shared by the queries below."""
    return T.prepare(payments(spark, sf_dir))


@lru_cache(maxsize=4)
def _models(spark, sf_dir):
    return T.train(_parts(spark, sf_dir))


@lru_cache(maxsize=4)
def _forest(spark, sf_dir):
    return I.fit(_parts(spark, sf_dir).train)


@query("smote_balance", "txn", """
WITH r AS (SELECT *, row_number() OVER (ORDER BY TransactionDT, TransactionID) - 1 AS rn, count(*) OVER () AS n FROM txn),
t AS (SELECT * FROM r WHERE rn < CAST(floor(n * 0.70::DOUBLE) AS BIGINT))
SELECT isFraud, CAST(greatest(sum(isFraud) OVER (), count(*) OVER () - sum(isFraud) OVER ()) AS BIGINT) AS n FROM t
QUALIFY row_number() OVER (PARTITION BY isFraud) = 1""")
def smote_balance(spark, sf_dir):
    return O.balance(_parts(spark, sf_dir).train).groupBy("isFraud").agg(F.count(F.lit(1)).alias("n"))


@query("smote_rows")
def smote_rows(spark, sf_dir):
    from pyspark.ml.functions import vector_to_array
    return O.synthetic(_parts(spark, sf_dir).train).withColumn("features", vector_to_array("features"))


@query("gbt_score")
def gbt_score(spark, sf_dir):
    scored = B.score(_models(spark, sf_dir).booster, _parts(spark, sf_dir).test)
    return scored.select("TransactionID", "isFraud", "score_raw")


@query("calibrated")
def calibrated(spark, sf_dir):
    models = _models(spark, sf_dir)
    scored = B.score(models.booster, _parts(spark, sf_dir).test).drop("features")
    return calibration.apply(models.calibrator, scored).select("TransactionID", "isFraud", "score_raw", "score_cal")


# Pool-adjacent-violators by its min-max form: at point i the highest, over starts j <= i, of the
# lowest mean of the points j..k with k >= i.
@query("isotonic_fit", "scored", """
WITH g AS (SELECT milli, count(*) AS n, sum(isFraud) AS y FROM scored GROUP BY milli),
c AS (SELECT *, row_number() OVER w AS i, sum(n) OVER w AS cn, sum(y) OVER w AS cy FROM g WINDOW w AS (ORDER BY milli)),
jk AS (SELECT a.i AS j, b.i AS k, (b.cy - a.cy + a.y)::DOUBLE / (b.cn - a.cn + a.n) AS mean FROM c a JOIN c b ON a.i <= b.i),
low AS (SELECT j, k AS i, min(mean) OVER (PARTITION BY j ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS m FROM jk),
fit AS (SELECT i, max(m) AS v FROM low GROUP BY i)
SELECT s.TransactionID, s.isFraud, s.score_raw, round(fit.v, 5) AS score_cal
FROM scored s JOIN c ON c.milli = s.milli JOIN fit ON fit.i = c.i""")
def isotonic_fit(spark, sf_dir):
    scored = view(spark, sf_dir, "scored").select("TransactionID", "isFraud", "score_raw")
    fitted = calibration.apply(calibration.fit(scored), scored)
    return fitted.withColumn("score_cal", F.round("score_cal", 5))


@query("gbt_importance")
def gbt_importance(spark, sf_dir):
    parts = _parts(spark, sf_dir)
    return B.top_features(B.importance(_models(spark, sf_dir).booster, parts.fitted.names, parts.train), 20)


@query("tree_attrib_topn")
def tree_attrib_topn(spark, sf_dir):
    parts = _parts(spark, sf_dir)
    return B.top_contributions(B.attribute(_models(spark, sf_dir).booster, parts.test), parts.fitted.names, 10)


@query("explained_scores")
def explained_scores(spark, sf_dir):
    """Explanations of scored test payments, each with its own strongest drivers."""
    parts, models, learned = _parts(spark, sf_dir), _models(spark, sf_dir), arms(spark, sf_dir)
    strange = I.with_scores(_forest(spark, sf_dir), parts.test)
    scored = calibration.apply(models.calibrator, B.score(models.booster, strange).drop("features"))
    kinds = view(spark, sf_dir, "txn").select("TransactionID", "tx_type")
    records = D.decide(scored.join(kinds, "TransactionID"), "score_cal", "iso_score",
                       models.threshold, learned, view(spark, sf_dir, "rates"))
    items = B.attribute(models.booster, parts.test).select(
        F.col("TransactionID").cast("string").alias("transaction_id"),
        wording.strongest(B.named(F.col("values"), parts.fitted.names), 3).alias("items"))
    return D.explain(records.join(items, "transaction_id"), F.col("items"), learned)


@query("tree_attrib_mean")
def tree_attrib_mean(spark, sf_dir):
    parts = _parts(spark, sf_dir)
    return B.mean_contribution(B.attribute(_models(spark, sf_dir).booster, parts.test), parts.fitted.names)


@query("iso_scores")
def iso_scores(spark, sf_dir):
    return I.scores(_forest(spark, sf_dir), _parts(spark, sf_dir).test)


@query("iso_evaluation")
def iso_evaluation(spark, sf_dir):
    test = _parts(spark, sf_dir).test
    return scoring.anomaly_report(I.with_scores(_forest(spark, sf_dir), test).drop("features"))


@query("train_report")
def train_report(spark, sf_dir):
    return T.run_metrics(_models(spark, sf_dir), _parts(spark, sf_dir), "boosted-balanced", "Staging")


def fitted_models(spark, sf_dir):
    return _models(spark, sf_dir)


def fitted_chain(spark, sf_dir):
    return scoring.Chain(_parts(spark, sf_dir).fitted, _models(spark, sf_dir), _forest(spark, sf_dir))


def with_amount_text(payments):
    """Payments as they arrive: unlabelled, with amounts as text of which some are unreadable."""
    text = F.when(F.col("TransactionID") % 40 == 7, "n/a").otherwise(F.col("TransactionAmt").cast("string"))
    return payments.withColumn("amount_text", text).drop("TransactionAmt", "isFraud")


@query("score_batch")
def score_batch(spark, sf_dir):
    """New payments from raw columns to decision records, through the fitted models."""
    raw = with_amount_text(spread(view(spark, sf_dir, "txn")))
    return scoring.score_payments(raw, fitted_chain(spark, sf_dir), arms(spark, sf_dir), view(spark, sf_dir, "rates"))


@query("artifacts_training")
def artifacts_training(spark, sf_dir):
    """What a training run leaves as JSON, read back: (artifact, position, name, value)."""
    path = new_path(spark, "artifacts")
    models, parts = _models(spark, sf_dir), _parts(spark, sf_dir)
    T.write_artifacts(models, parts, T.run_metrics(models, parts, "boosted-balanced"), path)
    schema = ", ".join(f"{name} double" for name in [*T.REPORTED, "threshold"])
    metrics = files.read_object(spark, f"{path}/test_metrics.json", schema)
    pairs = F.array(*[F.struct(F.lit(name).alias("name"), F.col(name).alias("value")) for name in metrics.columns])
    named = [(i, name, None) for i, name in enumerate(files.read_list(spark, f"{path}/feature_names.json"))]
    tables = {"test_metrics": metrics.select(F.posexplode(pairs).alias("position", "e")).select("position", "e.*"),
              "threshold": files.read_object(spark, f"{path}/threshold.json", "threshold double").select(
                  F.lit(0).alias("position"), F.lit("threshold").alias("name"), F.col("threshold").alias("value")),
              "feature_importance": files.read_series(spark, f"{path}/feature_importance.json"),
              "feature_names": spark.createDataFrame(named, "position int, name string, value double")}
    found = [df.select(F.lit(kind).alias("artifact"), "position", "name", "value") for kind, df in tables.items()]
    return reduce(lambda a, b: a.unionByName(b), found)


# Three ways to score the same payments, as runs to be compared.
def _runs(spark, sf_dir):
    long = view(spark, sf_dir, "scored").select("isFraud", F.explode(F.array(*[
        F.struct(F.lit(run).alias("run_id"), F.lit(stage).alias("stage"), F.col(column).alias("score"))
        for run, stage, column in (("raw", "Production", "score_raw"), ("calibrated", "Staging", "score_cal"),
                                   ("anomaly", "None", "iso_score"))])).alias("r")).select("isFraud", "r.*")
    by = ["run_id", "stage"]
    wide = M.auc(long, "score", by).join(M.threshold_metrics(long, F.col("score") >= 0.41, by), by)
    names = {"test_auc": "auc", "test_f1": "f1", "test_precision": "precision", "test_recall": "recall"}
    return wide.select(*by, F.explode(F.array(*[
        F.struct(F.lit(n).alias("metric"), F.round(c, 6).alias("value")) for n, c in names.items()])).alias("m")) \
        .select(*by, "m.*")


_RUNS = """
WITH l AS (SELECT 'raw' AS run_id, 'Production' AS stage, isFraud, score_raw AS s FROM scored
  UNION ALL SELECT 'calibrated', 'Staging', isFraud, score_cal FROM scored
  UNION ALL SELECT 'anomaly', 'None', isFraud, iso_score FROM scored),
k AS (SELECT *, rank() OVER (PARTITION BY run_id ORDER BY s) + (count(*) OVER (PARTITION BY run_id, s) - 1) / 2.0::DOUBLE AS rk FROM l),
w AS (SELECT run_id, stage, (sum(rk) FILTER (WHERE isFraud = 1) - sum(isFraud) * (sum(isFraud) + 1) / 2.0::DOUBLE)
    / (sum(isFraud) * (count(*) - sum(isFraud)))::DOUBLE AS auc,
  count(*) FILTER (WHERE s >= 0.41::DOUBLE AND isFraud = 1) AS tp, count(*) FILTER (WHERE s >= 0.41::DOUBLE AND isFraud = 0) AS fp,
  count(*) FILTER (WHERE s < 0.41::DOUBLE AND isFraud = 1) AS fn FROM k GROUP BY run_id, stage),
runs AS (SELECT run_id, stage, 'test_auc' AS metric, round(auc, 6) AS value FROM w
  UNION ALL SELECT run_id, stage, 'test_f1', round(2 * tp / (2 * tp + fp + fn)::DOUBLE, 6) FROM w
  UNION ALL SELECT run_id, stage, 'test_precision', round(tp / (tp + fp)::DOUBLE, 6) FROM w
  UNION ALL SELECT run_id, stage, 'test_recall', round(tp / (tp + fn)::DOUBLE, 6) FROM w)
"""


@query("model_runs", "scored", _RUNS + "SELECT * FROM runs")
def model_runs(spark, sf_dir):
    return _runs(spark, sf_dir)


@query("model_runs_best", "scored", _RUNS + """SELECT run_id, stage, value AS test_f1 FROM runs WHERE metric = 'test_f1'
ORDER BY value DESC, run_id LIMIT 1""")
def model_runs_best(spark, sf_dir):
    return T.best_run(_runs(spark, sf_dir), "test_f1")


@query("stage_compare", "scored", _RUNS + """SELECT coalesce(a.metric, b.metric) AS metric, a.value AS staging, b.value AS production
FROM (SELECT * FROM runs WHERE stage = 'Staging') a FULL JOIN (SELECT * FROM runs WHERE stage = 'Production') b ON a.metric = b.metric""")
def stage_compare(spark, sf_dir):
    return T.compare_stages(_runs(spark, sf_dir))


@query("artifact_metrics", "scored", _RUNS + "SELECT metric, value FROM runs WHERE run_id = 'raw'")
def artifact_metrics(spark, sf_dir):
    """The metrics of one run, written as a JSON object and read back."""
    path = new_path(spark, "metrics")
    raw = _runs(spark, sf_dir).filter("run_id = 'raw'")
    names = ["test_auc", "test_f1", "test_precision", "test_recall"]
    files.write_object(raw.groupBy().pivot("metric", names).agg(F.max("value")), path)
    held = files.read_object(spark, path, ", ".join(f"{name} double" for name in names))
    return held.select(F.explode(F.array(*[
        F.struct(F.lit(name).alias("metric"), F.col(name).alias("value")) for name in names])).alias("e")).select("e.*")
