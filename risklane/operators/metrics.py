"""Evaluation of scores against labels.

Curves are built from counts per distinct score (or per threshold step), combined before the
shuffle, so raw rows are never ordered. ``by`` evaluates several groups, such as time batches, at once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from risklane.operators.ordered import TASK_ROWS, if_small, running_sums
from risklane.staging import stage

LABEL = "isFraud"
EXACT = "decimal(38,0)"

# Cost in rupees of a missed fraud, of a blocked good payment, and of one manual review (fixed values).
MISSED_FRAUD, BLOCKED_SALE, REVIEW = 2400, 1200, 200

# Threshold steps in hundredths (fixed values).
F1_STEPS = range(10, 91)
COST_STEPS = range(5, 96)


def ratio(top: Column, bottom: Column) -> Column:
    """top / bottom, 0 when there is nothing to divide by."""
    return F.coalesce(F.try_divide(top.cast("double"), bottom.cast("double")), F.lit(0.0))


def precision(tp: Column, fp: Column) -> Column:
    return ratio(tp, tp + fp)


def recall(tp: Column, fn: Column) -> Column:
    return ratio(tp, tp + fn)


def f1(tp: Column, fp: Column, fn: Column) -> Column:
    return ratio(2 * tp, 2 * tp + fp + fn)


def confusion(df: DataFrame, flagged: Column, by: Sequence[str] = ()) -> DataFrame:
    fraud = F.col(LABEL) == 1
    return df.groupBy(*by).agg(
        F.count_if(flagged & fraud).alias("tp"), F.count_if(flagged & ~fraud).alias("fp"),
        F.count_if(~flagged & fraud).alias("fn"), F.count_if(~flagged & ~fraud).alias("tn"))


def net_benefit(tp: Column, fp: Column) -> Column:
    return tp * MISSED_FRAUD - fp * BLOCKED_SALE - (tp + fp) * REVIEW


def cost_model(counts: DataFrame) -> DataFrame:
    """Costs and savings of confusion counts against letting all fraud pass."""
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    baseline = (tp + fn) * MISSED_FRAUD
    gain = net_benefit(tp, fp)
    return counts.withColumns({
        "cost_false_positives": fp * BLOCKED_SALE, "cost_false_negatives": fn * MISSED_FRAUD,
        "cost_review": (tp + fp) * REVIEW, "baseline_cost": baseline,
        "value_prevented": tp * MISSED_FRAUD, "net_benefit": gain,
        "roi_pct": F.round(gain * 100 / F.greatest(baseline, F.lit(1)), 1),
    })


def hundredths(score: Column) -> Column:
    """The largest i with score >= i/100, compared as the doubles i/100 and not by a product."""
    i = F.floor(score * 100)
    return F.when(score >= (i + 1) / 100, i + 1).when(score < i / 100, i - 1).otherwise(i).cast("int")


def sweep(df: DataFrame, score: str, steps: range) -> DataFrame:
    """Confusion counts at every threshold i/100 of ``steps``, from one pass.

    Rows are counted per step first; what is summed over thresholds is a table of about a hundred rows.
    """
    spark = df.sparkSession
    step = F.least(F.greatest(hundredths(F.col(score)), F.lit(steps.start - 1)), F.lit(steps[-1]))
    counts = df.select(step.alias("step"), F.col(LABEL).cast("long").alias("y")).groupBy("step").agg(
        F.sum("y").alias("pos"), F.sum(1 - F.col("y")).alias("neg"))
    grid = spark.range(steps.start - 1, steps[-1] + 1).select(F.col("id").cast("int").alias("step"))
    filled = grid.join(F.broadcast(counts), "step", "left").na.fill(0, ["pos", "neg"])
    from_here = W.orderBy(F.desc("step"))
    whole = W.partitionBy()
    table = filled.select(
        "step", F.sum("pos").over(from_here).alias("tp"), F.sum("neg").over(from_here).alias("fp"),
        F.sum("pos").over(whole).alias("_pos"), F.sum("neg").over(whole).alias("_neg"))
    table = table.filter(F.col("step") >= steps.start)
    return table.select((F.col("step") / 100).alias("threshold"), "tp", "fp",
                        (F.col("_pos") - F.col("tp")).alias("fn"), (F.col("_neg") - F.col("fp")).alias("tn"))


def f1_sweep(df: DataFrame, score: str) -> DataFrame:
    return sweep(df, score, F1_STEPS).withColumn("f1", f1(F.col("tp"), F.col("fp"), F.col("fn")))


def best_threshold(swept: DataFrame, value: str) -> DataFrame:
    """The lowest threshold with the highest ``value``."""
    top = F.max(F.struct(F.col(value).alias("value"), (-F.col("threshold")).alias("low")))
    return swept.agg(top.alias("best")).select(
        (-F.col("best.low")).alias("threshold"), F.col("best.value").alias(value))


def tuned_threshold(df: DataFrame, score: str, fallback: float = 0.5) -> float:
    """The F1-optimal threshold; ``fallback`` when no threshold catches any fraud."""
    best = best_threshold(f1_sweep(df, score), "f1").first()
    return best["threshold"] if best["f1"] > 0 else fallback


def cost_curve(df: DataFrame, score: str) -> DataFrame:
    swept = sweep(df, score, COST_STEPS)
    return swept.select("threshold", net_benefit(F.col("tp"), F.col("fp")).alias("net_benefit"),
                        f1(F.col("tp"), F.col("fp"), F.col("fn")).alias("f1"))


def score_counts(df: DataFrame, score: str, by: Sequence[str] = ()) -> DataFrame:
    """Positives and negatives per distinct score, staged: the curves read it several times."""
    label = F.col(LABEL).cast("long")
    return stage(df.groupBy(*by, F.col(score).alias("score")).agg(
        F.sum(label).alias("pos"), F.sum(1 - label).alias("neg")), "scores")


def _totals(counts: DataFrame, by: Sequence[str]) -> DataFrame:
    return counts.groupBy(*by).agg(F.sum("pos").alias("all_pos"), F.sum("neg").alias("all_neg"))


def _with_totals(rows: DataFrame, counts: DataFrame, by: Sequence[str]) -> DataFrame:
    totals = _totals(counts, by)
    if by:
        return rows.join(if_small(totals), list(by))
    row = totals.first()
    return rows.withColumns({"all_pos": F.lit(row["all_pos"] or 0).cast("long"),
                             "all_neg": F.lit(row["all_neg"] or 0).cast("long")})


def descending_curve(df: DataFrame, score: str, by: Sequence[str] = (), limit: int = TASK_ROWS) -> DataFrame:
    """Per distinct score: tp, fp when everything scored at least that much is flagged, and the totals."""
    counts = score_counts(df, score, by)
    flipped = counts.withColumn("_order", -F.col("score"))
    summed = running_sums(flipped, by, ["_order"], {"_pos": F.col("pos"), "_neg": F.col("neg")}, limit)
    return _with_totals(summed, counts, by).select(
        *by, "score", "pos", "neg", (F.col("_pos") + F.col("pos")).alias("tp"),
        (F.col("_neg") + F.col("neg")).alias("fp"), "all_pos", "all_neg")


def auc(df: DataFrame, score: str, by: Sequence[str] = (), limit: int = TASK_ROWS) -> DataFrame:
    """ROC AUC as the share of (fraud, good) pairs in the right order, ties counting half; exact."""
    curve = descending_curve(df, score, by, limit)
    return curve.groupBy(*by).agg(auc_of(F.col("pos"), F.col("neg"), F.col("fp")).alias("auc"))


def auc_of(pos: Column, neg: Column, fp: Column) -> Column:
    """Aggregate over a descending curve. Frauds at a score beat the good payments below it."""
    below = 2 * (F.col("all_neg") - fp) + neg
    won = F.sum(pos.cast("decimal(18,0)") * below.cast("decimal(19,0)")).cast("double")
    pairs = F.max(F.col("all_pos").cast("double") * F.col("all_neg").cast("double"))
    return F.try_divide(won, 2 * pairs)


def average_precision(df: DataFrame, score: str, by: Sequence[str] = (), limit: int = TASK_ROWS) -> DataFrame:
    """Sum over the curve of the gain in recall times precision."""
    curve = descending_curve(df, score, by, limit)
    return curve.groupBy(*by).agg(average_precision_of().alias("avg_precision"))


def average_precision_of() -> Column:
    return F.sum(ratio(F.col("pos"), F.col("all_pos")) * precision(F.col("tp"), F.col("fp")))


def ranking_metrics(df: DataFrame, score: str, by: Sequence[str] = (), limit: int = TASK_ROWS) -> DataFrame:
    """AUC and average precision from one curve."""
    return descending_curve(df, score, by, limit).groupBy(*by).agg(
        auc_of(F.col("pos"), F.col("neg"), F.col("fp")).alias("auc"), average_precision_of().alias("avg_precision"))


def threshold_metrics(df: DataFrame, flagged: Column, by: Sequence[str] = ()) -> DataFrame:
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return confusion(df, flagged, by).select(
        *by, f1(tp, fp, fn).alias("f1"), precision(tp, fp).alias("precision"), recall(tp, fn).alias("recall"))


def class_report(df: DataFrame, flagged: Column) -> DataFrame:
    """Precision, recall, F1 and support per class, with accuracy, macro and weighted averages."""
    counts = confusion(df, flagged).withColumn("n", F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn"))
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))

    def line(name, p, r, f, support):
        return F.struct(F.lit(name).alias("class"), p.alias("precision"), r.alias("recall"), f.alias("f1"),
                        support.cast("long").alias("support"))

    good = (precision(tn, fn), recall(tn, fp), f1(tn, fn, fp), tn + fp)
    bad = (precision(tp, fp), recall(tp, fn), f1(tp, fp, fn), tp + fn)
    accuracy = ratio(tp + tn, F.col("n"))
    macro = [(g + b) / 2 for g, b in zip(good[:3], bad[:3])]
    weighted = [ratio(g * good[3] + b * bad[3], F.col("n")) for g, b in zip(good[:3], bad[:3])]
    lines = F.array(line("Legit", *good), line("Fraud", *bad),
                    line("accuracy", accuracy, accuracy, accuracy, F.col("n")),
                    line("macro avg", *macro, F.col("n")), line("weighted avg", *weighted, F.col("n")))
    return counts.select(F.explode(lines).alias("line")).select("line.*")


def brier(df: DataFrame, **scores: str) -> DataFrame:
    """Mean squared error of each named score column."""
    return df.agg(*[F.avg(F.pow(F.col(column) - F.col(LABEL), 2)).alias(name) for name, column in scores.items()])


def reliability(df: DataFrame, score: str, bins: int = 20) -> DataFrame:
    """Mean score and fraud share per equal-width bin, closed on the right; empty bins are absent."""
    p = F.col(score)
    i = F.ceil(p * bins) - 1
    exact = F.when(p <= i / bins, i - 1).when(p > (i + 1) / bins, i + 1).otherwise(i)
    placed = F.least(F.greatest(exact, F.lit(0)), F.lit(bins - 1)).cast("int")
    return df.groupBy(placed.alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.avg(score).alias("mean_score"), F.avg(LABEL).alias("fraud_share"))


def precision_recall_curve(df: DataFrame, score: str, limit: int = TASK_ROWS) -> DataFrame:
    """One point per distinct score, lowest threshold first in meaning; F1 uses the plotted formula."""
    curve = descending_curve(df, score, (), limit)
    p, r = precision(F.col("tp"), F.col("fp")), ratio(F.col("tp"), F.col("all_pos"))
    return curve.select(F.col("score").alias("threshold"), p.alias("precision"), r.alias("recall"),
                        (2 * p * r / (p + r + 1e-9)).alias("f1"))


def best_f1_point(curve: DataFrame) -> DataFrame:
    """The point with the highest F1; the lowest threshold on ties."""
    top = F.max(F.struct(F.col("f1"), (-F.col("threshold")).alias("low"), "precision", "recall"))
    return curve.agg(top.alias("p")).select(
        (-F.col("p.low")).alias("threshold"), F.col("p.precision").alias("precision"),
        F.col("p.recall").alias("recall"), F.col("p.f1").alias("f1"))


def roc_curve(df: DataFrame, score: str, limit: int = TASK_ROWS) -> DataFrame:
    """(threshold, fpr, tpr) per distinct score, and the origin with a null threshold."""
    points = descending_curve(df, score, (), limit).select(
        F.col("score").alias("threshold"), ratio(F.col("fp"), F.col("all_neg")).alias("fpr"),
        ratio(F.col("tp"), F.col("all_pos")).alias("tpr"))
    origin = df.sparkSession.range(1).select(
        F.lit(None).cast("double").alias("threshold"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"))
    return points.unionByName(origin)


def class_histogram(df: DataFrame, value: str, bins: int = 80, label: str = LABEL) -> DataFrame:
    """Density histogram per class over that class's own range; the last bin is closed."""
    df = df.filter(F.col(label).isin(0, 1))
    spans = df.groupBy(label).agg(F.min(value).alias("low"), F.max(value).alias("high"),
                                  F.count(value).alias("total"))
    width = (F.col("high") - F.col("low")) / bins
    # Two rows at most.
    placed = df.filter(F.col(value).isNotNull()).join(F.broadcast(spans), label).withColumn(
        "bin", F.coalesce(F.least(F.floor(F.try_divide((F.col(value) - F.col("low")) * bins,
                                                       F.col("high") - F.col("low"))), F.lit(bins - 1)),
                          F.lit(0)).cast("int"))
    return placed.groupBy(label, "bin").agg(
        F.count(F.lit(1)).alias("n"),
        F.max(F.try_divide(F.lit(1.0), F.col("total") * width)).alias("_per_row")).select(
        label, "bin", "n", (F.col("n") * F.col("_per_row")).alias("density"))
