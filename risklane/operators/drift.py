"""Drift between a training set and later time batches."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from risklane.functions import wording
from risklane.operators import metrics as M
from risklane.operators.encode import MISSING
from risklane.operators.ordered import TASK_ROWS, if_small
from risklane.operators.quantiles import quantiles
from risklane.staging import stage

# Histogram bins, share given to an empty bin, and the retraining limits.
BINS = 10
EMPTY_SHARE = 1e-4
PSI_LIMIT, PSI_FEATURES = 0.20, 3
AUC_DROP_LIMIT, SHIFT_LIMIT = 0.05, 0.30
LEAST_POSITIVES = 5


def to_long(df: DataFrame, features: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """(keep..., feature, value) without nulls."""
    pairs = F.array(*[
        F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("value")) for f in features])
    return df.select(*keep, F.explode(pairs).alias("p")).select(*keep, "p.*").filter(F.col("value").isNotNull())


def bin_edges(train: DataFrame, features: Sequence[str], bins: int = BINS, limit: int = TASK_ROWS) -> DataFrame:
    """(feature, edges): the distinct quantiles of the training values, in order."""
    probs = [i / bins for i in range(bins + 1)]
    cut = quantiles(to_long(train, features), ["feature"], "value", probs, "edges", limit)
    found = cut.select("feature", F.array_distinct("edges").alias("edges")).collect()   # eleven numbers per feature
    return train.sparkSession.createDataFrame(found, "feature string, edges array<double>")


def histograms(values: DataFrame, edges: DataFrame, by: Sequence[str], bins: int = BINS) -> DataFrame:
    """Counts per bin (c0, c1, ...) and all rows (n), per feature and ``by``.

    Bins are closed on the left, the last one on both sides; values outside the edges are in n only.
    """
    # One row per monitored feature.
    placed = values.join(F.broadcast(edges), "feature").withColumn(
        "_bin", F.size(F.filter("edges", lambda e: e <= F.col("value"))) - 1)
    last = F.size("edges") - 2
    at_top = F.col("value") == F.element_at("edges", -1)
    placed = placed.withColumn("_bin", F.when(at_top, last).when(F.col("_bin") <= last, F.col("_bin")))
    return placed.groupBy("feature", *by).agg(
        F.count(F.lit(1)).alias("n"),
        *[F.expr(f"count_if(_bin = {i})").alias(f"c{i}") for i in range(bins)])


def _share(count: str, n: str) -> str:
    return f"(CASE WHEN {count} = 0 THEN {EMPTY_SHARE!r}D ELSE {count} / {n} END)"


def psi(train: DataFrame, batches: DataFrame, features: Sequence[str], bins: int = BINS,
        limit: int = TASK_ROWS) -> DataFrame:
    """(feature, batch, psi) of every feature and time batch against the training values.

    A feature the batches lack has psi 0, as has one that is constant in training.
    """
    known = [f for f in features if f in train.columns]
    shared = [f for f in known if f in batches.columns]
    edges = bin_edges(train, shared, bins, limit)
    expected = histograms(to_long(train, shared), edges, [], bins).select(
        "feature", F.col("n").alias("e_n"), *[F.col(f"c{i}").alias(f"e{i}") for i in range(bins)])
    actual = histograms(to_long(batches, shared, ["batch"]), edges, ["batch"], bins)
    both = actual.join(expected, "feature").join(edges, "feature")
    # One SQL text: sum over bins of (a - e) * ln(a / e), for the bins the feature has.
    terms = []
    for i in range(bins):
        e, a = _share(f"e{i}", "e_n"), _share(f"c{i}", "n")
        terms.append(f"CASE WHEN size(edges) - 1 > {i} THEN ({a} - {e}) * ln({a} / {e}) ELSE 0D END")
    found = both.select("feature", "batch", F.round(F.expr(" + ".join(terms)), 4).alias("psi"))
    absent = [f for f in known if f not in shared]
    if absent:
        found = found.unionByName(batches.select("batch").distinct().select(
            F.explode(F.array(*[F.lit(f) for f in absent])).alias("feature"), "batch", F.lit(0.0).alias("psi")))
    return found


def category_counts(df: DataFrame, features: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Rows per (by..., feature, value) of text columns; null is a value of its own."""
    pairs = F.array(*[F.struct(F.lit(f).alias("feature"), F.coalesce(F.col(f).cast("string"), F.lit(MISSING)).alias("value"))
                      for f in features])
    return df.select(*by, F.explode(pairs).alias("p")).select(*by, "p.*").groupBy(*by, "feature", "value").agg(
        F.count(F.lit(1)).alias("n"))


def category_psi(train: DataFrame, batches: DataFrame, features: Sequence[str]) -> DataFrame:
    """(feature, batch, psi) of text columns: one bin per training value, and one for all values training never saw.

    A value a batch lacks adds the same term whatever the batch. So these terms are summed once per feature, and only values
    that a batch has are joined: no table of all batches by all values arises.
    """
    empty = F.lit(EMPTY_SHARE)

    def term(actual: Column, expected: Column) -> Column:
        return (actual - expected) * F.ln(actual / expected)

    known = stage(category_counts(train, features), "categories")
    sizes = known.groupBy("feature").agg(F.sum("n").alias("e_n"))       # one row per monitored feature
    shares = known.join(F.broadcast(sizes), "feature").select(
        "feature", "value", (F.col("n") / F.col("e_n")).alias("e")).withColumn("absent", term(empty, F.col("e")))
    base = shares.groupBy("feature").agg(F.sum("absent").alias("base"))
    counts = stage(category_counts(batches, features, ["batch"]), "categories")
    totals = counts.groupBy("feature", "batch").agg(F.sum("n").alias("a_n"))
    # The shares need the size of the batch, a table of one row per feature and batch.
    placed = counts.join(F.broadcast(totals), ["feature", "batch"]).join(if_small(shares), ["feature", "value"], "left")
    share = F.col("n") / F.col("a_n")
    found = placed.groupBy("feature", "batch").agg(
        F.coalesce(F.sum(term(share, F.col("e")) - F.col("absent")), F.lit(0.0)).alias("moved"),
        F.coalesce(F.sum(F.when(F.col("e").isNull(), share)), F.lit(0.0)).alias("unseen"))
    return found.join(F.broadcast(base), "feature").select("feature", "batch", F.round(
        F.col("base") + F.col("moved") + F.when(F.col("unseen") > 0, term(F.col("unseen"), empty)).otherwise(0.0), 4).alias("psi"))


def psi_matrix(psi_rows: DataFrame, batches: int = 10) -> DataFrame:
    """Features as rows, Batch_1.. as columns."""
    named = psi_rows.select("feature", F.concat(F.lit("Batch_"), F.col("batch")).alias("name"), "psi")
    return named.groupBy("feature").pivot("name", [f"Batch_{i + 1}" for i in range(batches)]).agg(F.max("psi"))


def prior_shift(train: DataFrame, batches: DataFrame, label: str = M.LABEL) -> DataFrame:
    """Fraud rate per batch and its shift in percent from the training rate."""
    baseline = train.agg(F.avg(label).alias("rate")).first()["rate"]
    rates = batches.groupBy("batch").agg(F.avg(label).alias("fraud_rate"))
    return rates.withColumns({
        "baseline_rate": F.lit(baseline),
        "shift_pct": F.try_divide(F.col("fraud_rate") - baseline, F.lit(baseline)) * 100})


def concept_drift(batches: DataFrame, score: str, threshold: float, limit: int = TASK_ROWS) -> DataFrame:
    """AUC, F1, precision, recall and fraud rate per batch with at least five frauds."""
    ranking = M.auc(batches, score, ["batch"], limit)
    at_threshold = M.threshold_metrics(batches, F.col(score) >= threshold, ["batch"])
    rates = batches.groupBy("batch").agg(F.avg(M.LABEL).alias("fraud_rate"),
                                         F.sum(F.col(M.LABEL).cast("long")).alias("_pos"))
    merged = rates.filter(F.col("_pos") >= LEAST_POSITIVES).join(ranking, "batch").join(at_threshold, "batch")
    return merged.select("batch", *[
        F.round(c, 4).alias(c) for c in ("auc", "f1", "precision", "recall", "fraud_rate")])


def retrain_rule(psi_rows: DataFrame, concept: DataFrame, prior: DataFrame, features: Sequence[str]) -> DataFrame:
    """One row: whether to retrain, and why. Inputs have one row per batch (and feature).

    The fraud-rate shift compares the last batch with the first one. ``features`` gives the order
    in which drifted features are listed.
    """
    rank = F.array_position(F.array(*[F.lit(f) for f in features]), F.col("feature"))
    newest = F.max("batch").over(W.partitionBy())
    last_psi = psi_rows.withColumn("_newest", newest).filter("batch = _newest").agg(
        F.transform(F.sort_array(F.collect_list(F.when(F.col("psi") > PSI_LIMIT, F.struct(rank, "feature")))),
                    lambda p: p["feature"]).alias("high_psi_features"),
        F.max("psi").alias("max_psi"))
    aucs = concept.agg(F.count(F.lit(1)).alias("_n"), F.min_by("auc", "batch").alias("_first"),
                       F.max_by("auc", "batch").alias("last_auc"))
    rates = prior.agg(F.min_by("fraud_rate", "batch").alias("_old"), F.max_by("fraud_rate", "batch").alias("_new"))
    facts = _side_by_side(last_psi, aucs, rates)

    n, names = F.size("high_psi_features"), F.col("high_psi_features")
    drop = F.when(F.col("_n") >= 2, F.col("_first") - F.col("last_auc")).otherwise(F.lit(0.0))
    # From a rate of zero any fraud is an unbounded shift, and none is no shift.
    shift = F.when(F.col("_old") > 0, F.try_divide(F.abs(F.col("_new") - F.col("_old")), F.col("_old"))) \
             .when(F.col("_new") > 0, F.lit(float("inf")))
    facts = facts.withColumns({"n_high": n, "drop": drop, "shift": shift})
    retrain = (F.col("n_high") >= PSI_FEATURES) | (F.col("drop") > AUC_DROP_LIMIT) | F.coalesce(F.col("shift") > SHIFT_LIMIT, F.lit(False))
    listed = F.concat(F.lit("["), F.array_join(F.transform(
        F.slice(names, 1, 5), lambda f: F.concat(F.lit("'"), f, F.lit("'"))), ", "), F.lit("]"))
    reason = F.when(retrain, F.format_string(
        wording.RETRAIN_REASON, "n_high", listed, wording.even(F.col("drop"), 4), wording.one_decimal(F.col("shift") * 100),
    )).otherwise(F.format_string(
        wording.MONITOR_REASON, wording.even(F.col("max_psi"), 3), wording.even(F.col("last_auc"), 4)))
    return facts.select(
        retrain.alias("should_retrain"), "high_psi_features", F.col("n_high").alias("n_high_psi_features"),
        F.round("drop", 4).alias("auc_degradation"), F.round(F.col("shift") * 100, 1).alias("fraud_rate_shift_pct"),
        F.when(retrain, "RETRAIN").otherwise("MONITOR").alias("recommendation"), reason.alias("reason"))


def _side_by_side(*one_row_tables: DataFrame) -> DataFrame:
    """Columns of several one-row aggregates in one row."""
    keyed = [t.withColumn("_row", F.lit(1)) for t in one_row_tables]
    merged = keyed[0]
    for other in keyed[1:]:
        merged = merged.unionByName(other, allowMissingColumns=True)
    columns = [c for t in one_row_tables for c in t.columns]
    return merged.groupBy("_row").agg(*[F.first(c, ignorenulls=True).alias(c) for c in columns])


def drift_text(rule: DataFrame) -> DataFrame:
    """The rule's row with a plain-language report."""
    alert = F.format_string(wording.DRIFT_FOUND, "n_high_psi_features", "auc_degradation",
                            wording.one_decimal(F.col("fraud_rate_shift_pct")))
    return rule.select(F.when(F.col("recommendation") == "RETRAIN", alert).otherwise(wording.NO_DRIFT).alias("report"),
                       F.col("recommendation").alias("status"))
