import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from risklane.operators import drift as D, metrics as M


@pytest.fixture(scope="module")
def scored():
    rng = random.Random(3)
    return [(i % 3, round(min(1.0, max(0.0, rng.gauss(0.3 + 0.25 * (i % 4 == 0), 0.2))), 2), int(i % 4 == 0)) for i in range(400)]


@pytest.fixture(scope="module")
def df(spark, scored):
    return spark.createDataFrame(scored, "batch int, s double, isFraud int")


def brute_auc(rows):
    pos, neg = [s for s, y in rows if y], [s for s, y in rows if not y]
    return sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / len(pos) / len(neg)


@pytest.mark.parametrize("limit", [10_000, 5])
def test_auc_and_average_precision(df, scored, limit):
    got = {r["batch"]: r for r in M.ranking_metrics(df, "s", ["batch"], limit).collect()}
    for b in range(3):
        rows = [(s, y) for k, s, y in scored if k == b]
        assert got[b]["auc"] == pytest.approx(brute_auc(rows))
        total = sum(y for _, y in rows)
        ap, last = 0.0, 0.0
        for cut in sorted({s for s, _ in rows}, reverse=True):
            flagged = [y for s, y in rows if s >= cut]
            ap += (sum(flagged) / total - last) * sum(flagged) / len(flagged)
            last = sum(flagged) / total
        assert got[b]["avg_precision"] == pytest.approx(ap)


def test_sweep_counts_every_edge(df, scored):
    for r in M.f1_sweep(df, "s").collect():
        flagged = [y for _, s, y in scored if s >= r["threshold"]]
        assert (r["tp"], r["fp"]) == (sum(flagged), len(flagged) - sum(flagged))
        assert r["tp"] + r["fn"] == sum(y for _, _, y in scored)


def test_no_division_by_zero(spark):
    df = spark.createDataFrame([(0.1, 0), (0.2, 0)], "s double, isFraud int")
    row = M.threshold_metrics(df, F.col("s") >= 0.9).first()
    assert (row["f1"], row["precision"], row["recall"]) == (0.0, 0.0, 0.0)
    assert M.tuned_threshold(df, "s") == 0.5


def brute_psi(expected, actual):
    edges = np.unique(np.percentile(expected, np.linspace(0, 100, 11)))
    if len(edges) < 2:
        return 0.0
    shares = []
    for values in (expected, actual):
        counts, _ = np.histogram(values, bins=edges)
        shares.append([c / len(values) if c else 1e-4 for c in counts])
    return sum((a - e) * math.log(a / e) for e, a in zip(*shares))


@pytest.mark.parametrize("limit", [10_000, 5])
def test_psi_cases(spark, limit):
    rng = random.Random(8)
    train = [(rng.gauss(0, 1), float(rng.randrange(3)), 5.0, rng.random() if i % 4 else None) for i in range(300)]
    # The second batch lies partly outside the training range; the third column is constant.
    later = [(1 + i % 2, rng.gauss(3 * (i % 2), 2), float(rng.randrange(5)), 5.0, rng.random() / 2) for i in range(200)]
    schema = "a double, b double, c double, d double"
    got = {(r["feature"], r["batch"]): r["psi"] for r in D.psi(
        spark.createDataFrame(train, schema), spark.createDataFrame(later, "batch int, " + schema),
        ["a", "b", "c", "d"], limit=limit).collect()}
    for i, f in enumerate("abcd"):
        base = [r[i] for r in train if r[i] is not None]
        for b in (1, 2):
            assert got[f, b] == pytest.approx(brute_psi(base, [r[i + 1] for r in later if r[0] == b]), abs=1e-4)


def test_psi_of_a_feature_the_batches_lack(spark):
    train = spark.createDataFrame([(1.0, 2.0), (2.0, 3.0)], "a double, gone double")
    later = spark.createDataFrame([(1, 1.0)], "batch int, a double")
    assert {(r["feature"], r["psi"]) for r in D.psi(train, later, ["a", "gone", "never"]).collect()} >= {("gone", 0.0)}


def test_histogram_closes_the_last_bin(spark):
    df = spark.createDataFrame([(0, float(i)) for i in range(81)] + [(1, 2.0)], "isFraud int, v double")
    rows = M.class_histogram(df, "v").collect()
    assert sum(r["n"] for r in rows if r["isFraud"] == 0) == 81
    assert {r["bin"]: r["n"] for r in rows if r["isFraud"] == 0}[79] == 2
    assert sum(r["density"] for r in rows if r["isFraud"] == 0) == pytest.approx(1.0)


def test_category_psi_with_new_values_and_nulls(spark):
    """Against the sum over all bins in plain Python; a batch may lack values, or hold only new ones."""
    train = [("a",)] * 6 + [("b",)] * 3 + [(None,)]
    batches = [("a", 1)] * 2 + [("z", 1), (None, 1)] + [("y", 2), ("z", 2)] + [("a", 3)] * 6 + [("b", 3)] * 3 + [(None, 3)]
    got = {r["batch"]: r["psi"] for r in D.category_psi(
        spark.createDataFrame(train, "kind string"), spark.createDataFrame(batches, "kind string, batch int"), ["kind"]).collect()}
    for batch in (1, 2, 3):
        rows = [k for k, b in batches if b == batch]
        bins = [(sum(k == v for k, in train) / len(train), sum(k == v for k in rows) / len(rows)) for v in ("a", "b", None)]
        bins.append((1e-4, sum(k in ("y", "z") for k in rows) / len(rows)))
        expected = sum(((a or 1e-4) - e) * math.log((a or 1e-4) / e) for e, a in bins)
        assert got[batch] == pytest.approx(expected, abs=6e-5)
    assert got[3] == 0
