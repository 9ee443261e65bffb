import random

import pytest
from pyspark.sql import functions as F

from risklane.operators import velocity as V
from risklane.sources.views import view

HORIZONS = {"1h": 3600, "24h": 86400, "7d": 604800}


@pytest.fixture(scope="module")
def payments():
    rng = random.Random(11)
    rows = []
    for i in range(600):
        card = 1 if rng.random() < 0.35 else rng.randrange(2, 30)
        rows.append((i, card, rng.randrange(0, 900_000, 1800), rng.choice([0, 0, 1250, 1250, rng.randrange(1, 90000)])))
    rows.append((600, 99, 5, 100))
    return rows


@pytest.mark.parametrize("limit", [10_000, 40, 1])
def test_exact_against_brute_force(spark, payments, limit):
    df = spark.createDataFrame(payments, "TransactionID long, card1 long, TransactionDT long, cents long")
    got = {r["TransactionID"]: r for r in V.exact_velocity(df.repartition(3), limit=limit).collect()}
    assert len(got) == len(payments)
    for ident, card, at, cents in payments:
        prior = [p for p in payments if p[1] == card and (p[2], p[0]) < (at, ident)]
        row = got[ident]
        assert row["vel_tx_prior"] == len(prior)
        for name, width in HORIZONS.items():
            assert row[f"vel_tx_{name}"] == sum(p[2] >= at - width for p in prior)
        assert row["vel_amt_24h"] == pytest.approx(sum(p[3] for p in prior if p[2] >= at - 86400) / 100)
        amounts = [p[3] / 100 for p in prior]
        if len(amounts) < 2:
            assert row["vel_amt_zscore"] == 0
        else:
            mean = sum(amounts) / len(amounts)
            spread = (sum((a - mean) ** 2 for a in amounts) / len(amounts)) ** 0.5
            if spread > 1e-6:
                assert row["vel_amt_zscore"] == pytest.approx((cents / 100 - mean) / (spread + 1e-6), rel=1e-6, abs=1e-9)


def test_equal_amounts_have_no_spread(spark):
    rows = [(i, 1, i * 10, 1999) for i in range(5)] + [(5, 1, 60, 2000)]
    df = spark.createDataFrame(rows, "TransactionID long, card1 long, TransactionDT long, cents long")
    last = V.exact_velocity(df).filter("TransactionID = 5").first()
    assert last["vel_amt_zscore"] == pytest.approx(0.01 / 1e-6)


def test_one_shuffle(spark, sf_dir):
    txn = view(spark, sf_dir, "txn")
    plan = V._history_by_window(txn.select(*V.KEY, "cents"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1


def test_bands_leave_zero_out(spark):
    rows = [(c, 1) for c in (0, 1, 2, 3, 4, 5, 6, 10, 11, 999, 1000)]
    bands = V.fraud_by_band(spark.createDataFrame(rows, "vel_tx_24h long, isFraud int")).collect()
    assert {(r["band"], r["n"]) for r in bands} == {("1", 1), ("2-3", 2), ("4-5", 2), ("6-10", 2), ("11-999", 2)}


def test_earlier_totals_continue_a_history(spark, payments):
    schema = "TransactionID long, card1 long, TransactionDT long, cents long"
    df = spark.createDataFrame(payments, schema)
    whole = {r["TransactionID"]: r for r in V.exact_velocity(df).collect()}
    cut = 200_000
    old, new = df.filter(F.col("TransactionDT") < cut), df.filter(F.col("TransactionDT") >= cut)
    for r in V.exact_velocity(new, earlier=V.card_totals(old)).filter(F.col("TransactionDT") >= cut + 604800).collect():
        assert r == whole[r["TransactionID"]]
