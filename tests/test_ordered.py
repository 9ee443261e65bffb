"""Ordered sums, rolling means, positions and quantiles against plain Python, on small and split paths."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from risklane.operators import ordered as O
from risklane.operators.quantiles import quantiles
from risklane.operators.skew import attach, lookup


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    # One key has a third of the rows; one key has a single row; keys may be null.
    keys = ["hot"] * 200 + [rng.choice("abcdef") for _ in range(390)] + [None] * 9 + ["lone"]
    rng.shuffle(keys)
    return [(k, rng.randrange(40), i, rng.randrange(-50, 100)) for i, k in enumerate(keys)]


@pytest.fixture(scope="module")
def df(spark, rows):
    return spark.createDataFrame(rows, "k string, t long, id long, v long").repartition(5)


@pytest.mark.parametrize("limit", [10_000, 7])
@pytest.mark.parametrize("keys", [["k"], []])
def test_running_sums(df, rows, keys, limit):
    got = {r["id"]: (r["n"], r["s"]) for r in O.running_sums(
        df, keys, ["t", "id"], {"n": F.lit(1).cast("long"), "s": F.col("v")}, limit).collect()}
    seen = {}
    for k, t, i, v in sorted(rows, key=lambda r: (r[1], r[2])):
        group = k if keys else "all"
        n, s = seen.get(group, (0, 0))
        assert got[i] == (n, s)
        seen[group] = (n + 1, s + v)
    assert len(got) == len(rows)


def test_slices_grow_in_number_not_in_size(spark, df, rows, monkeypatch):
    monkeypatch.setattr(O, "SLICE_ROWS", 20)
    staged = []
    monkeypatch.setattr(O, "stage", lambda df, label: staged.append(df) or df.localCheckpoint())
    got = {r["id"]: r["s"] for r in O.range_scan(df, ["k"], ["t", "id"], {"s": F.col("v")}).collect()}
    seen = {}
    for k, t, i, v in sorted(rows, key=lambda r: (r[1], r[2])):
        assert got[i] == seen.get(k, 0)
        seen[k] = got[i] + v
    assert staged[0].rdd.getNumPartitions() == max(len(rows) // 20, int(spark.conf.get("spark.sql.shuffle.partitions")))
    assert len(rows) // 20 > int(spark.conf.get("spark.sql.shuffle.partitions"))


@pytest.mark.parametrize("limit", [10_000, 25])
def test_rolling_mean(df, rows, limit):
    got = {r["id"]: r["m"] for r in O.rolling_mean(df, ["k"], ["t", "id"], "v", 20, "m", limit).collect()}
    seen = {}
    for k, t, i, v in sorted(rows, key=lambda r: (r[1], r[2])):
        line = seen.setdefault(k, [])
        line.append(v)
        expected = sum(line[-20:]) / 20 if len(line) >= 20 else None
        assert got[i] == (pytest.approx(expected) if expected is not None else None)


@pytest.mark.parametrize("limit", [10_000, 6])
def test_rows_at(df, rows, limit):
    line = sorted((t, i) for _, t, i, _ in rows)
    ranks = [0, 1, 17, 300, len(line) - 1, len(line), 10**9]
    found = O.Timeline(df, "t", "id", limit).rows_at(ranks)
    assert found == [line[r] if r < len(line) else None for r in ranks]


@pytest.mark.parametrize("limit", [10_000, 6])
def test_quantiles(df, rows, limit):
    probs = [0, 0.1, 0.25, 0.5, 0.9, 1]
    got = {r["k"]: r["quantiles"] for r in quantiles(df.filter("k is not null"), ["k"], "v", probs, limit=limit).collect()}
    for key in {r[0] for r in rows if r[0]}:
        assert got[key] == pytest.approx(np.quantile([v for k, _, _, v in rows if k == key], probs).tolist())


@pytest.mark.parametrize("limit", [10_000, 100, 2])
def test_lookup_and_attach(spark, df, rows, limit):
    right = spark.createDataFrame([("hot", 1), ("a", 2), ("z", 3)], "k string, w int")
    got = sorted((r["id"], r["w"]) for r in lookup(df, right, ["k"], limit).collect())
    assert got == [(i, {"hot": 1, "a": 2}.get(k)) for k, _, i, _ in sorted(rows, key=lambda r: r[2])]
    sums = {r["id"]: r["s"] for r in attach(df.filter("k is not null"), ["k"], limit, s=F.sum("v")).collect()}
    for k, _, i, _ in rows:
        if k:
            assert sums[i] == sum(r[3] for r in rows if r[0] == k)


def test_no_window_without_keys_over_raw_rows(df):
    plan = O.range_scan(df, [], ["t", "id"], {"n": F.lit(1).cast("long")})._jdf.queryExecution().executedPlan().toString()
    # The row window is partitioned by slice; only the table of slice totals is windowed whole.
    assert "windowspecdefinition(_slice" in plan


@pytest.mark.parametrize("keys", [["k"], []])
def test_quantiles_by_bracket(spark, keys):
    """Only the values near the quantiles are counted one by one, and the result stays exact, ties and extremes included."""
    from pyspark.sql import functions as F
    from risklane.operators import quantiles as Q
    df = spark.range(60_000).select(
        (F.col("id") % 3).alias("k"), (F.pmod(F.xxhash64("id"), F.lit(10**9)) / 7.0).alias("v")).unionByName(
        spark.range(5000).select(F.lit(1).cast("long").alias("k"), F.lit(5.0).alias("v"))).cache()
    probs = [0.0, 0.1, 0.25, 0.5, 0.75, 0.999, 1.0]
    table = df.toPandas()
    expected = {0: np.quantile(table["v"], probs)} if not keys else {k: np.quantile(part["v"], probs) for k, part in table.groupby("k")}
    for row in quantiles(df, keys, "v", probs, whole=0).collect():
        assert row["quantiles"] == pytest.approx(expected[row["k"] if keys else 0].tolist())
    found = Q.brackets(df, keys, "v", probs, 0)
    assert Q.counted_values(df, keys, "v", found).count() < 0.02 * 65_000
    # A bracket that misses its quantile is noticed.
    off = found.withColumn("_brackets", F.array(F.struct(F.lit(-9.0).alias("low"), F.lit(-8.0).alias("high"))))
    cut = Q._ranked(Q.counted_values(df, keys, "v", off), keys, "v", [0.5], "q", 1000)
    assert [row["q"] for row in cut.collect()] == [[None]] * len(expected)
