"""Registered feature queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from risklane.operators import encode, features as X, splits
from risklane.operators.skew import lookup
from risklane.plans.profile_queries import SPLIT_SQL
from risklane.plans.registry import query
from risklane.sources.views import view

# The payment table as it arrives: no helper columns of the view.
COLUMNS = ["TransactionID", "TransactionDT", "TransactionAmt", "card1", "ProductCD", "card4", "card6",
           "P_emaildomain", "DeviceType", "addr1", "addr2", "sparse1", "isFraud"]
CATEGORIES = ["ProductCD", "card4", "card6", "P_emaildomain", "DeviceType"]


def payments(spark, sf_dir):
    return view(spark, sf_dir, "txn").select(*COLUMNS)


def _doubles(df, digits=3):
    """Floats as rounded doubles, small integers as long, for comparison across engines."""
    kinds = {f.name: f.dataType.typeName() for f in df.schema.fields}
    casts = {n: F.round(F.col(n).cast("double"), digits) for n, k in kinds.items() if k in ("float", "double")}
    casts |= {n: F.col(n).cast("long") for n, k in kinds.items() if k in ("byte", "short", "integer")}
    return df.withColumns(casts)


_TIME = """sin(2 * pi() * ((TransactionDT % 86400) / 3600.0::DOUBLE) / 24) AS hour_sin,
  cos(2 * pi() * ((TransactionDT % 86400) / 3600.0::DOUBLE) / 24) AS hour_cos,
  sin(2 * pi() * ((TransactionDT // 86400) % 7) / 7) AS dow_sin,
  cos(2 * pi() * ((TransactionDT // 86400) % 7) / 7) AS dow_cos, (TransactionDT % 86400) / 3600.0::DOUBLE AS hour_raw,
  ln(1 + TransactionAmt) AS "log_TransactionAmt" """
_FLOATS = ["hour_sin", "hour_cos", "dow_sin", "dow_cos", "hour_raw", "log_TransactionAmt"]


def _rounded_sql(names):
    return ", ".join(f'round(CAST(CAST("{n}" AS FLOAT) AS DOUBLE), 3) AS "{n}"' for n in names)


@query("features_time_amount", "txn", f"SELECT TransactionID, {_rounded_sql(_FLOATS)} FROM (SELECT *, {_TIME} FROM txn) t")
def features_time_amount(spark, sf_dir):
    return _doubles(X.time_and_amount(payments(spark, sf_dir))).select("TransactionID", *_FLOATS)


_GROUPS = f"""
WITH g AS (SELECT card1, count(TransactionID) AS n, avg(TransactionAmt) AS m FROM txn GROUP BY card1),
c AS (SELECT t.*, g.n AS card1_velocity, g.m AS card1_amt_mean, t.TransactionAmt - g.m AS amt_deviation
  FROM txn t JOIN g USING (card1))
SELECT TransactionID, card1_velocity, {_rounded_sql(["card1_amt_mean", "amt_deviation"])} FROM c"""


@query("card_group_features", "txn", _GROUPS)
def card_group_features(spark, sf_dir):
    return _doubles(X.card_groups(payments(spark, sf_dir))).select(
        "TransactionID", "card1_velocity", "card1_amt_mean", "amt_deviation")


@query("card_group_features_split", "txn", _GROUPS)
def card_group_features_split(spark, sf_dir):
    return _doubles(X.card_groups(payments(spark, sf_dir), limit=60)).select(
        "TransactionID", "card1_velocity", "card1_amt_mean", "amt_deviation")


_PROFILE = """p AS (SELECT card1, avg(TransactionAmt) AS profile_mean, coalesce(stddev_samp(TransactionAmt), 0) + 1e-6 AS profile_std,
  count(*) AS profile_count FROM {source} GROUP BY card1)"""


@query("card_profile", "txn", "WITH " + _PROFILE.format(source="txn") + """
SELECT card1, round(profile_mean, 9) AS profile_mean, round(profile_std, 6) AS profile_std, profile_count FROM p""")
def card_profile(spark, sf_dir):
    profile = X.card_profile(payments(spark, sf_dir))
    return profile.withColumns({"profile_mean": F.round("profile_mean", 9), "profile_std": F.round("profile_std", 6)})


_LOOKUP = SPLIT_SQL.format(source="txn").rstrip() + ",\n" + _PROFILE.format(source="s WHERE split = 'train'") + """
SELECT s.TransactionID, round(coalesce(profile_mean, TransactionAmt), 9) AS mean, coalesce(profile_count, 1) AS n
FROM s LEFT JOIN p ON s.card1 = p.card1 WHERE s.split = 'test'"""


def _looked_up(spark, sf_dir, **limit):
    parts = splits.parts(payments(spark, sf_dir))
    profile = X.card_profile(parts["train"])
    test = lookup(parts["test"], profile, ["card1"], **limit)
    return test.select("TransactionID", F.round(F.coalesce("profile_mean", "TransactionAmt"), 9).alias("mean"),
                       F.coalesce("profile_count", F.lit(1)).cast("long").alias("n"))


@query("profile_lookup", "txn", _LOOKUP)
def profile_lookup(spark, sf_dir):
    return _looked_up(spark, sf_dir)


@query("profile_lookup_split", "txn", _LOOKUP)
def profile_lookup_split(spark, sf_dir):
    return _looked_up(spark, sf_dir, limit=12)


@query("label_encode", "txn", "UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", v AS value, CAST(row_number() OVER (ORDER BY v) - 1 AS INT) AS code "
    f"FROM (SELECT DISTINCT coalesce({c}, '__nan__') AS v FROM txn) d\n" for c in CATEGORIES))
def label_encode(spark, sf_dir):
    return encode.fit_codes(payments(spark, sf_dir), CATEGORIES)


_FEATURES = CATEGORIES + ["card1", "addr1", "addr2", *X.DERIVED, *X.ADDRESS_FLAGS]


def _matrix_sql(test_rows, count, mean):
    """Features of ``test_rows`` with codes and profiles of the training rows, from scratch in SQL."""
    codes = ",\n".join(
        f"k{i} AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS code FROM "
        f"(SELECT DISTINCT coalesce({c}, '__nan__') AS v FROM s WHERE split = 'train') d)" for i, c in enumerate(CATEGORIES))
    joins = " ".join(f"LEFT JOIN k{i} ON k{i}.v = coalesce(m.{c}, '__nan__')" for i, c in enumerate(CATEGORIES))
    picks = ", ".join(f"CAST(coalesce(k{i}.code, -1) AS BIGINT) AS {c}" for i, c in enumerate(CATEGORIES))
    return SPLIT_SQL.format(source="txn").rstrip() + ",\n" + _PROFILE.format(source="s WHERE split = 'train'") + f""",
own AS (SELECT split AS os, card1 AS oc, count(*) AS own_count, avg(TransactionAmt) AS own_mean FROM s GROUP BY split, card1),
{codes},
m AS (SELECT s.*, {_TIME}, profile_mean, profile_count, own_count, own_mean FROM s LEFT JOIN p ON s.card1 = p.card1
  JOIN own ON own.os = s.split AND own.oc = s.card1 WHERE {test_rows}),
f AS (SELECT m.TransactionID, m.split, m.isFraud, {picks}, m.card1, coalesce(m.addr1, -1) AS addr1, coalesce(m.addr2, -1) AS addr2,
  {", ".join(f'm."{n}"' for n in _FLOATS)}, CAST({count} AS BIGINT) AS card1_velocity, {mean} AS card1_amt_mean,
  m.TransactionAmt - {mean} AS amt_deviation, CAST(m.addr1 IS NULL AS BIGINT) AS addr1_nullflag,
  CAST(m.addr2 IS NULL AS BIGINT) AS addr2_nullflag FROM m {joins})
SELECT TransactionID, {{label}}{", ".join(CATEGORIES)}, card1, round(addr1::DOUBLE, 3) AS addr1, round(addr2::DOUBLE, 3) AS addr2,
  card1_velocity, addr1_nullflag, addr2_nullflag, {_rounded_sql([*_FLOATS, "card1_amt_mean", "amt_deviation"])} FROM f"""


def _train_and_test(spark, sf_dir):
    parts = splits.parts(payments(spark, sf_dir))
    return parts["train"], parts["test"]


@query("feature_matrix", "txn", _matrix_sql("split = 'test'", "own_count", "own_mean").format(
    label="CAST(isFraud AS BIGINT) AS isFraud, "))
def feature_matrix(spark, sf_dir):
    train, test = _train_and_test(spark, sf_dir)
    return _doubles(X.build(test, X.fit(train)))


MATRIX_SQL = _matrix_sql("TRUE", "own_count", "own_mean").format(label="split, CAST(isFraud AS BIGINT) AS isFraud, ")
MATRIX_NAMES = _FEATURES


@query("feature_matrix_splits", "txn", MATRIX_SQL)
def feature_matrix_splits(spark, sf_dir):
    """The features of all three splits in one table."""
    parts = splits.parts(payments(spark, sf_dir))
    return _doubles(X.build_all(parts, X.fit(parts["train"])))


@query("serving_transform", "txn", _matrix_sql(
    "split = 'test'", "coalesce(profile_count, 1)", "coalesce(profile_mean, TransactionAmt)").format(label=""))
def serving_transform(spark, sf_dir):
    train, test = _train_and_test(spark, sf_dir)
    return _doubles(X.serve(test.drop("isFraud"), X.fit(train)))


@query("request_mapping", "txn", """
SELECT TransactionID, hour * 3600 + 9000000 AS TransactionDT, TransactionAmt, 'W' AS ProductCD, card1, card4, card6,
  P_emaildomain, DeviceType, tx_type FROM (SELECT *, TransactionDT // 3600 % 24 AS hour FROM txn) t""")
def request_mapping(spark, sf_dir):
    requests = view(spark, sf_dir, "txn").select(
        F.col("TransactionID").alias("request_id"), "tx_type", F.col("TransactionAmt").alias("amount"),
        F.col("card6").alias("card_type"), F.col("card4").alias("network"), F.col("P_emaildomain").alias("email"),
        F.col("DeviceType").alias("device"), (F.floor(F.col("TransactionDT") / 3600) % 24).alias("hour"),
        F.col("card1").alias("card_id"))
    return X.from_requests(requests)
