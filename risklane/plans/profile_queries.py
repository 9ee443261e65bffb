"""Registered profiling, splitting and shaping queries, and the file round trips."""

from __future__ import annotations

from pyspark.sql import functions as F, types as T

from risklane.operators import profile as P, routing as R, shaping as S, splits
from risklane.plans.registry import query
from risklane.sources import files
from risklane.sources.views import view
from risklane.staging import new_path

DIMS = ["ProductCD", "card4", "card6", "DeviceType"]


@query("dataset_summary", "txn", """
SELECT count(*) AS total, CAST(sum(isFraud) AS BIGINT) AS fraud_count,
  CAST(count(*) - sum(isFraud) AS BIGINT) AS legit_count, round(avg(isFraud) * 100, 2) AS fraud_pct,
  round(avg(TransactionAmt), 2) AS avg_amt, round(median(TransactionAmt), 2) AS med_amt,
  round((count(*) - sum(isFraud)) / sum(isFraud), 1) AS imbalance FROM txn""")
def dataset_summary(spark, sf_dir):
    return P.summary(view(spark, sf_dir, "txn"))


_NULLS = "UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", round(avg(CASE WHEN {c} IS NULL THEN 1.0::DOUBLE ELSE 0 END) * 100, 4) AS null_pct FROM txn\n"
    for c in ["TransactionID", "TransactionDT", "TransactionAmt", "cents", "card1", "ProductCD", "card4", "card6",
              "P_emaildomain", "DeviceType", "addr1", "addr2", "sparse1", "tx_type", "isFraud", "event_type"])


@query("null_rates", "txn", _NULLS)
def null_rates(spark, sf_dir):
    return P.null_rates(view(spark, sf_dir, "txn"))


@query("mostly_null", "txn", f"""SELECT * FROM ({_NULLS}) n WHERE null_pct > 40
ORDER BY null_pct DESC, "column" LIMIT 20""")
def mostly_null(spark, sf_dir):
    return P.mostly_null(view(spark, sf_dir, "txn"))


@query("amount_describe", "txn", """
SELECT count(TransactionAmt) AS n, round(avg(TransactionAmt), 6) AS mean, round(stddev_samp(TransactionAmt), 6) AS std,
  min(TransactionAmt) AS min, max(TransactionAmt) AS max, round(quantile_cont(TransactionAmt, 0.25), 6) AS p25,
  round(quantile_cont(TransactionAmt, 0.5), 6) AS p50, round(quantile_cont(TransactionAmt, 0.75), 6) AS p75 FROM txn""")
def amount_describe(spark, sf_dir):
    return P.describe_amounts(view(spark, sf_dir, "txn"))


@query("class_amounts", "txn", """
SELECT isFraud, round(avg(TransactionAmt), 4) AS mean_amt, round(median(TransactionAmt), 4) AS median_amt
FROM txn GROUP BY isFraud""")
def class_amounts(spark, sf_dir):
    return P.amounts_by_class(view(spark, sf_dir, "txn"))


@query("class_counts", "txn", """
SELECT isFraud, count(*) AS n, round(count(*) * 100 / sum(count(*)) OVER (), 4) AS pct FROM txn GROUP BY isFraud""")
def class_counts(spark, sf_dir):
    return P.class_counts(view(spark, sf_dir, "txn"))


@query("rate_by_dims", "txn", "UNION ALL ".join(
    f"SELECT '{d}' AS dim, {d} AS value, count(*) AS n, round(avg(isFraud) * 100, 2) AS fraud_pct "
    f"FROM txn WHERE {d} IS NOT NULL GROUP BY {d}\n" for d in DIMS))
def rate_by_dims(spark, sf_dir):
    return P.rates_by_dims(view(spark, sf_dir, "txn"), DIMS)


@query("rate_by_email_topk", "txn", """
SELECT P_emaildomain, count(*) AS n, round(avg(isFraud) * 100, 2) AS fraud_pct FROM txn
WHERE P_emaildomain IS NOT NULL GROUP BY P_emaildomain HAVING count(*) > 500
ORDER BY avg(isFraud) DESC, P_emaildomain LIMIT 8""")
def rate_by_email_topk(spark, sf_dir):
    return P.riskiest(view(spark, sf_dir, "txn"), "P_emaildomain", 500, 8)


@query("rate_by_amount_bucket", "txn", """
SELECT band, count(*) AS n, round(avg(isFraud) * 100, 2) AS fraud_pct FROM (SELECT isFraud,
  CASE WHEN TransactionAmt <= 0 THEN NULL WHEN TransactionAmt <= 50 THEN '₹0-50' WHEN TransactionAmt <= 100 THEN '₹51-100'
    WHEN TransactionAmt <= 500 THEN '₹101-500' WHEN TransactionAmt <= 1000 THEN '₹501-1k'
    WHEN TransactionAmt <= 50000 THEN '₹1k+' END AS band FROM txn) t
WHERE band IS NOT NULL GROUP BY band""")
def rate_by_amount_bucket(spark, sf_dir):
    return P.rates_by_amount(view(spark, sf_dir, "txn"))


_CORR = ["TransactionAmt", "addr1", "addr2", "sparse1", "card1"]


@query("label_corr", "txn", "UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", round(corr(CAST({c} AS DOUBLE), CAST(isFraud AS DOUBLE)), 4) AS corr FROM txn\n"
    for c in _CORR))
def label_corr(spark, sf_dir):
    return P.correlations(view(spark, sf_dir, "txn"), _CORR)


_TYPE = """CASE WHEN lo >= -128 AND hi <= 127 THEN 'tinyint' WHEN lo >= -32768 AND hi <= 32767 THEN 'smallint'
  WHEN lo >= -2147483648 AND hi <= 2147483647 THEN 'int' ELSE 'bigint' END"""


@query("smallest_types", "", "UNION ALL ".join(
    [f"SELECT '{c}' AS \"column\", {_TYPE} AS type, lo AS low, hi AS high FROM (SELECT CAST(min({c}) AS DOUBLE) AS lo,"
     f" CAST(max({c}) AS DOUBLE) AS hi FROM lineitem) t\n"
     for c in ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]]
    + [f"SELECT '{c}' AS \"column\", 'float' AS type, min({c}) AS low, max({c}) AS high FROM lineitem\n"
       for c in ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]]))
def smallest_types(spark, sf_dir):
    lineitem = view(spark, sf_dir, "lineitem")
    chosen = P.smallest_types(lineitem)
    spans = lineitem.agg(*[f(c).cast("double").alias(f"{f.__name__}_{c}") for c in chosen for f in (F.min, F.max)])
    rows = F.array(*[
        F.struct(F.lit(c).alias("column"), F.lit(kind.simpleString()).alias("type"),
                 F.col(f"min_{c}").alias("low"), F.col(f"max_{c}").alias("high")) for c, kind in chosen.items()])
    return spans.select(F.explode(rows).alias("r")).select("r.*")


@query("narrowed_table", "", """
SELECT l_returnflag, CAST(sum(l_orderkey) AS BIGINT) AS keys, CAST(sum(l_linenumber) AS BIGINT) AS lines,
  round(sum(CAST(CAST(l_quantity AS FLOAT) AS DOUBLE)), 2) AS quantity FROM lineitem GROUP BY l_returnflag""")
def narrowed_table(spark, sf_dir):
    return P.narrow(view(spark, sf_dir, "lineitem")).groupBy("l_returnflag").agg(
        F.sum(F.col("l_orderkey").cast("long")).alias("keys"),
        F.sum(F.col("l_linenumber").cast("long")).alias("lines"),
        F.round(F.sum(F.col("l_quantity").cast("double")), 2).alias("quantity"))


# Positions are cut at int(n * 0.70) and int(n * 0.85), formed in floating point as the split does.
SPLIT_SQL = """
WITH r AS (SELECT *, row_number() OVER (ORDER BY TransactionDT, TransactionID) - 1 AS rn, count(*) OVER () AS n
  FROM {source}),
s AS (SELECT *, CASE WHEN rn < CAST(floor(n * 0.70::DOUBLE) AS BIGINT) THEN 'train'
  WHEN rn < CAST(floor(n * (0.70::DOUBLE + 0.15::DOUBLE)) AS BIGINT) THEN 'val' ELSE 'test' END AS split FROM r)
"""
_SPLIT_SUMMARY = """SELECT split, count(*) AS n, round(avg(isFraud) * 100, 2) AS fraud_pct,
  min(TransactionDT) AS first_dt, max(TransactionDT) AS last_dt FROM s GROUP BY split"""


@query("chrono_split_summary", "txn", SPLIT_SQL.format(source="txn") + _SPLIT_SUMMARY)
def chrono_split_summary(spark, sf_dir):
    return splits.split_summary(splits.with_split(view(spark, sf_dir, "txn")))


@query("chrono_split_ties", "txn_orders", SPLIT_SQL.format(source="txn_orders") + _SPLIT_SUMMARY)
def chrono_split_ties(spark, sf_dir):
    return splits.split_summary(splits.with_split(view(spark, sf_dir, "txn_orders"), limit=50))


@query("chrono_split_rows", "txn_orders", SPLIT_SQL.format(source="txn_orders")
       + "SELECT TransactionID, split FROM s")
def chrono_split_rows(spark, sf_dir):
    return splits.with_split(view(spark, sf_dir, "txn_orders")).select("TransactionID", "split")


@query("time_batches", "txn_orders", """
SELECT batch, count(*) AS n, min(TransactionDT) AS first_dt, max(TransactionDT) AS last_dt,
  CAST(sum(TransactionID) AS BIGINT) AS ids
FROM (SELECT *, CAST(rn // (n // 7) + 1 AS INT) AS batch FROM (SELECT *, count(*) OVER () AS n,
  row_number() OVER (ORDER BY TransactionDT, TransactionID) - 1 AS rn FROM txn_orders) a) b
WHERE batch <= 7 GROUP BY batch""")
def time_batches(spark, sf_dir):
    return splits.with_batch(view(spark, sf_dir, "txn_orders"), 7, limit=100).groupBy("batch").agg(
        F.count(F.lit(1)).alias("n"), F.min("TransactionDT").alias("first_dt"),
        F.max("TransactionDT").alias("last_dt"), F.sum("TransactionID").alias("ids"))


@query("null_policy", "txn", """
SELECT TransactionID, isFraud, card1, CAST(coalesce(addr1, -1) AS DOUBLE) AS addr1, CAST(coalesce(addr2, -1) AS DOUBLE) AS addr2,
  CAST(addr1 IS NULL AS INT) AS addr1_nullflag, CAST(addr2 IS NULL AS INT) AS addr2_nullflag,
  CAST(coalesce(nullif(card1 % 3, 0), -999) AS BIGINT) AS gap, -999 AS unseen
FROM txn""")
def null_policy(spark, sf_dir):
    txn = view(spark, sf_dir, "txn").withColumn("gap", F.nullif(F.col("card1") % 3, F.lit(0).cast("long")))
    shaped = txn.drop(*S.sparse_columns(txn))
    shaped = S.fill_numbers(S.flag_addresses(shaped))
    wanted = [c for c in ["card1", "addr1", "addr2", "addr1_nullflag", "addr2_nullflag", "gap", "sparse1", "unseen"]
              if c != "sparse1" or c in shaped.columns]
    return S.align(shaped, wanted, keep=["TransactionID", "isFraud"]).withColumns(
        {c: F.col(c).cast("double") for c in ("addr1", "addr2")}
        | {c: F.col(c).cast("int") for c in ("addr1_nullflag", "addr2_nullflag")})


@query("sparse_columns", "txn", "SELECT CAST(count(*) FILTER (WHERE sparse1 IS NULL) AS DOUBLE) / count(*) > 0.8 AS "
       "sparse1, CAST(count(*) FILTER (WHERE addr1 IS NULL) AS DOUBLE) / count(*) > 0.8 AS addr1 FROM txn")
def sparse_columns(spark, sf_dir):
    txn = view(spark, sf_dir, "txn")
    sparse = S.sparse_columns(txn)
    return txn.agg(*[F.lit(c in sparse).alias(c) for c in ("sparse1", "addr1")])


@query("balanced_sample", "txn", """
SELECT * FROM (SELECT TransactionID, isFraud, TransactionAmt FROM txn WHERE isFraud = 1 ORDER BY TransactionID LIMIT 50) a
UNION ALL
SELECT * FROM (SELECT TransactionID, isFraud, TransactionAmt FROM txn WHERE isFraud = 0 ORDER BY TransactionID LIMIT 50) b""")
def balanced_sample(spark, sf_dir):
    return S.first_of_each_class(view(spark, sf_dir, "txn"), 50).select("TransactionID", "isFraud", "TransactionAmt")


@query("hash_sample")
def hash_sample(spark, sf_dir):
    return S.hash_sample(view(spark, sf_dir, "txn").select("TransactionID", "TransactionAmt", "isFraud"), 300)


@query("identity_left_join", "txn_orders identity", """
SELECT t.TransactionID, t.TransactionDT, t.cents, t.isFraud, i.id_01, i.DeviceInfo
FROM txn_orders t LEFT JOIN identity i ON t.TransactionID = i.TransactionID""")
def identity_left_join(spark, sf_dir):
    payments = view(spark, sf_dir, "txn_orders").drop("card1")
    return payments.join(view(spark, sf_dir, "identity"), "TransactionID", "left")


# Text columns of the real files, made from the ids, beside all columns of the view.
_CSV_TEXT = [
    "CASE TransactionID % 3 WHEN 0 THEN 'T' WHEN 1 THEN 'F' END AS M1", "'M' || (TransactionID % 3) AS M4",
    "CASE TransactionID % 4 WHEN 0 THEN 'NotFound' ELSE 'Found' END AS id_12",
    "'chrome ' || (TransactionID % 7) || '.0' AS id_31", "'x' || TransactionID AS note"]


@query("csv_roundtrip", "txn", f"SELECT *, {', '.join(_CSV_TEXT)} FROM txn")
def csv_roundtrip(spark, sf_dir):
    path = new_path(spark, "csv")
    payments = view(spark, sf_dir, "txn").selectExpr("*", *_CSV_TEXT)
    files.write_csv(payments, path)
    return files.read_transactions_csv(spark, path).select(
        *[F.col(f.name).cast(f.dataType).alias(f.name) for f in payments.schema])


@query("parquet_roundtrip", "txn", SPLIT_SQL.format(source="txn") + "SELECT TransactionID, cents, split FROM s")
def parquet_roundtrip(spark, sf_dir):
    path = new_path(spark, "splits")
    files.write_table(splits.with_split(view(spark, sf_dir, "txn")), path, by=["split"])
    return files.read_columns(spark, path, ["TransactionID", "cents", "split"])


@query("json_state_roundtrip", "outcomes rates", """
SELECT tx_type, gateway, CAST(1 + sum(success) AS DOUBLE) AS alpha, CAST(1 + count(*) - sum(success) AS DOUBLE) AS beta,
  round((1 + sum(success))::DOUBLE / (2 + count(*)), 4) AS posterior_mean, count(*) AS n_trials, any_value(rate)::DOUBLE AS rate
FROM outcomes JOIN rates USING (tx_type, gateway) GROUP BY tx_type, gateway""")
def json_state_roundtrip(spark, sf_dir):
    path = new_path(spark, "router")
    arms = R.posterior(view(spark, sf_dir, "outcomes")).withColumn("posterior_mean", F.round("posterior_mean", 4))
    files.write_router_state(R.with_interval(arms).join(view(spark, sf_dir, "rates"), R.ARM), path)
    back = files.read_router_state(spark, path)
    inside = (F.col("ci")[0] < F.col("posterior_mean")) & (F.col("posterior_mean") < F.col("ci")[1])
    return back.filter(inside).drop("ci")


@query("report_csv", "txn", """
SELECT ProductCD, count(*) AS n, round(avg(isFraud) * 100, 2) AS fraud_pct FROM txn GROUP BY ProductCD""")
def report_csv(spark, sf_dir):
    path = new_path(spark, "report")
    rates = view(spark, sf_dir, "txn").groupBy("ProductCD").agg(
        F.count(F.lit(1)).alias("n"), P.rate("isFraud").alias("fraud_pct"))
    files.write_csv(rates, path, one_file=True)
    return files.read_transactions_csv(spark, path, {"n": T.LongType()})


@query("union_logs", "outcomes", """
SELECT step, 'A' AS source, success FROM outcomes WHERE policy = 'A'
UNION ALL SELECT step, 'B' AS source, success FROM outcomes WHERE policy = 'B'
UNION ALL SELECT step, 'C' AS source, success FROM outcomes WHERE policy = 'C'""")
def union_logs(spark, sf_dir):
    log = view(spark, sf_dir, "outcomes")
    parts = [log.filter(F.col("policy") == p).select("step", F.lit(p).alias("source"), "success") for p in ("A", "B", "C")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("distinct_values", "txn", """
SELECT DISTINCT card4, card6 FROM txn""")
def distinct_values(spark, sf_dir):
    return view(spark, sf_dir, "txn").select("card4", "card6").distinct()


@query("top_k", "txn", """
SELECT TransactionID, TransactionAmt FROM txn ORDER BY TransactionAmt DESC, TransactionID LIMIT 25""")
def top_k(spark, sf_dir):
    return view(spark, sf_dir, "txn").select("TransactionID", "TransactionAmt") \
        .orderBy(F.desc("TransactionAmt"), "TransactionID").limit(25)
