"""Readers and writers for the file formats the jobs exchange."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from risklane.operators.shaping import CATEGORIES

# Core columns of a labelled transaction file.
CORE_TYPES = {
    "TransactionID": T.LongType(), "isFraud": T.ByteType(), "TransactionDT": T.LongType(),
    "TransactionAmt": T.DoubleType(), "ProductCD": T.StringType(), "card1": T.LongType(),
    "card4": T.StringType(), "card6": T.StringType(), "addr1": T.DoubleType(), "addr2": T.DoubleType(),
    "P_emaildomain": T.StringType(), "R_emaildomain": T.StringType(),
    "DeviceType": T.StringType(), "DeviceInfo": T.StringType(),
}


def read_transactions_csv(spark: SparkSession, path: str,
                          types: dict[str, T.DataType] | None = None) -> DataFrame:
    """CSV with a header; core columns, categories and ``types`` have declared types.

    One pass types the other columns: double if every value is a number, string if not. A value that does not fit the type
    of its column is an error, and never a null.
    """
    known = {**dict.fromkeys(CATEGORIES, T.StringType()), **CORE_TYPES, **(types or {})}
    text = spark.read.option("header", True).csv(path)
    open_ = [name for name in text.columns if name not in known]
    if open_:
        odd = text.agg(*[F.count_if(F.col(f"`{name}`").isNotNull() & F.expr(f"try_cast(`{name}` AS double)").isNull())
                         for name in open_]).first()
        known |= {name: T.StringType() if n else T.DoubleType() for name, n in zip(open_, odd)}
    schema = T.StructType([T.StructField(name, known[name]) for name in text.columns])
    return spark.read.schema(schema).option("header", True).option("mode", "FAILFAST").csv(path)


def read_columns(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """Parquet scan of the given columns only."""
    return spark.read.parquet(path).select(*columns)


def write_table(df: DataFrame, path: str, by: Sequence[str] = ()) -> None:
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*by) if by else writer).parquet(path)


def write_csv(df: DataFrame, path: str, one_file: bool = False) -> None:
    """CSV with a header. ``one_file`` is for reports of a few rows."""
    (df.coalesce(1) if one_file else df).write.mode("overwrite").csv(path, header=True)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_object(row: DataFrame, path: str) -> None:
    """A table of one row as one JSON object, a name and value per column. Nulls are written too."""
    row.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"})).coalesce(1).write.mode("overwrite").text(path)


def read_object(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The row that ``write_object`` wrote. A text that is no such object is an error; names it lacks are null."""
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.from_json("value", schema, {"mode": "FAILFAST"}).alias("row")).select("row.*")


def write_series(df: DataFrame, path: str, name: str, value: str, most: int | None = None) -> None:
    """(name, value) rows as one JSON object, greatest value first, of ``most`` entries; a report of a few hundred names."""
    ranked = F.sort_array(F.collect_list(F.struct((-F.col(value)).alias("rank"), F.col(name).alias("name"), F.col(value).alias("value"))))
    kept = F.slice(ranked, 1, most) if most else ranked
    entries = F.transform(kept, lambda e: F.struct(e["name"], e["value"]))
    df.agg(F.to_json(F.map_from_entries(entries))).write.mode("overwrite").text(path)


def read_series(spark: SparkSession, path: str) -> DataFrame:
    """(position, name, value) of a series, in the order of the file."""
    whole = spark.read.text(path, wholetext=True)
    series = F.from_json("value", "map<string,double>", {"mode": "FAILFAST"})
    return whole.select(F.posexplode(F.map_entries(series)).alias("position", "e")).select("position", "e.key", "e.value") \
        .toDF("position", "name", "value")


def write_list(spark: SparkSession, names: Sequence[str], path: str) -> None:
    """A JSON list of texts, in order."""
    one = spark.createDataFrame([(list(names),)], "names array<string>")
    one.select(F.to_json("names")).coalesce(1).write.mode("overwrite").text(path)


def read_list(spark: SparkSession, path: str) -> list[str]:
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.from_json("value", "array<string>", {"mode": "FAILFAST"}).alias("names")).first()["names"]


# The published layout of a router state: one text, payment type -> gateway -> arm.
ARM = ("struct<alpha:double,beta:double,posterior_mean:double,credible_interval_95:array<double>,n_trials:bigint,"
       "true_rate:double>")
ROUTER_STATE = f"map<string,map<string,{ARM}>>"


def nest_router_state(arms: DataFrame) -> DataFrame:
    """(tx_type, gateway, ...) rows, a few dozen at most, to one nested type -> gateway -> arm map.

    ``ci`` (two numbers) and ``rate`` are carried where the table has them.
    """
    def carried(name: str, kind: str):
        return F.col(name).cast(kind) if name in arms.columns else F.lit(None).cast(kind)

    arm = F.struct(F.col("alpha").cast("double").alias("alpha"), F.col("beta").cast("double").alias("beta"),
                   F.col("posterior_mean").cast("double").alias("posterior_mean"),
                   carried("ci", "array<double>").alias("credible_interval_95"),
                   F.col("n_trials").cast("long").alias("n_trials"), carried("rate", "double").alias("true_rate"))
    by_type = arms.groupBy("tx_type").agg(
        F.map_from_entries(F.collect_list(F.struct("gateway", arm))).alias("gateways"))
    return by_type.agg(F.map_from_entries(F.collect_list(F.struct("tx_type", "gateways"))).alias("state"))


def write_router_state(arms: DataFrame, path: str) -> None:
    nest_router_state(arms).select(F.to_json("state")).write.mode("overwrite").text(path)


def read_router_state(spark: SparkSession, path: str) -> DataFrame:
    """One row per arm; ``ci`` and ``rate`` are null where the file has none. A text that is no such state is an error."""
    whole = spark.read.text(path, wholetext=True)
    state = whole.select(F.from_json("value", ROUTER_STATE, {"mode": "FAILFAST"}).alias("state"))
    by_type = state.select(F.explode("state").alias("tx_type", "gateways"))
    return by_type.select("tx_type", F.explode("gateways").alias("gateway", "arm")).select(
        "tx_type", "gateway", "arm.alpha", "arm.beta", "arm.posterior_mean", F.col("arm.credible_interval_95").alias("ci"),
        "arm.n_trials", F.col("arm.true_rate").alias("rate"))
