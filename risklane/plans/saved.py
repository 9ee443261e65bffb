"""The fitted chain on shared storage: what one session trained, another one loads and scores with.

A saved chain is a folder of tables. Codes and card profiles stay tables on both sides and never pass the driver; trees are bounded by
their number and depth. Doubles are kept as parquet, so that a loaded chain scores exactly like the one saved. ``done`` is written
last: a folder without it, left by a run that broke off, is not loaded. Nothing is ever overwritten.
"""

from __future__ import annotations

from dataclasses import fields

import numpy as np
import pandas as pd
from pyspark.ml.regression import IsotonicRegressionModel
from pyspark.sql import DataFrame, SparkSession, functions as F

from risklane.operators import boosting, features, forest
from risklane.plans.scoring import Chain
from risklane.plans.training import Models

NODES = "at long, feature int, cut double, left int, value double, cover double, gain double"
BRANCHES = "tree int, node int, feature int, threshold double, left int, right int, path double"
SETTINGS = ("kept array<string>, categories array<string>, names array<string>, code_sizes map<string,int>, threshold double, "
            "roots array<long>, margin double, features int, rows int, low double, high double, flag_above double")
TABLES = [field.name for field in fields(forest.Forest)][:5]


def save(chain: Chain, path: str, spark: SparkSession) -> None:
    """Write the chain to a new folder. A folder that exists already is an error."""
    fitted, models, trees = chain.fitted, chain.models, chain.forest
    booster = models.booster

    def write(df: DataFrame, name: str) -> None:
        df.write.mode("errorifexists").parquet(f"{path}/{name}")

    nodes = pd.DataFrame({"at": np.arange(len(booster.feature)), **{name: getattr(booster, name) for name in boosting.NODE}})
    at = np.indices(trees.feature.shape)
    branches = pd.DataFrame({"tree": at[0].ravel(), "node": at[1].ravel(), **{name: getattr(trees, name).ravel() for name in TABLES}})
    settings = (list(fitted.kept), list(fitted.categories), list(fitted.names), {c: int(n) for c, n in fitted.code_sizes.items()},
                float(models.threshold), [int(r) for r in booster.roots], float(booster.margin), int(booster.features),
                int(trees.rows), float(trees.low), float(trees.high), float(trees.flag_above))
    write(spark.createDataFrame([settings], SETTINGS), "settings")
    write(fitted.codes, "codes")
    write(fitted.profile, "profile")
    write(spark.createDataFrame(nodes, NODES), "booster")
    write(spark.createDataFrame(branches, BRANCHES), "forest")
    models.calibrator.save(f"{path}/calibrator")
    write(spark.range(1), "done")


def load(spark: SparkSession, path: str) -> Chain:
    """The chain that ``save`` wrote to ``path``."""
    spark.read.parquet(f"{path}/done")
    held = spark.read.parquet(f"{path}/settings").first()
    nodes = spark.read.parquet(f"{path}/booster").toPandas().sort_values("at", ignore_index=True)
    booster = boosting.Booster(
        np.array(held["roots"], np.int64), *[nodes[name].to_numpy(kind) for name, kind in zip(boosting.NODE, boosting.KINDS)],
        held["margin"], held["features"])
    branches = spark.read.parquet(f"{path}/forest").toPandas().sort_values(["tree", "node"], ignore_index=True)
    shape = (int(branches["tree"].max()) + 1, -1)
    trees = forest.Forest(**{name: branches[name].to_numpy().reshape(shape) for name in TABLES},
                          rows=held["rows"], low=held["low"], high=held["high"], flag_above=held["flag_above"])
    fitted = features.Fitted(held["kept"], held["categories"], spark.read.parquet(f"{path}/codes"), dict(held["code_sizes"]),
                             spark.read.parquet(f"{path}/profile"), held["names"])
    return Chain(fitted, Models(booster, IsotonicRegressionModel.load(f"{path}/calibrator"), held["threshold"]), trees)
