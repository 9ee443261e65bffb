"""The corpus pipeline: rules, toxicity, near duplicates, mixing, packing.

Every stage takes (spark, docs, sf_dir) and works on all rows that the one before it kept. All but the last give rows with the
columns of ``docs``; the last gives the pieces of the packed sequences. Rows may repeat after mixing: that is the mix.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from risklane.llm import mixing, neardup, packing, quality, toxicity
from risklane.llm.common import ARROW_BYTES, TEXT_BATCH, batches_of, stage, table
from risklane.llm.queries import tokenizer_path

# Fitting a classifier, hashing sets and filling sequences have no SQL form.
ORACLE_SQL = None


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base check and the threshold table."""
    return quality.kept_rows(docs)


def nontoxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents below the toxicity threshold of their language; the model is fitted on labelled documents of this stage.

    What it returns is scored when it is written, so its batch size is set for the session; ``run`` sets it back.
    """
    spark.conf.set(ARROW_BYTES, str(TEXT_BATCH))
    return toxicity.clean_rows(docs, toxicity.learned(docs, table(spark, sf_dir, "labels")))


def distinct_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return neardup.one_of_each(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the target weights of their sources ask for."""
    return mixing.mixed_rows(docs)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the packed training sequences."""
    return packing.pack(docs, tokenizer_path())


STAGES = [("rules", rules), ("toxicity", nontoxic), ("near_duplicates", distinct_texts), ("mixing", mixture),
          ("packing", sequences)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    with batches_of(spark, TEXT_BATCH):
        for name, step in STAGES[:-1]:
            docs = stage(step(spark, docs, sf_dir), name)
        return STAGES[-1][1](spark, docs, sf_dir)
