"""The registered queries of the corpus operators, with oracle SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from risklane.llm import binpacking, extract, licenses, merkle, mixing, neardup, oracles, packing, periods, quality, revisits, shards, toxicity, vectors
from risklane.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]


def tokenizer_path() -> str:
    """The vocabulary of the packing query; its place is known to the installed package."""
    import public_tokenizers
    return str(public_tokenizers.path("word_bpe_49k.json"))


def op1_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return revisits.resolve(revisits.captures(table(spark, sf_dir, "pages")))


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"))


def op4_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.extract(table(spark, sf_dir, "pages"))


def op5_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_vectors(table(spark, sf_dir, "embeddings"))


def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


def op7_feistel_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.shard_rows(table(spark, sf_dir, "documents"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_pack_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return merkle.audit(docs, merkle.without_line_ends(docs))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return periods.digests(periods.find(docs, periods.planted(docs)))


def op13_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return binpacking.pack(table(spark, sf_dir, "documents"), tokenizer_path())


def queries() -> dict[str, Query]:
    return {name: run for name, run in globals().items() if name.startswith("op") and callable(run)}


def oracle_sql() -> dict[str, str]:
    return {"op1_revisits": oracles.REVISITS, "op3_quality_rules": oracles.quality_sql(),
            "op5_near_vectors": oracles.NEAR_VECTORS, "op6_near_duplicates": oracles.NEAR_DUPLICATES,
            "op11_merkle_manifest": oracles.merkle_sql()}
