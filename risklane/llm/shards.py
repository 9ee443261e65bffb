"""Sharding by a Feistel permutation of global row numbers, in DataFrame expressions only.

Rows are numbered by (id, size, crc32). A keyed Feistel network over two unequal halves (Black and Rogaway,
"Ciphers with arbitrary finite domains") permutes a domain of at least n numbers; numbers past n walk on along
their cycle until they fall below n. The permuted number p of a row gives shard p mod k and slot p div k, so
shards differ by at most one row and every place can be computed from a row number alone.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from risklane.llm.common import let, spare_name
from risklane.operators.ordered import range_scan

ROUNDS = 6


def halves(rows: int) -> tuple[int, int]:
    """Sizes (a, b) of the two halves: a * b >= rows, with fewer than a numbers to spare."""
    a = max(1, math.isqrt(max(rows, 1) - 1) + 1)
    return a, max(1, -(-rows // a))


def feistel(number: Column, rows: int, seed: int) -> Column:
    """One pass of the network over the numbers below a * b. A bijection of them."""
    a, b = halves(rows)

    def round_of(pair: Column, index: int) -> Column:
        left, right = pair["l"], pair["r"]
        if index % 2:
            mixed = F.xxhash64(right + F.lit(b * (index + ROUNDS * seed)))
            return F.struct(F.pmod(left + F.pmod(mixed, F.lit(a)), F.lit(a)).alias("l"), right.alias("r"))
        mixed = F.xxhash64(left + F.lit(a * (index + ROUNDS * seed)))
        return F.struct(left.alias("l"), F.pmod(right + F.pmod(mixed, F.lit(b)), F.lit(b)).alias("r"))

    def rounds(pair: Column, index: int = 0) -> Column:
        return pair if index == ROUNDS else let(round_of(pair, index), lambda p: rounds(p, index + 1))

    start = F.struct(F.floor(number / F.lit(b)).cast("long").alias("l"), F.pmod(number, F.lit(b)).alias("r"))
    return let(start, lambda s: let(rounds(s), lambda p: p["l"] * F.lit(b) + p["r"]))


def longest_walk(spark: SparkSession, rows: int, seed: int) -> int:
    """Passes after which every number is below ``rows``: one, and as many as a spare number needs at most.

    About sqrt(rows) numbers are spare, and few of them meet another. Those on a cycle of spare numbers only, which no
    row enters, come back to their start and are left out.
    """
    a, b = halves(rows)
    passes = 1
    spare = spark.range(rows, a * b).select("id", F.col("id").alias("v"))
    while True:
        spare = spare.select("id", feistel(F.col("v"), rows, seed).alias("v")).filter((F.col("v") >= rows) & (F.col("v") != F.col("id")))
        passes += 1
        if spare.isEmpty():
            return passes


def permuted(number: Column, rows: int, seed: int, passes: int) -> Column:
    """The permuted row number, by cycle walking: a bijection of the numbers below ``rows``."""
    def walk(value: Column, left: int) -> Column:
        if left == 0:
            return value
        return let(F.when(value < rows, value).otherwise(feistel(value, rows, seed)), lambda v: walk(v, left - 1))

    return walk(feistel(number, rows, seed), passes - 1)


def shard_rows(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = 8,
               seed: int = 17) -> DataFrame:
    """Shard, slot, size and checksum per row; law ``rows``.

    A null or empty text has size 1 and checksum 0. Rows are numbered in the order of (id, size, checksum), null
    ids first; rows that agree in all three are interchangeable. Equal texts are spread like any others. An empty
    table gives an empty result. Other columns of ``df`` are ignored, whatever their names.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    thin = df.select(F.col(id_col).alias("doc_id"), (F.octet_length(text) + F.lit(1)).cast("long").alias("size"),
                     F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"))
    numbered = range_scan(thin, [], ["doc_id", "size", "text_crc32"], {"row": F.lit(1).cast("long")})
    rows = df.count()
    passes = longest_walk(df.sparkSession, rows, seed) if rows else 1
    place = spare_name(thin, "place")
    return numbered.withColumn(place, permuted(F.col("row"), rows, seed, passes)).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"),
        F.pmod(F.col(place), F.lit(shards)).cast("int").alias("shard"),
        F.floor(F.col(place) / F.lit(shards)).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"), F.col("row").alias("row_number"))
