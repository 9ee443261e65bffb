"""What the corpus operators share: word patterns, table paths, staging, native let-bindings."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager, nullcontext

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from risklane.staging import new_path

# Fixed value: a word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
# Fixed value: the ASCII white space that separates words.
GAP = r"[\x20\x09-\x0D]+"
# Bytes of whole texts that a Python worker is handed at once, as Arrow buffers in the executor and again as objects in the worker.
TEXT_BATCH = 4 << 20
ARROW_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@contextmanager
def batches_of(spark: SparkSession, most: int) -> Iterator[None]:
    """Python workers are handed rows in batches of about ``most`` bytes by the jobs that run inside."""
    usual = spark.conf.get(ARROW_BYTES, None)
    spark.conf.set(ARROW_BYTES, str(most))
    try:
        yield
    finally:
        if usual is None:
            spark.conf.unset(ARROW_BYTES)
        else:
            spark.conf.set(ARROW_BYTES, usual)


def stage(df: DataFrame, label: str, batch: int | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, so that lost executors cost no rerun of its plan.

    With ``batch``, its Python workers are handed about so many bytes of rows at once.
    """
    path = new_path(df.sparkSession, label)
    with batches_of(df.sparkSession, batch) if batch else nullcontext():
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shuffled(df: DataFrame) -> DataFrame:
    """``df`` as the right side of a join of which neither side is broadcast, whatever Spark takes their sizes to be.

    Spark sizes a table by its compressed file and counts an array as one element. So it takes exploded signatures, and staged
    rows that repeat, for a small part of what they are, and would broadcast them through the driver.
    """
    return df.hint("merge")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once per row, however often the body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def word_count(text: str | Column) -> Column:
    """Words of a text as long; a null text has none."""
    text = F.col(text) if isinstance(text, str) else text
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def words_of(text: Column) -> Column:
    """Array of the words of a text; empty for a null or blank text."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), GAP), lambda word: word != "")


def spare_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores in front until no column of ``df`` is called so (in any case)."""
    taken = {column.lower() for column in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name
