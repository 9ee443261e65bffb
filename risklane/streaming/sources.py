"""Streams of payment events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from risklane.session import pin_utc
from risklane.sources.views import DIALECT, VIEWS


def event_stream(spark: SparkSession, folder: str, files: str = "*.parquet",
                 files_per_trigger: int | None = None) -> DataFrame:
    """The event files of a folder as a stream; the schema is that of the files already there."""
    pin_utc(spark)
    schema = spark.read.option("pathGlobFilter", files).parquet(folder).schema
    reader = spark.readStream.schema(schema).option("pathGlobFilter", files)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(folder)


def payments(events: DataFrame) -> DataFrame:
    """The payment view over an event stream, with its event time."""
    text = VIEWS["txn"][1].format(**DIALECT["spark"]).replace("FROM events", "FROM {events}")
    with_time = text.replace("SELECT event_id AS", "SELECT CAST(ts AS timestamp) AS ts, event_id AS", 1)
    return events.sparkSession.sql(with_time, events=events)


def from_payments(name: str, payments: DataFrame) -> DataFrame:
    """A view that reads only payments, over a stream of them or one micro-batch."""
    return payments.sparkSession.sql(VIEWS[name][1].replace("FROM txn", "FROM {txn}"), txn=payments)
