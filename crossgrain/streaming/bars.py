"""Bars as a stream: files that arrive become deltas, and the batch factors run on each of them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery


def read_stream(spark: SparkSession, path: str, schema: str, late: str = "7 days") -> DataFrame:
    """New bars of a folder, each (date, code) once within the time that late rows may take. schema has ``ts``, a timestamp."""
    return spark.readStream.schema(schema).parquet(path).withWatermark("ts", late).dropDuplicatesWithinWatermark(["ts", "code"])


def run_stream(bars: DataFrame, checkpoint: str, step: Callable[[DataFrame, int], None]) -> StreamingQuery:
    """Calls step(batch, number) for what is there and ends; a restart goes on after the last finished batch."""
    return bars.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
