"""Structured Streaming ingest of layout elements."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

#: Deliveries come days or weeks late; state is kept so long.
LATENESS = "60 days"


def element_stream(spark: SparkSession, folder: str, schema: StructType, lateness: str = LATENESS) -> DataFrame:
    """New files of ``folder`` as a stream in which each ``(page_id, elem_idx)`` comes once.

    A repeated delivery is dropped if it comes within ``lateness`` of the first; the stream's checkpoint
    takes the place of a list of pages that are done.
    """
    rows = spark.readStream.schema(schema).parquet(folder)
    return rows.withWatermark("arrived_at", lateness).dropDuplicatesWithinWatermark(["page_id", "elem_idx"])


def ingest(spark: SparkSession, folder: str, schema: StructType, out: str, checkpoint: str) -> None:
    """Take in everything that has arrived, once, and stop."""
    q = element_stream(spark, folder, schema).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
