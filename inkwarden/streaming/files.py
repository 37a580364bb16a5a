"""Structured Streaming over arriving files with the same Column operators as in batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.replace import anonymize


def document_stream(spark: SparkSession, path: str, schema, per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(path)


def anonymize_stream(stream: DataFrame, out: str, checkpoint: str, strategy: str = "mask", types: list[str] | None = None) -> StreamingQuery:
    """Stateless: each micro-batch is the batch plan. Runs over what is there and ends."""
    rows = anonymize(stream, strategy, types).drop("spans")
    return rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def counts_by_window(stream: DataFrame, time: str = "ts", length: str = "1 hour", late: str = "10 minutes", by: str = "event_type") -> DataFrame:
    """Rows of each tumbling window and kind; rows later than the watermark are left out."""
    return stream.withWatermark(time, late).groupBy(F.window(time, length), by).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), by, "n")
