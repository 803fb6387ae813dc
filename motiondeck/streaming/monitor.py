"""Structured Streaming over landed landmark files: gated rows, windowed counts with a watermark, a sink of rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def landmark_stream(spark: SparkSession, path: str, schema: StructType, kind: str = "csv", files_per_batch: int = 100) -> DataFrame:
    """Rows of files as they land in a folder."""
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
    return reader.option("header", True).csv(path) if kind == "csv" else reader.parquet(path)


def windowed_counts(df: DataFrame, key: str, event_time: str, seen: str, late: str = "1 second", length: str = "1 second", hop: str = "500 milliseconds") -> DataFrame:
    """Rows and observed rows by key and window; rows later than the watermark are left out."""
    return df.withWatermark(event_time, late).groupBy(key, F.window(event_time, length, hop)).agg(F.count("*").alias("n_rows"), F.count_if(F.col(seen) > 0).alias("n_observed"))


def write_stream(df: DataFrame, path: str, checkpoint: str, mode: str = "append"):
    return df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
