"""Streaming over the query log: how often chunks are used, by event-time windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.io import QUERY_LOG


def read_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.schema(QUERY_LOG).json(path).withColumn("ts", F.to_timestamp("timestamp"))


def usage(log: DataFrame, window: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """(window start, chunk_id, uses); rows later than ``late`` are dropped by the watermark."""
    used = log.withWatermark("ts", late).select("ts", F.explode("used_chunk_ids").alias("chunk_id"))
    return used.groupBy(F.window("ts", window), "chunk_id").agg(F.count("*").alias("uses")).select(F.col("window.start").alias("start"), "chunk_id", "uses")
