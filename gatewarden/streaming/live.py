"""The stateless part and failed logins over a stream of log files, with the batch functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.keyword import keyword_findings
from ..operators.parse import entries_of, parse_access_log


def stream_entries(spark: SparkSession, path: str) -> DataFrame:
    """Entries of new files in a folder; line numbers are not known in a stream."""
    lines = spark.readStream.text(path).select(F.col("_metadata.file_path").alias("file_path"), F.lit(None).cast("long").alias("line_number"), F.col("value").alias("content"))
    return entries_of(parse_access_log(lines))


def stream_keyword_findings(spark: SparkSession, path: str) -> DataFrame:
    return keyword_findings(stream_entries(spark, path))


def stream_failed_logins(entries: DataFrame, window: str = "5 minutes", slide: str = "1 minute", late: str = "10 minutes", threshold: int = 10) -> DataFrame:
    timed = entries.where("status IN (401, 403)").withColumn("event_time", F.col("ts").cast("timestamp")).withWatermark("event_time", late)
    return timed.groupBy("ip", F.window("event_time", window, slide)).agg(F.count("*").alias("failed")).where(F.col("failed") >= threshold)
