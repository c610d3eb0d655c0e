"""The chunk summary and event counts kept up to date over files as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.sources.readers import CHUNK


def stream_chunks(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.schema(CHUNK).option("multiLine", True).json(path)


def running_summary(chunks: DataFrame) -> DataFrame:
    """Sums and weighted rate per sample, for complete or update mode."""
    total, mapped = F.sum("demux.total_reads"), F.sum("demux.mapped_reads")
    return chunks.groupBy("sample_name").agg(F.count("*").alias("chunks"), total.alias("total_reads"), mapped.alias("mapped_reads"), F.round(F.coalesce(F.try_divide(mapped.cast("double"), total), F.lit(0.0)), 6).alias("barcode_mapping_rate"))


def running_histogram(chunks: DataFrame, side: str = "r1") -> DataFrame:
    return chunks.select(F.explode(f"trimming.{side}.adapter_position_histogram").alias("h")).groupBy("h.length").agg(F.sum("h.count").alias("count"))


def event_windows(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts and sums by type in tumbling windows; events later than `late` are dropped."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("window_start"), "event_type", "n", "total")


def event_sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Sessions of each user, closed by a gap."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n")).select(F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "user_id", "n")
