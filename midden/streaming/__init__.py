"""Streams of reads: the additive sums of the damage operators, kept up by Structured Streaming.

The binning domain has no streams of its own; these are the operators whose sums are additive.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.damage import smoothed_rate


def read_stream(spark: SparkSession, path: str, like: DataFrame, files_a_trigger: int = 8) -> DataFrame:
    """New Parquet files of a folder, with the schema of `like`."""
    return spark.readStream.schema(like.schema).option("maxFilesPerTrigger", files_a_trigger).parquet(path)


def windowed_rates(reads: DataFrame, by: list[str], hit, time: str = "ts", window: str = "1 day", late: str = "2 days") -> DataFrame:
    """(by, start, k, n, rate) per event-time window; rows later than the watermark are dropped. Works on tables and streams."""
    sums = reads.withWatermark(time, late).groupBy(*by, F.window(time, window).alias("w")).agg(F.count_if(hit).alias("k"), F.count(F.lit(1)).alias("n"))
    return sums.select(*by, F.col("w.start").alias("start"), "k", "n", smoothed_rate(F.col("k"), F.col("n")).alias("rate"))


def first_reads(reads: DataFrame, key: str, time: str = "ts", late: str = "2 days") -> DataFrame:
    """Each key once within the watermark: state is bounded by it."""
    return reads.withWatermark(time, late).dropDuplicatesWithinWatermark([key])
