"""A stream over files gives what the table gives."""

from __future__ import annotations

from conftest import SMALL
from pyspark.sql import functions as F

from midden import streaming


def test_windowed_rates(spark, tmp_path):
    events = spark.read.parquet(f"{SMALL}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    hit = F.col("event_type") == "error"
    query = streaming.windowed_rates(streaming.read_stream(spark, str(tmp_path / "in"), events), ["event_type"], hit).writeStream.format("memory").queryName("rates").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "state")).start()
    query.awaitTermination()
    got = sorted(map(tuple, spark.table("rates").collect()))
    assert got == sorted(map(tuple, streaming.windowed_rates(events, ["event_type"], hit).collect())) and got
