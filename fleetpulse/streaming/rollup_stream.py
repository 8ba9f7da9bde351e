"""Hourly rollup of a telemetry stream: an hour comes out once the watermark has passed it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from fleetpulse.operators.rollup import rollup_aggregates, rollup_measures

LATENESS = "10 minutes"


def hourly_rollup_stream(telemetry: DataFrame, lateness: str = LATENESS) -> DataFrame:
    """Same columns as the batch rollup. Rows later than ``lateness`` are left to the batch job."""
    return (
        rollup_measures(telemetry)
        .withWatermark("timestamp", lateness)
        .groupBy("agent_id", F.window("timestamp", "1 hour"))
        .agg(*rollup_aggregates())
        .withColumn("bucket_start", F.col("window.start"))
        .drop("window")
    )


def start_append(df: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Appends a stream to a Parquet table; without a trigger it takes what is there and ends."""
    return (
        df.writeStream.format("parquet")
        .outputMode("append")
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start(path)
    )
