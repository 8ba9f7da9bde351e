"""Hourly rollup of raw telemetry, and its replacement in the stored rollup table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetpulse import model
from fleetpulse.functions import numbers as N
from fleetpulse.functions.clock import hour_of, instant

KEYS = ["agent_id", "bucket_start"]
MEASURES = ["cpu", "memory", "disk", "received", "sent"]


def closed_hours(telemetry: DataFrame, as_of) -> DataFrame:
    """Rows of hours that had ended at ``as_of``; a bare comparison, so the scan can prune."""
    return telemetry.where(F.col("timestamp") < hour_of(instant(as_of)))


def rollup_measures(telemetry: DataFrame, strict_cast: bool = False) -> DataFrame:
    """Scalars of each snapshot; no JSON goes past this projection into the shuffle."""
    m = F.col("metrics")
    return telemetry.select(
        "agent_id",
        "timestamp",
        N.sql_number(m, model.CPU_PATH, strict_cast).alias("cpu"),
        N.sql_number(m, model.MEMORY_PATH, strict_cast).alias("memory"),
        N.root_partition_percent(m, model.PARTITIONS_PATH, strict_cast).alias("disk"),
        N.sum_whole(m, model.INTERFACES_PATH, "bytes_recv", strict_cast).alias("received"),
        N.sum_whole(m, model.INTERFACES_PATH, "bytes_sent", strict_cast).alias("sent"),
    )


def rollup_aggregates() -> list[Column]:
    """Aggregates of one bucket; a measure without any value reads 0."""

    def or_zero(c: Column) -> Column:
        return F.coalesce(c, F.lit(0.0))

    return [
        or_zero(F.avg("cpu")).alias("cpu_avg"),
        or_zero(F.min("cpu")).alias("cpu_min"),
        or_zero(F.max("cpu")).alias("cpu_max"),
        or_zero(F.avg("memory")).alias("memory_avg"),
        or_zero(F.min("memory")).alias("memory_min"),
        or_zero(F.max("memory")).alias("memory_max"),
        or_zero(F.avg("disk")).alias("disk_avg"),
        F.coalesce(F.sum("received"), F.lit(0)).cast("bigint").alias("network_received"),
        F.coalesce(F.sum("sent"), F.lit(0)).cast("bigint").alias("network_sent"),
        F.count(F.lit(1)).alias("sample_count"),
    ]


def hourly_rollup(telemetry: DataFrame, as_of, strict_cast: bool = False) -> DataFrame:
    """One row per agent and closed hour. Partial aggregation bounds what a hot agent shuffles."""
    samples = rollup_measures(closed_hours(telemetry, as_of), strict_cast)
    return samples.groupBy("agent_id", hour_of(F.col("timestamp")).alias("bucket_start")).agg(
        *rollup_aggregates()
    )


def replace_rollup(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """Stored rollup with every freshly computed hour replaced whole."""
    return stored.join(fresh.select(*KEYS), KEYS, "left_anti").unionByName(fresh)
