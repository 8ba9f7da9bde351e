"""Chart points and per-agent summaries of the metrics JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetpulse import model
from fleetpulse.functions import numbers as N
from fleetpulse.functions.clock import instant, row_order
from fleetpulse.functions.conditions import range_length
from fleetpulse.operators.fleet import in_range, newest_rows


def points(telemetry: DataFrame) -> DataFrame:
    """Typed chart point of each snapshot; whatever is not a JSON number reads 0."""
    m = F.col("metrics")
    return telemetry.select(
        "agent_id",
        "id",
        "timestamp",
        N.number_or_zero(m, model.CPU_PATH).alias("cpu"),
        N.number_or_zero(m, model.MEMORY_PATH).alias("memory"),
        N.number_or_zero(m, model.DISK_PATH).alias("disk"),
        N.sum_bytes(m, model.INTERFACES_PATH, "bytes_recv").alias("bytes_received"),
        N.sum_bytes(m, model.INTERFACES_PATH, "bytes_sent").alias("bytes_sent"),
        N.clamped_whole(N.number_or_zero(m, model.PROCESSES_PATH)).alias("running_processes"),
    )


def chart_points(
    telemetry: DataFrame, time_range: str | None, as_of, max_points: int = model.SERIES_POINTS
) -> DataFrame:
    """Newest points per agent of the range that ends at ``as_of``, oldest first.

    Points are typed scalars before they are ranked, so no JSON is shuffled.
    """
    label, length = range_length(time_range)
    end = instant(as_of)
    wanted = in_range(telemetry, end - F.lit(length), end)
    return (
        newest_rows(points(wanted), max_points)
        .withColumn("range", F.lit(label))
        .orderBy("agent_id", "timestamp", "id")
        .drop("id")
    )


POINT_VALUES = ["cpu", "memory", "disk", "bytes_received", "bytes_sent", "running_processes"]


def downsampled_points(
    telemetry: DataFrame, time_range: str | None, as_of, max_points: int = model.SERIES_POINTS
) -> DataFrame:
    """The whole range in at most ``max_points`` points per agent, for charts of long ranges; oldest first.

    ``chart_points`` keeps the newest snapshots, which cover less than the range if an agent reports often. Here
    the range is cut into ``max_points`` slices of equal length; one with snapshots is a point
    with their number, the time of the last one, and of every value the least, the greatest and the last, so
    no extreme is lost. A snapshot at the very end of the range belongs to the last slice.

    Only typed scalars are aggregated, in fixed-width buffers with a partial step: a hot agent is a row per
    slice and task before anything is shuffled. Of snapshots with equal time and id any may be the last.
    """
    label, length = range_length(time_range)
    end = instant(as_of)
    begin = end - F.lit(length)
    span = F.unix_micros(end) - F.unix_micros(begin)
    slice_ = F.least(F.floor((F.unix_micros("timestamp") - F.unix_micros(begin)) * max_points / span), F.lit(max_points - 1)).cast("int")
    typed = points(in_range(telemetry, begin, end)).withColumns({"slice": slice_, "_order": row_order(F.col("timestamp"), F.col("id"))})
    found = typed.groupBy("agent_id", "slice").agg(
        F.count("*").alias("samples"),
        F.max("timestamp").alias("timestamp"),
        *[f(c).alias(f"{c}_{name}") for c in POINT_VALUES for f, name in ((F.min, "minimum"), (F.max, "maximum"))],
        *[F.max_by(c, "_order").alias(f"{c}_last") for c in POINT_VALUES],
    )
    return found.withColumn("range", F.lit(label)).orderBy("agent_id", "slice")


def statistics(name: str) -> list[Column]:
    """average / minimum / maximum of a column; NULL when it never had a sample."""
    return [
        F.avg(name).alias(f"{name}_average"),
        F.min(name).alias(f"{name}_minimum"),
        F.max(name).alias(f"{name}_maximum"),
    ]


def summary_measures(telemetry: DataFrame) -> DataFrame:
    m = F.col("metrics")
    return telemetry.select(
        "agent_id",
        row_order(F.col("timestamp"), F.col("id")).alias("_order"),
        N.present_or_zero(m, model.CPU_PATH).alias("cpu"),
        N.present_or_zero(m, model.MEMORY_PATH).alias("memory"),
        N.present_or_zero(m, model.PROCESSES_PATH).alias("processes"),
        F.try_element_at(N.disk_values(m, model.DISK_PATH, model.PARTITIONS_PATH), F.lit(1)).alias("disk"),
        N.sum_bytes(m, model.INTERFACES_PATH, "bytes_recv").alias("received"),
        N.sum_bytes(m, model.INTERFACES_PATH, "bytes_sent").alias("sent"),
    )


def metric_summary(telemetry: DataFrame) -> DataFrame:
    """Statistics per agent over all its snapshots, with the first disk value in time order.

    The order is NULL where a record has no disk value, and ``min_by`` passes over those.
    """
    measured = summary_measures(telemetry).withColumn("_order", F.when(F.col("disk").isNotNull(), F.col("_order")))
    return measured.groupBy("agent_id").agg(
        *statistics("cpu"),
        *statistics("memory"),
        *statistics("processes"),
        F.min_by("disk", "_order").alias("disk_current"),
        F.sum("received").alias("total_bytes_received"),
        F.sum("sent").alias("total_bytes_sent"),
    )
