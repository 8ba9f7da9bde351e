"""The retention job: bring the rollup up to date, then drop old raw rows."""

from __future__ import annotations

import uuid
from datetime import datetime, timedelta, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetpulse import model
from fleetpulse.functions.clock import hour_of, instant
from fleetpulse.operators.rollup import hourly_rollup, replace_rollup
from fleetpulse.sources.tables import DONE, STAGE, _filesystem, materialized, purge_telemetry, read_telemetry, recover, replace_folder

DAY = "bucket_date="


def cutoff_time(as_of: datetime, days: int = model.RETENTION_DAYS, align: str = "exact") -> datetime:
    """Oldest time kept; see ``maintenance.cutoff``."""
    moment = as_of if as_of.tzinfo else as_of.replace(tzinfo=timezone.utc)
    oldest = moment.astimezone(timezone.utc) - timedelta(days=days if days > 0 else model.RETENTION_DAYS)
    return oldest.replace(minute=0, second=0, microsecond=0) if align == "hour" else oldest


def read_rollup(spark: SparkSession, root: str) -> DataFrame | None:
    """The stored rollup; None before the first run."""
    recover(spark, root)
    fs, at = _filesystem(spark, root)
    if not fs.globStatus(at(f"{root}/{DAY}*")):
        return None
    return spark.read.parquet(root)


def store_rollup(spark: SparkSession, root: str, fresh: DataFrame) -> None:
    """Replace the hours of ``fresh`` in the stored rollup; only the dates they lie in are rewritten.

    The new dates are written whole beside the table, then change places with the old ones.
    """
    stored = read_rollup(spark, root)
    dated = materialized(fresh.withColumn(DAY[:-1], F.to_date("bucket_start")), "rollup")
    days = [r[0] for r in dated.select(DAY[:-1]).distinct().collect()]
    if not days:
        return
    if stored is not None:
        dated = replace_rollup(stored.where(F.col(DAY[:-1]).isin(days)).select(dated.columns), dated)
    staged = f"{root}/{STAGE}{uuid.uuid4().hex}"
    dated.repartition(DAY[:-1], "agent_id").write.partitionBy(DAY[:-1]).parquet(staged)
    fs, at = _filesystem(spark, root)
    for day in days:
        folder = f"{staged}/{DAY}{day.isoformat()}"
        fs.create(at(f"{folder}/{DONE}"), True).close()
        replace_folder(spark, root, f"{DAY}{day.isoformat()}", folder)
    fs.delete(at(staged), True)


def run_retention(
    spark: SparkSession,
    telemetry_path: str,
    rollup_root: str,
    as_of: datetime,
    days: int = model.RETENTION_DAYS,
    align: str = "exact",
    since: datetime | None = None,
    follow: timedelta | None = None,
) -> None:
    """Roll up closed hours of the raw table, store them, then purge.

    A failed rollup ends the job before anything is purged, and a job that was stopped is
    finished by the next. All hours still in the raw table are rolled up again, unless ``since`` names
    the first, or ``follow`` says how far before the last stored hour late rows are still looked for.
    """
    if follow is not None and since is None and (stored := read_rollup(spark, rollup_root)) is not None:
        last = stored.agg(F.max("bucket_start").cast("timestamp_ntz")).first()[0]
        since = None if last is None else last.replace(tzinfo=timezone.utc) - follow
    recover(spark, telemetry_path)
    raw = read_telemetry(spark, telemetry_path)
    if since is not None:
        raw = raw.where(F.col("event_date") >= F.to_date(instant(since)))
        raw = raw.where(F.col("timestamp") >= hour_of(instant(since)))
    store_rollup(spark, rollup_root, hourly_rollup(raw, as_of))
    purge_telemetry(spark, telemetry_path, cutoff_time(as_of, days, align))
