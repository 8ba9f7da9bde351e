"""Stored tables: append-only telemetry, replaced-whole tables, and a database as source."""

from __future__ import annotations

import uuid
from datetime import datetime, time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetpulse.functions.clock import instant
from fleetpulse.session import prepare, scratch_dir

DATE = "event_date="
BATCH = "batch="
VERSION = "version="
# Names that readers skip: written to the end, set aside, being written.
READY, OLD, STAGE = "_ready-", "_old-", "_stage-"
DONE = "_SUCCESS"


def with_event_date(telemetry: DataFrame) -> DataFrame:
    return telemetry.withColumn("event_date", F.to_date("timestamp"))


def append_telemetry(telemetry: DataFrame, path: str) -> None:
    """Append rows under ``event_date=...``, clustered by agent and time within a date.

    The range partitioning includes the time, so a hot agent is cut over several files;
    the order inside files lets a scan skip row groups of other agents. ``metrics`` is
    stored shredded, so a later scan reads the JSON paths it names and no others.
    """
    prepare(telemetry.sparkSession)
    (
        with_event_date(telemetry)
        .repartitionByRange("event_date", "agent_id", "timestamp")
        .sortWithinPartitions("event_date", "agent_id", "timestamp")
        .write.mode("append")
        .partitionBy("event_date")
        .parquet(path)
    )


def store_batch(rows: DataFrame, path: str, batch_id: int) -> None:
    """Telemetry rows of one micro-batch, under ``event_date=.../batch=N``.

    A batch that is run again first takes away what it wrote before, and so replaces itself.
    """
    spark = rows.sparkSession
    prepare(spark)
    fs, at = _filesystem(spark, path)
    for found in fs.globStatus(at(f"{path}/{DATE}*/{BATCH}{batch_id}")) or []:
        fs.delete(found.getPath(), True)
    dated = with_event_date(rows).withColumn("batch", F.lit(batch_id))
    dated.sortWithinPartitions("event_date", "agent_id", "timestamp").write.mode("append").partitionBy("event_date", "batch").parquet(path)


def read_telemetry(spark: SparkSession, path: str, start=None, end=None) -> DataFrame:
    """Telemetry of a closed date range; other date folders are not listed into the scan."""
    rows = spark.read.parquet(path).drop("batch")
    if start is not None:
        rows = rows.where(F.col("event_date") >= F.lit(start).cast("date"))
    if end is not None:
        rows = rows.where(F.col("event_date") <= F.lit(end).cast("date"))
    return rows


def _filesystem(spark: SparkSession, path: str):
    """The file system of a path, and how to name its paths."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    return at(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder that a job wrote for itself."""
    fs, at = _filesystem(spark, path)
    fs.delete(at(path), True)


def _move(fs, source, target) -> None:
    if not fs.rename(source, target):
        raise OSError(f"{source} was not renamed to {target}")


def _aside(root: str, kind: str, name: str) -> str:
    """Where a partition folder stands aside; a name with = would be read as a partition."""
    return f"{root}/{kind}{name.replace('=', '~')}"


def replace_folder(spark: SparkSession, root: str, name: str, staged: str) -> None:
    """Put a folder that was written to the end in the place of ``root/name``.

    The old one is set aside, where readers skip it, until the new one stands. A stop at any
    step leaves one of the two complete, and ``recover`` finishes what was begun.
    """
    fs, at = _filesystem(spark, root)
    if not fs.exists(at(f"{staged}/{DONE}")):
        raise OSError(f"{staged} is not complete")
    ready, old, place = at(_aside(root, READY, name)), at(_aside(root, OLD, name)), at(f"{root}/{name}")
    _move(fs, at(staged), ready)
    if fs.exists(place):
        _move(fs, place, old)
    _move(fs, ready, place)
    fs.delete(old, True)


def recover(spark: SparkSession, root: str) -> None:
    """Finish replacements that were stopped: a folder that is ready takes its place, leftovers go."""
    fs, at = _filesystem(spark, root)
    if not fs.exists(at(root)):
        return
    names = [s.getPath().getName() for s in fs.listStatus(at(root))]
    for name in [n[len(READY) :].replace("~", "=") for n in names if n.startswith(READY)]:
        place, old = at(f"{root}/{name}"), at(_aside(root, OLD, name))
        if fs.exists(place) and not fs.exists(old):
            _move(fs, place, old)
        _move(fs, at(_aside(root, READY, name)), place)
    for status in fs.listStatus(at(root)):
        if status.getPath().getName().startswith((OLD, STAGE)):
            fs.delete(status.getPath(), True)


def _versions(spark: SparkSession, root: str) -> list[int]:
    """Versions written to the end; a half-written one has no marker and is passed over."""
    fs, at = _filesystem(spark, root)
    if not fs.exists(at(root)):
        return []
    found = fs.globStatus(at(f"{root}/{VERSION}*/{DONE}")) or []
    return sorted(int(s.getPath().getParent().getName()[len(VERSION) :]) for s in found)


def expire(spark: SparkSession, root: str, keep: int = 2) -> None:
    """Remove all but the newest complete versions of a table."""
    fs, at = _filesystem(spark, root)
    for old in _versions(spark, root)[:-keep]:
        fs.delete(at(f"{root}/{VERSION}{old}"), True)


def current(spark: SparkSession, root: str, below: int | None = None) -> DataFrame | None:
    """Newest complete version of a table, or the newest below a number; None before the first."""
    numbers = [n for n in _versions(spark, root) if below is None or n < below]
    return spark.read.parquet(f"{root}/{VERSION}{numbers[-1]}") if numbers else None


def publish(df: DataFrame, root: str, version: int | None = None, partition_by: list[str] | None = None) -> int:
    """Write a table whole as its next version. Readers of the old one are not disturbed.

    Writing a version again replaces it, so a repeated job leaves the same table.
    """
    if version is None:
        numbers = _versions(df.sparkSession, root)
        version = numbers[-1] + 1 if numbers else 1
    prepare(df.sparkSession)
    df.write.mode("overwrite").partitionBy(*(partition_by or [])).parquet(f"{root}/{VERSION}{version}")
    return version


def materialized(df: DataFrame, label: str) -> DataFrame:
    """The frame as a table in the shared scratch folder, for results that are read several times.

    Ids are hexadecimal text, which zstd stores in half the bytes of the default.
    """
    prepare(df.sparkSession)
    path = scratch_dir(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.parquet(path)


def read_database(
    spark: SparkSession, url: str, name: str, lower: int, upper: int, partitions: int, key: str = "id", **options: str
) -> DataFrame:
    """A database table read in key ranges, one task each."""
    return (
        spark.read.format("jdbc")
        .options(url=url, dbtable=name, partitionColumn=key, lowerBound=lower, upperBound=upper, numPartitions=partitions)
        .options(**options)
        .load()
    )


def purge_telemetry(spark: SparkSession, path: str, cutoff: datetime) -> None:
    """Remove stored rows before ``cutoff`` (UTC).

    Older dates go as whole folders. The date the cutoff falls into is rewritten beside
    its folder and then takes its place; a purge that was stopped is finished by the next one.
    """
    recover(spark, path)
    fs, at = _filesystem(spark, path)
    names = [s.getPath().getName() for s in fs.listStatus(at(path))]
    dates = [n[len(DATE) :] for n in names if n.startswith(DATE)]
    day = cutoff.date().isoformat()
    for old in [d for d in dates if d < day]:
        fs.delete(at(f"{path}/{DATE}{old}"), True)
    if day in dates and cutoff.time() != time.min:
        kept = spark.read.parquet(f"{path}/{DATE}{day}").where(F.col("timestamp") >= instant(cutoff))
        staged = f"{path}/{STAGE}{uuid.uuid4().hex}"
        kept.write.partitionBy(*[c for c in ["batch"] if c in kept.columns]).parquet(staged)
        replace_folder(spark, path, f"{DATE}{day}", staged)
