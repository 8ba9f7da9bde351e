"""Late rows and the stored rollup: a ledger of touched hours, so that only those are computed again."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from fleetpulse.functions.clock import hour_of, instant
from fleetpulse.operators.joins import lookup
from fleetpulse.operators.retention import store_rollup
from fleetpulse.operators.rollup import KEYS, closed_hours, hourly_rollup
from fleetpulse.sources.tables import _filesystem, read_telemetry, recover, remove, store_batch

ENTRY = "batch="
LEDGER = "agent_id string, bucket_start timestamp"


def note_touched(rows: DataFrame, ledger: str, batch_id: int) -> None:
    """The (agent, hour) pairs of a micro-batch as ``ledger/batch=N``; a batch that comes again replaces its entry."""
    touched = rows.select("agent_id", hour_of(F.col("timestamp")).alias("bucket_start")).where("agent_id IS NOT NULL AND bucket_start IS NOT NULL").distinct()
    touched.write.mode("overwrite").parquet(f"{ledger}/{ENTRY}{batch_id}")


def start_store(telemetry: DataFrame, path: str, ledger: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Stores a telemetry stream by date and notes what each batch touches, the ledger first.

    A stop between the two leaves an entry for rows that are not there yet: they are computed again for
    nothing, while rows without an entry would be missed.
    """

    def store(batch: DataFrame, batch_id: int) -> None:
        note_touched(batch, ledger, batch_id)
        store_batch(batch, path, batch_id)

    return (
        telemetry.writeStream.foreachBatch(store)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def _entries(spark: SparkSession, ledger: str) -> list[str]:
    fs, at = _filesystem(spark, ledger)
    return sorted(s.getPath().toString() for s in fs.globStatus(at(f"{ledger}/{ENTRY}*")) or [])


def touched_rows(spark: SparkSession, telemetry_path: str, touched: DataFrame) -> DataFrame:
    """The stored snapshots of touched (agent, hour) pairs; other dates are not read.

    Only the dates go through the driver. The pairs are broadcast if they are measured small, else the rows of
    those dates are shuffled to them.
    """
    dates = [r[0] for r in touched.select(F.to_date("bucket_start")).distinct().collect()]
    rows = read_telemetry(spark, telemetry_path).where(F.col("event_date").isin(dates))
    return lookup(rows.withColumn("bucket_start", hour_of(F.col("timestamp"))), touched, KEYS, "left_semi").drop("bucket_start")


def patch_rollup(spark: SparkSession, telemetry_path: str, rollup_root: str, ledger: str, as_of: datetime, oldest: datetime | None = None) -> int:
    """Computes the touched hours that had ended at ``as_of`` again and puts them in the stored rollup; the pairs patched.

    Dates without a touched hour keep their files. Entries go when all their hours are in the rollup; one that
    still has an open hour stays and is done again later, which changes nothing. A stop at any step leaves
    the entries, so the next run does the same work. Hours before ``oldest``, whose raw rows a purge has
    taken in part, keep the rollup they have: what came late for them is left out.
    """
    recover(spark, telemetry_path)
    entries = _entries(spark, ledger)
    if not entries:
        return 0
    noted = spark.read.schema(LEDGER).parquet(*entries)
    ended = noted.where(F.col("bucket_start") < hour_of(instant(as_of)))
    if oldest is not None:
        ended = ended.where(F.col("bucket_start") >= instant(oldest))
    touched = ended.distinct()
    pairs = touched.count()
    if pairs:
        rows = closed_hours(touched_rows(spark, telemetry_path, touched), as_of)
        store_rollup(spark, rollup_root, hourly_rollup(rows, as_of))
    for entry in entries:
        if spark.read.schema(LEDGER).parquet(entry).where(F.col("bucket_start") >= hour_of(instant(as_of))).isEmpty():
            remove(spark, entry)
    return pairs
