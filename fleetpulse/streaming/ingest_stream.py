"""Continuous ingest: each micro-batch of payloads is judged and stored by outcome."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from fleetpulse.functions.clock import instant
from fleetpulse.operators.ingest import judge, rejected
from fleetpulse.session import prepare
from fleetpulse.sources.tables import remove, store_batch


def stored_rows(judged: DataFrame, arrived=None) -> DataFrame:
    """Accepted rows as TELEMETRY: the id is a hash of the payload, so a replay gives the same row.

    ``created_at`` is ``arrived``, or the time of the batch.
    """
    kept = judged.where(F.col("reject_reason").isNull())
    row_id = F.xxhash64("agent_id", F.unix_micros("timestamp"), "payload").bitwiseAND(F.lit(2**63 - 1))
    at = F.current_timestamp() if arrived is None else instant(arrived)
    return kept.select(row_id.alias("id"), "agent_id", "timestamp", "metrics", at.alias("created_at"))


def start_ingest(
    payloads: DataFrame,
    load_agents: Callable[[], DataFrame],
    path: str,
    checkpoint: str,
    target: str | None = None,
    arrived=None,
    **trigger,
) -> StreamingQuery:
    """Writes accepted rows as telemetry to ``path/accepted``, by date, the others to ``path/rejected``.

    ``path/accepted`` is what ``read_telemetry``, the rollup, the alert stream and the purge read.
    Agents are loaded anew for each batch, so one registered meanwhile is known. A batch is decoded once, into
    ``path/_judged``, which is gone when both parts are written; one that is run again replaces what it wrote.
    """

    def store(batch: DataFrame, batch_id: int) -> None:
        spark, decoded = batch.sparkSession, judge(batch, load_agents(), target)
        prepare(spark)
        decoded.write.mode("overwrite").parquet(f"{path}/_judged")
        judged = spark.read.schema(decoded.schema).parquet(f"{path}/_judged")
        store_batch(stored_rows(judged, arrived), f"{path}/accepted", batch_id)
        rejected(judged).write.mode("overwrite").parquet(f"{path}/rejected/batch={batch_id}")
        remove(spark, f"{path}/_judged")

    return (
        payloads.writeStream.foreachBatch(store)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )
