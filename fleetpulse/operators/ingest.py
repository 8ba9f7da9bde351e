"""Telemetry ingest: judge payloads, check the agent, split accepted from rejected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetpulse.functions.clock import instant
from fleetpulse.operators.joins import lookup
from fleetpulse.sources.payloads import decode

UNKNOWN_AGENT = "agent_not_found"


def known_agents(rows: DataFrame, agents: DataFrame, known: bool = True) -> DataFrame:
    """Rows whose agent exists, or with ``known=False`` those whose agent does not."""
    ids = agents.select(F.col("id").alias("agent_id"))
    return lookup(rows, ids, ["agent_id"], "left_semi" if known else "left_anti")


def judge(payloads: DataFrame, agents: DataFrame, target: str | None = None) -> DataFrame:
    """Decoded payloads with the reason each one is rejected for, NULL when it is accepted.

    Agents are matched by one left join, so the payloads are decoded once for both outcomes.
    """
    decoded = decode(payloads, target)
    registered = agents.select(F.col("id").alias("agent_id"), F.lit(True).alias("_known"))
    missing = F.when(F.col("_known").isNull(), UNKNOWN_AGENT)
    return (
        lookup(decoded, registered, ["agent_id"], "left")
        .withColumn("reject_reason", F.coalesce("reject_reason", missing))
        .drop("_known")
    )


def accepted(judged: DataFrame, arrived=None) -> DataFrame:
    """Telemetry rows to append; ``created_at`` is the arrival time."""
    rows = judged.where(F.col("reject_reason").isNull())
    if arrived is not None:
        rows = rows.withColumn("created_at", instant(arrived))
    return rows.drop("payload", "reject_reason")


def rejected(judged: DataFrame) -> DataFrame:
    return judged.where(F.col("reject_reason").isNotNull()).drop("metrics", "timestamp")
