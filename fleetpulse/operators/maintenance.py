"""Retention of raw rows, and deletes that take their dependents along."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetpulse import model
from fleetpulse.functions.clock import hour_of, instant
from fleetpulse.operators.joins import is_small, lookup


def cutoff(as_of, days: int = model.RETENTION_DAYS, align: str = "exact"):
    """Oldest time kept. ``align='hour'`` keeps the hour it falls into whole, so that a
    later rollup never replaces that hour from part of its rows."""
    oldest = instant(as_of) - F.lit(timedelta(days=days if days > 0 else model.RETENTION_DAYS))
    return hour_of(oldest) if align == "hour" else oldest


def retained(telemetry: DataFrame, as_of, days: int = model.RETENTION_DAYS, align: str = "exact") -> DataFrame:
    return telemetry.where(F.col("timestamp") >= cutoff(as_of, days, align))


def purge_report(telemetry: DataFrame, as_of, days: int = model.RETENTION_DAYS, align: str = "exact") -> DataFrame:
    """Rows a purge removes and keeps."""
    old = F.col("timestamp") < cutoff(as_of, days, align)
    return telemetry.agg(F.count_if(old).alias("purged"), F.count_if(~old).alias("kept"))


def without(rows: DataFrame, removed: DataFrame, key: str) -> DataFrame:
    """Rows whose ``key`` is not an id of ``removed``."""
    return rows.join(removed.select(F.col("id").alias(key)), key, "left_anti")


def delete_rules(rules: DataFrame, alerts: DataFrame, comments: DataFrame, deliveries: DataFrame, ids: DataFrame):
    """Rules, alerts, comments and deliveries left after deleting the rules in ``ids``."""
    gone = ids.select(F.col("id").alias("rule_id"))
    small = is_small(gone)
    doomed = lookup(alerts, gone, ["rule_id"], "left_semi", small=small)
    return {
        "rules": rules.join(ids.select("id"), "id", "left_anti"),
        "alerts": lookup(alerts, gone, ["rule_id"], "left_anti", small=small),
        "comments": without(comments, doomed, "alert_id"),
        "deliveries": without(deliveries, doomed, "alert_id"),
    }


def delete_channels(channels: DataFrame, deliveries: DataFrame, ids: DataFrame):
    gone = ids.select(F.col("id").alias("channel_id"))
    return {
        "channels": channels.join(ids.select("id"), "id", "left_anti"),
        "deliveries": lookup(deliveries, gone, ["channel_id"], "left_anti"),
    }


def delete_agents(
    agents: DataFrame, telemetry: DataFrame, hourly: DataFrame, alerts: DataFrame, comments: DataFrame,
    deliveries: DataFrame, ids: DataFrame,
):
    """Everything left after deleting the agents in ``ids``."""
    gone = ids.select(F.col("id").alias("agent_id"))
    small = is_small(gone)
    doomed = lookup(alerts, gone, ["agent_id"], "left_semi", small=small)
    return {
        "agents": agents.join(ids.select("id"), "id", "left_anti"),
        "telemetry": lookup(telemetry, gone, ["agent_id"], "left_anti", small=small),
        "hourly": lookup(hourly, gone, ["agent_id"], "left_anti", small=small),
        "alerts": lookup(alerts, gone, ["agent_id"], "left_anti", small=small),
        "comments": without(comments, doomed, "alert_id"),
        "deliveries": without(deliveries, doomed, "alert_id"),
    }
