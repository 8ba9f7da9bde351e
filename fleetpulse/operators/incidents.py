"""Alert workflow: acknowledge, resolve, comment, list."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetpulse import model
from fleetpulse.functions.text import blank, empty_to_null, null_to_empty, stable_id
from fleetpulse.operators.joins import lookup


def actor(c: Column) -> Column:
    return F.coalesce(empty_to_null(c), F.lit(model.DEFAULT_ACTOR))


def _offered(alerts: DataFrame, commands: DataFrame) -> DataFrame:
    """Commands (alert_id, user, comment, at, seq) with the life span of their alert."""
    spans = alerts.select(F.col("id").alias("alert_id"), "started_at", "resolved_at")
    return commands.join(spans, "alert_id", "left")


def _in_time() -> Column:
    open_then = F.col("resolved_at").isNull() | (F.col("at") < F.col("resolved_at"))
    return F.coalesce((F.col("at") >= F.col("started_at")) & open_then, F.lit(False))


def first_acknowledgements(alerts: DataFrame, commands: DataFrame) -> DataFrame:
    """The command that acknowledged each alert: the first while it was firing."""
    chosen = F.struct("at", "seq", F.col("user"), F.col("comment"))
    return (
        _offered(alerts, commands)
        .where(_in_time())
        .groupBy("alert_id")
        .agg(F.min(chosen).alias("ack"))
        .select(F.col("alert_id").alias("id"), "ack")
    )


def acknowledge(alerts: DataFrame, commands: DataFrame) -> DataFrame:
    """Alerts with acknowledgement, status and ``updated_at`` worked in."""
    resolved = F.col("resolved_at").isNotNull()
    status = F.when(resolved, "resolved").when(F.col("ack").isNotNull(), "acknowledged").otherwise("firing")
    return (
        alerts.join(first_acknowledgements(alerts, commands), "id", "left")
        .withColumns(
            {
                "status": status,
                "acknowledged_at": F.col("ack.at"),
                "acknowledged_by": F.when(F.col("ack").isNotNull(), actor(F.col("ack.user"))),
                "acknowledged_comment": F.col("ack.comment"),
                "updated_at": F.greatest("started_at", F.col("ack.at"), "resolved_at"),
            }
        )
        .drop("ack")
    )


def refused_acknowledgements(alerts: DataFrame, commands: DataFrame) -> DataFrame:
    """Commands that changed nothing: no such alert, out of time, or not the first."""
    winners = first_acknowledgements(alerts, commands).select(
        F.col("id").alias("alert_id"), F.col("ack.at").alias("at"), F.col("ack.seq").alias("seq")
    )
    return commands.join(winners, ["alert_id", "at", "seq"], "left_anti")


def list_alerts(
    alerts: DataFrame, rules: DataFrame, status: str | None = None, agent_id: str | None = None
) -> DataFrame:
    """Alerts with rule name and severity, newest change first."""
    if status:
        alerts = alerts.where(F.col("status") == status)
    if agent_id:
        alerts = alerts.where(F.col("agent_id") == agent_id)
    named = rules.select(F.col("id").alias("rule_id"), F.col("name").alias("rule_name"), "severity")
    return (
        lookup(alerts.drop("rule_name", "severity"), named, ["rule_id"])
        .withColumn("acknowledged_by", null_to_empty(F.col("acknowledged_by")))
        .withColumn("acknowledged_comment", null_to_empty(F.col("acknowledged_comment")))
        .orderBy(F.desc("updated_at"), "id")
    )


def active_alerts(alerts: DataFrame) -> DataFrame:
    return alerts.where(F.col("status").isin("firing", "acknowledged"))


def add_comments(alerts: DataFrame, requests: DataFrame) -> DataFrame:
    """Comment rows of requests (alert_id, author_id, comment, at, seq) on existing alerts."""
    ids = alerts.select(F.col("id").alias("alert_id"))
    wanted = requests.where(~blank(F.col("comment")))
    return wanted.join(ids, "alert_id", "left_semi").select(
        stable_id("cmt", F.col("alert_id"), F.unix_micros("at"), F.col("seq")).alias("id"),
        "alert_id",
        actor(F.col("author_id")).alias("author_id"),
        "comment",
        F.col("at").alias("created_at"),
    )


def comment_threads(comments: DataFrame, alert_id: str | None = None) -> DataFrame:
    """Comments alert by alert, oldest first.

    The order comes from a range sort, which may split one long thread over tasks.
    """
    if alert_id:
        comments = comments.where(F.col("alert_id") == alert_id)
    return comments.orderBy("alert_id", "created_at", "id")
