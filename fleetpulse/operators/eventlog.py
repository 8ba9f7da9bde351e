"""One typed change log out of telemetry, registrations and the alert workflow."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetpulse import model
from fleetpulse.functions.clock import instant
from fleetpulse.functions.documents import agent_document, alert_document
from fleetpulse.functions.text import rfc3339_text, sse_frame

BODIES = ["metrics", "alert", "data"]


def variant_of(body: Column) -> Column:
    """VARIANT of a struct by way of its JSON, which has no members for NULL fields."""
    return F.parse_json(F.to_json(body))


def change(rows: DataFrame, event_type: str | Column, at: str, agent: str | None = None, **bodies: Column):
    """Envelope rows; a body is a VARIANT, the others are NULL."""
    kind = F.lit(event_type) if isinstance(event_type, str) else event_type
    empty = F.lit(None).cast("variant")
    return rows.select(
        kind.alias("type"),
        (F.col(agent) if agent else F.lit(None).cast("string")).alias("agent_id"),
        F.col(at).alias("timestamp"),
        F.lit(None).cast("string").alias("status"),
        *[bodies.get(name, empty).alias(name) for name in BODIES],
    )


def telemetry_changes(telemetry: DataFrame) -> DataFrame:
    return change(telemetry, model.TELEMETRY_UPDATED, "timestamp", "agent_id", metrics=F.col("metrics"))


def registration_changes(agents: DataFrame) -> DataFrame:
    body = variant_of(agent_document(agents.columns))
    return change(agents, model.AGENT_REGISTERED, "last_seen", "id", data=body)


def alert_changes(events: DataFrame) -> DataFrame:
    """Firings and resolutions, from rows of ``alert_events``."""
    rows = events.withColumnRenamed("alert_id", "id")
    body = variant_of(alert_document(rows.columns))
    return change(rows, F.col("event_type"), "at", "agent_id", alert=body)


def acknowledgement_changes(alerts: DataFrame) -> DataFrame:
    """The alert as it stood when it was acknowledged, before any resolution."""
    rows = (
        alerts.where(F.col("acknowledged_at").isNotNull())
        .withColumn("status", F.lit("acknowledged"))
        .withColumn("last_value", F.col("started_value"))
        .withColumn("updated_at", F.col("acknowledged_at"))
        .withColumn("resolved_at", F.lit(None).cast("timestamp"))
    )
    body = variant_of(alert_document(rows.columns))
    return change(rows, model.ALERT_ACKNOWLEDGED, "acknowledged_at", "agent_id", alert=body)


def comment_changes(comments: DataFrame) -> DataFrame:
    body = variant_of(
        F.struct("id", "alert_id", "author_id", "comment", rfc3339_text(F.col("created_at")).alias("created_at"))
    )
    return change(comments, model.ALERT_COMMENT_ADDED, "created_at", data=body)


def event_log(*parts: DataFrame, as_of=None) -> DataFrame:
    """All changes; one without a time of its own happened at ``as_of``."""
    log = reduce(DataFrame.unionByName, parts)
    if as_of is not None:
        log = log.withColumn("timestamp", F.coalesce("timestamp", instant(as_of)))
    return log


def frames(log: DataFrame) -> DataFrame:
    """Each change as one server-sent-events frame."""
    body = F.to_json(
        F.struct(
            "type",
            "agent_id",
            rfc3339_text(F.col("timestamp")).alias("timestamp"),
            *BODIES,
        )
    )
    return log.withColumn("frame", sse_frame(F.col("type"), body))
