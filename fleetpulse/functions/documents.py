"""JSON bodies handed to the outside; fields without a value are left out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fleetpulse.functions.text import empty_to_null, rfc3339_text

AGENT_FIELDS = ["id", "name", "hostname", "os", "arch", "version", "status", "last_seen", "created_at"]
ALERT_FIELDS = [
    "id", "rule_id", "agent_id", "rule_name", "severity", "status", "started_at", "acknowledged_at",
    "acknowledged_by", "acknowledged_comment", "resolved_at", "last_value", "message", "created_at", "updated_at",
]
TIME_FIELDS = {"last_seen", "created_at", "updated_at", "started_at", "acknowledged_at", "resolved_at"}
OPTIONAL_FIELDS = {"rule_name", "severity", "acknowledged_by", "acknowledged_comment"}


def document(fields: list[str], present: list[str]) -> Column:
    """STRUCT of those fields a frame has, times as RFC 3339 text."""

    def value(name: str) -> Column:
        if name in TIME_FIELDS:
            return rfc3339_text(F.col(name)).alias(name)
        if name in OPTIONAL_FIELDS:
            return empty_to_null(F.col(name)).alias(name)
        return F.col(name)

    return F.struct(*[value(name) for name in fields if name in present])


def agent_document(columns: list[str]) -> Column:
    return document(AGENT_FIELDS, columns)


def alert_document(columns: list[str]) -> Column:
    return document(ALERT_FIELDS, columns)


def listing(rows, name: str):
    """Rows as JSON lines under one column; an empty list is an empty frame."""
    return rows.select(F.to_json(F.struct(*rows.columns)).alias(name))
