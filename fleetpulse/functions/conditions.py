"""Comparators, health classes and argument checks."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

from fleetpulse import model


def compare(value: Column, op: Column, threshold: Column) -> Column:
    """Comparison chosen by name per row; an unknown name never breaches."""
    return (
        F.when(op == ">", value > threshold)
        .when(op == ">=", value >= threshold)
        .when(op == "<", value < threshold)
        .when(op == "<=", value <= threshold)
        .when(op == "==", value == threshold)
        .otherwise(F.lit(False))
    )


def age_seconds(ts: Column, as_of: Column) -> Column:
    """Whole seconds since ``ts``, never negative; NULL without a ``ts``."""
    elapsed = F.unix_micros(as_of) - F.unix_micros(ts)
    return F.floor(F.when(elapsed < 0, F.lit(0)).otherwise(elapsed) / 1_000_000).cast("bigint")


def health_thresholds(healthy: int | None, stale: int | None) -> tuple[int, int]:
    healthy = healthy if healthy and healthy > 0 else model.HEALTHY_SECONDS
    stale = stale if stale and stale > healthy else model.STALE_SECONDS
    return healthy, stale


def health_class(age: Column, healthy: int | None = None, stale: int | None = None) -> Column:
    """healthy up to and including its limit, stale strictly below its own, else offline."""
    healthy, stale = health_thresholds(healthy, stale)
    return F.when(age <= healthy, "healthy").when(age < stale, "stale").otherwise("offline")


def range_length(name: str | None) -> tuple[str, timedelta]:
    """Label and length of a chart range; unknown names keep their label and read as one hour."""
    label = name or "1h"
    return label, timedelta(seconds=model.TIME_RANGES.get(label, model.TIME_RANGES["1h"]))


def history_limit(value: str | int | None) -> int:
    if value is None or value == "":
        return model.HISTORY_DEFAULT
    try:
        limit = int(value)
    except (TypeError, ValueError):
        raise ValueError("invalid limit parameter") from None
    if not 0 < limit <= model.HISTORY_MAX:
        raise ValueError(f"limit must be between 1 and {model.HISTORY_MAX}")
    return limit


def range_bound(name: str, text: str | None) -> datetime | None:
    """RFC 3339 bound of a range argument; an empty one means no bound."""
    import re

    from fleetpulse.functions.text import RFC3339

    if not text:
        return None
    if not re.match(RFC3339, text):
        raise ValueError(f"invalid {name} parameter format (expected RFC3339)")
    try:
        return datetime.fromisoformat(text)
    except ValueError:
        raise ValueError(f"invalid {name} parameter format (expected RFC3339)") from None
