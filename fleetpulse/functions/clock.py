"""The explicit clock every operator takes instead of asking the machine for the time."""

from __future__ import annotations

from datetime import datetime, timezone
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F


def instant(when: datetime | str | Column) -> Column:
    """TIMESTAMP column of a moment; a datetime without a zone is taken as UTC."""
    if isinstance(when, Column):
        return when
    if isinstance(when, str):
        when = datetime.fromisoformat(when)
    if when.tzinfo is None:
        when = when.replace(tzinfo=timezone.utc)
    return F.lit(when)


def hour_of(ts: Column) -> Column:
    return F.date_trunc("hour", ts)


def row_order(ts: Column, row_id: Column) -> Column:
    """Sortable number of (time, id), for ids from 0 up.

    Being fixed-width it fits the buffers of hash aggregation, which a struct does not.
    """
    return F.unix_micros(ts).cast("decimal(38,0)") * F.lit(Decimal(10**19)) + row_id
