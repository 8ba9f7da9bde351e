"""Shared parts of the registered queries and of the SQL they are checked with."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetpulse import model
from fleetpulse.session import prepare

Query = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Entry:
    """One registered query and, where SQL can state it, the SQL over the same tables."""

    run: Query
    sql: str | None = None


def comparable(df: DataFrame, places: int = 9) -> DataFrame:
    """Result in the types both engines share: plain timestamps, rounded doubles."""

    def shared(field: T.StructField):
        c = F.col(field.name)
        if isinstance(field.dataType, T.TimestampType):
            return c.cast("timestamp_ntz").alias(field.name)
        if isinstance(field.dataType, T.DoubleType):
            return F.round(c, places).alias(field.name)
        return c

    return df.select(*[shared(f) for f in df.schema.fields])


def registered(query: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        prepare(spark)
        return comparable(query(spark, sf_dir))

    return run


def id_sql(prefix: str, *parts: str) -> str:
    """``stable_id`` in SQL; ``prefix`` is a SQL expression too."""
    key = " || ".join(f"coalesce(length(({p})::VARCHAR) || ':' || ({p})::VARCHAR, '-')" for p in parts)
    return f"{prefix} || '-' || substr(sha256({key}), 1, 24)"


def rules_sql() -> str:
    """The default rules as SQL rows (id, name, metric, operator, threshold, hold, severity)."""
    rows = [(i, n, m, o, t) for i, n, m, o, t, _ in model.DEFAULT_RULES]
    return ",\n  ".join(f"('{i}', '{n}', '{m}', '{o}', {t}, 0, '{model.DEFAULT_SEVERITY}')" for i, n, m, o, t in rows)


def strip_sql(c: str) -> str:
    """Without the kinds of white space that the derived requests have."""
    return f"trim({c}, ' ' || chr(9) || chr(10) || chr(8195))"


# Telemetry straight from the source columns: what the JSON of each event must read as.
TELEMETRY_SQL = """
telemetry AS (
  SELECT event_id AS id, 'agent-' || user_id AS agent_id, 'agent-' || (user_id % 5) AS dense_agent_id, ts,
    CASE WHEN event_id % 50 = 1 THEN 12.5 WHEN event_id % 50 IN (0, 2, 3, 4) THEN NULL
      ELSE least(value, 100.0) END AS cpu_sql,
    CASE WHEN event_id % 50 IN (0, 1, 2, 3, 4) THEN NULL ELSE least(value, 100.0) END AS cpu_strict,
    CASE WHEN event_id % 50 IN (0, 1, 2, 3, 4) THEN 0.0 ELSE least(value, 100.0) END AS cpu_zero,
    CASE WHEN event_id % 50 = 3 THEN NULL WHEN event_id % 50 IN (0, 1, 2, 4) THEN 0.0
      ELSE least(value, 100.0) END AS cpu_present,
    CAST(json_extract_string(props, '$.k') AS DOUBLE) AS memory,
    CAST(event_id % 90 AS DOUBLE) AS disk,
    CAST(event_id % 100 AS DOUBLE) AS root_disk,
    CASE WHEN event_id % 50 = 5 THEN 0 ELSE event_id * 10 + 3 END AS received,
    CASE WHEN event_id % 50 = 5 THEN 0 ELSE event_id END AS sent,
    event_id % 300 AS processes
  FROM events
)"""

AS_OF_SQL = "TIMESTAMP '2024-01-31 00:30:00'"
