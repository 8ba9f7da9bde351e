"""Fleet read queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetpulse.operators import fleet as O
from fleetpulse.operators import series as S
from fleetpulse.plans.common import AS_OF_SQL, TELEMETRY_SQL, Entry
from fleetpulse.sources import benchmark_tables as B

HEALTHY, STALE = 6 * 3600, 24 * 3600
RANGE_START, RANGE_END = "2024-01-10T00:00:00", "2024-01-20T12:00:00"


def with_readings(df):
    """A few values from the JSON, so that a check sees the right document came along."""
    m = F.col("metrics")
    return df.select(
        "agent_id",
        "id",
        "timestamp",
        S.N.number_or_zero(m, "$.system.memory.used_percent").alias("memory"),
        S.N.number_or_zero(m, "$.system.disk.used_percent").alias("disk"),
        "created_at",
    )


READINGS_SQL = "agent_id, id, ts AS timestamp, memory, disk, ts AS created_at"


def telemetry_latest(spark, sf_dir):
    return with_readings(O.latest_telemetry(B.telemetry(spark, sf_dir)))


def telemetry_history(spark, sf_dir):
    return with_readings(O.history(B.telemetry(spark, sf_dir)))


def telemetry_history_range(spark, sf_dir):
    return with_readings(O.history(B.telemetry(spark, sf_dir), 20, RANGE_START, RANGE_END))


def agent_health(spark, sf_dir):
    return O.agent_health(B.agents(spark, sf_dir), B.telemetry(spark, sf_dir), B.AS_OF, HEALTHY, STALE)


def agent_health_default(spark, sf_dir):
    return O.agent_health(B.agents(spark, sf_dir), B.telemetry(spark, sf_dir), "2024-01-30T12:00:00")


def fleet_overview(spark, sf_dir):
    return O.fleet_overview(B.agents(spark, sf_dir), B.telemetry(spark, sf_dir), B.AS_OF, HEALTHY, STALE)


def analytics_points(spark, sf_dir):
    return S.chart_points(B.telemetry(spark, sf_dir), "7d", B.AS_OF)


def analytics_points_dense(spark, sf_dir):
    return S.chart_points(B.telemetry(spark, sf_dir, dense=True), "7d", B.AS_OF, max_points=100)


def analytics_downsampled(spark, sf_dir):
    return S.downsampled_points(B.telemetry(spark, sf_dir, dense=True), "7d", B.AS_OF)


def metric_summary(spark, sf_dir):
    return S.metric_summary(B.telemetry(spark, sf_dir))


def health_sql(as_of: str, healthy: int, stale: int) -> str:
    age = f"greatest(0, epoch_us({as_of}) - epoch_us(last_seen)) // 1000000"
    return f"""
health AS (
  SELECT a.agent_id, CASE WHEN last_seen IS NULL THEN 'offline' WHEN {age} <= {healthy} THEN 'healthy' WHEN {age} < {stale} THEN 'stale'
      ELSE 'offline' END AS status, last_seen,
    CASE WHEN last_seen IS NOT NULL THEN CAST({age} AS BIGINT) END AS seconds_since_last_seen
  FROM (SELECT 'agent-' || c_custkey AS agent_id FROM customer) a
  LEFT JOIN (SELECT 'agent-' || user_id AS agent_id, max(ts) AS last_seen FROM events GROUP BY ALL) s USING (agent_id)
)"""


def newest_sql(columns: str, n: int, where: str = "true", agent: str = "agent_id") -> str:
    return f"""
WITH {TELEMETRY_SQL}, ranked AS (
  SELECT *, row_number() OVER (PARTITION BY {agent} ORDER BY ts DESC, id DESC) AS rn FROM telemetry WHERE {where}
)
SELECT {columns} FROM ranked WHERE rn <= {n}"""


RANGE_SQL = f"ts BETWEEN TIMESTAMP '{RANGE_START}' AND TIMESTAMP '{RANGE_END}'"
WEEK_SQL = f"ts BETWEEN {AS_OF_SQL} - INTERVAL 7 DAY AND {AS_OF_SQL}"
POINT_SQL = """ts AS timestamp, round(cpu_zero, 9) AS cpu, memory, disk, received AS bytes_received,
  sent AS bytes_sent, CAST(processes AS BIGINT) AS running_processes, '7d' AS range"""

SUMMARY_SQL = f"""
WITH {TELEMETRY_SQL}
SELECT agent_id,
  round(avg(cpu_present), 9) AS cpu_average, round(min(cpu_present), 9) AS cpu_minimum,
  round(max(cpu_present), 9) AS cpu_maximum,
  round(avg(memory), 9) AS memory_average, min(memory) AS memory_minimum, max(memory) AS memory_maximum,
  round(avg(processes), 9) AS processes_average, CAST(min(processes) AS DOUBLE) AS processes_minimum,
  CAST(max(processes) AS DOUBLE) AS processes_maximum,
  arg_min(disk, (ts, id)) AS disk_current,
  CAST(sum(received) AS BIGINT) AS total_bytes_received, CAST(sum(sent) AS BIGINT) AS total_bytes_sent
FROM telemetry GROUP BY agent_id"""

QUERIES = {
    "telemetry_latest": Entry(telemetry_latest, newest_sql(READINGS_SQL, 1)),
    "telemetry_history": Entry(telemetry_history, newest_sql(READINGS_SQL, 50)),
    "telemetry_history_range": Entry(telemetry_history_range, newest_sql(READINGS_SQL, 20, RANGE_SQL)),
    "agent_health": Entry(
        agent_health, f"WITH {health_sql(AS_OF_SQL, HEALTHY, STALE)} SELECT * FROM health"
    ),
    "agent_health_default": Entry(
        agent_health_default, f"WITH {health_sql("TIMESTAMP '2024-01-30 12:00:00'", 30, 120)} SELECT * FROM health"
    ),
    "fleet_overview": Entry(
        fleet_overview,
        f"""
WITH {health_sql(AS_OF_SQL, HEALTHY, STALE)}
SELECT count(*) AS total, count(*) FILTER (status = 'healthy') AS healthy,
  count(*) FILTER (status = 'stale') AS stale, count(*) FILTER (status = 'offline') AS offline,
  max(last_seen) AS latest_telemetry
FROM health""",
    ),
    "analytics_points": Entry(analytics_points, newest_sql(f"agent_id, {POINT_SQL}", 500, WEEK_SQL)),
    "analytics_points_dense": Entry(
        analytics_points_dense,
        newest_sql(f"dense_agent_id AS agent_id, {POINT_SQL}", 100, WEEK_SQL, "dense_agent_id"),
    ),
    "analytics_downsampled": Entry(
        analytics_downsampled,
        f"""
WITH {TELEMETRY_SQL}, typed AS (
  SELECT dense_agent_id AS agent_id, id, ts, round(cpu_zero, 9) AS cpu, memory, disk, CAST(received AS BIGINT) AS bytes_received,
    CAST(sent AS BIGINT) AS bytes_sent, CAST(processes AS BIGINT) AS running_processes,
    CAST(least((epoch_us(ts) - epoch_us({AS_OF_SQL} - INTERVAL 7 DAY)) * 500 // (7 * 86400 * 1000000::BIGINT), 499) AS INTEGER) AS slice
  FROM telemetry WHERE {WEEK_SQL}
)
SELECT agent_id, slice, count(*) AS samples, max(ts) AS timestamp, '7d' AS range,
  {", ".join(f"min({c}) AS {c}_minimum, max({c}) AS {c}_maximum, arg_max({c}, (ts, id)) AS {c}_last" for c in S.POINT_VALUES)}
FROM typed GROUP BY agent_id, slice""",
    ),
    "metric_summary": Entry(metric_summary, SUMMARY_SQL),
}
