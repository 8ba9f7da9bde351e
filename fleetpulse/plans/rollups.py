"""Rollup and retention queries."""

from __future__ import annotations

from fleetpulse.operators import rollup as R
from fleetpulse.plans.common import AS_OF_SQL, TELEMETRY_SQL, Entry
from fleetpulse.sources import benchmark_tables as B

ROLLUP_COLUMNS_SQL = """
    round(coalesce(avg(cpu_sql), 0), 9) AS cpu_avg,
    round(coalesce(min(cpu_sql), 0), 9) AS cpu_min,
    round(coalesce(max(cpu_sql), 0), 9) AS cpu_max,
    round(coalesce(avg(memory), 0), 9) AS memory_avg,
    round(coalesce(min(memory), 0), 9) AS memory_min,
    round(coalesce(max(memory), 0), 9) AS memory_max,
    round(coalesce(avg(root_disk), 0), 9) AS disk_avg,
    CAST(sum(received) AS BIGINT) AS network_received,
    CAST(sum(sent) AS BIGINT) AS network_sent,
    count(*) AS sample_count"""

HOURLY_SQL = f"""
WITH {TELEMETRY_SQL}
SELECT agent_id, date_trunc('hour', ts)::TIMESTAMP AS bucket_start, {ROLLUP_COLUMNS_SQL}
FROM telemetry WHERE ts < date_trunc('hour', {AS_OF_SQL})
GROUP BY ALL"""


def hourly_rollup(spark, sf_dir):
    return R.hourly_rollup(B.telemetry(spark, sf_dir), B.AS_OF)


QUERIES = {
    "hourly_rollup": Entry(hourly_rollup, HOURLY_SQL),
}
