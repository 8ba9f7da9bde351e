"""Change log, retention and cascading delete queries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetpulse.operators import eventlog as E
from fleetpulse.operators import incidents as I
from fleetpulse.operators import maintenance as M
from fleetpulse.operators import notify as N
from fleetpulse.operators import registry as R
from fleetpulse.operators import rollup as U
from fleetpulse.plans import alerts as A
from fleetpulse.plans import delivery as D
from fleetpulse.plans import intake as K
from fleetpulse.plans.common import AS_OF_SQL, TELEMETRY_SQL, Entry
from fleetpulse.plans.rollups import ROLLUP_COLUMNS_SQL
from fleetpulse.sources import benchmark_tables as B

EARLIER = "2024-01-20T06:15:00"
SHORT_DAYS = 15


# How the rows of each source become changes.
CHANGES = {
    "telemetry": E.telemetry_changes,
    "registrations": E.registration_changes,
    "alerts": E.alert_changes,
    "acknowledgements": E.acknowledgement_changes,
    "comments": E.comment_changes,
}


def log_sources(spark, sf_dir):
    """The rows that the change log is made of, besides telemetry."""
    alerts = A.stored_alerts(spark, sf_dir)
    complete, _ = R.split_registrations(K.registrations(spark, sf_dir))
    return {
        "registrations": R.upsert_agents(B.agents(spark, sf_dir).where(F.lit(False)), complete),
        "alerts": N.alert_events(alerts),
        "acknowledgements": I.acknowledge(alerts, A.ack_commands(alerts)),
        "comments": I.add_comments(alerts, A.comment_requests(spark, sf_dir, alerts)),
    }


def event_log_frame(spark, sf_dir):
    sources = {"telemetry": B.telemetry(spark, sf_dir)} | log_sources(spark, sf_dir)
    return E.event_log(*[CHANGES[name](rows) for name, rows in sources.items()], as_of=B.AS_OF)


def event_log(spark, sf_dir):
    return one_value_each(event_log_frame(spark, sf_dir))


def one_value_each(log):
    """The log with one value out of each kind of body."""
    text = lambda body, path: F.try_variant_get(F.col(body), path, "string")
    return log.select(
        "type",
        "agent_id",
        "timestamp",
        F.try_variant_get("metrics", "$.system.memory.used_percent", "double").alias("memory"),
        text("alert", "$.status").alias("alert_status"),
        F.try_variant_get("alert", "$.last_value", "double").alias("alert_value"),
        F.coalesce(text("data", "$.author_id"), text("data", "$.hostname")).alias("data_text"),
    )


def event_frames(spark, sf_dir):
    """Frames of registrations, firings, resolutions, acknowledgements and comments."""
    log = E.event_log(*[CHANGES[name](rows) for name, rows in log_sources(spark, sf_dir).items()], as_of=B.AS_OF)
    return E.frames(log).select("type", "agent_id", "timestamp", "frame")


def purge_retention(spark, sf_dir):
    return M.retained(B.telemetry(spark, sf_dir), B.AS_OF, SHORT_DAYS).select("id", "agent_id", "timestamp")


def purge_retention_by_hour(spark, sf_dir):
    return M.retained(B.telemetry(spark, sf_dir), B.AS_OF, SHORT_DAYS, align="hour").select("id", "agent_id", "timestamp")


def purge_report(spark, sf_dir):
    return M.purge_report(B.telemetry(spark, sf_dir), B.AS_OF, SHORT_DAYS)


def hourly_rollup_upsert(spark, sf_dir):
    """A rollup stored earlier, brought up to date from the raw rows that retention left."""
    telemetry = B.telemetry(spark, sf_dir)
    stored = U.hourly_rollup(telemetry, EARLIER)
    fresh = U.hourly_rollup(M.retained(telemetry, B.AS_OF, SHORT_DAYS), B.AS_OF)
    return U.replace_rollup(stored, fresh)


def tagged(parts: dict[str, DataFrame], names: list[str]) -> DataFrame:
    rows = [parts[name].select(F.lit(name).alias("part"), F.col("id").cast("string").alias("id")) for name in names]
    return reduce(DataFrame.unionByName, rows)


def delivery_keys(spark, alerts):
    planned = N.plan_deliveries(N.alert_events(alerts), B.channels(spark))
    return planned.select("id", "alert_id", "channel_id")


def workflow_tables(spark, sf_dir):
    alerts = A.stored_alerts(spark, sf_dir)
    comments = I.add_comments(alerts, A.comment_requests(spark, sf_dir, alerts)).select("id", "alert_id")
    return alerts, comments, delivery_keys(spark, alerts)


def cascade_delete(spark, sf_dir):
    """What is left of the workflow when the CPU rules are deleted."""
    alerts, comments, deliveries = workflow_tables(spark, sf_dir)
    gone = B.rules(spark).where(F.col("metric") == "cpu_usage").select("id")
    parts = M.delete_rules(B.rules(spark), alerts, comments, deliveries, gone)
    return tagged(parts, ["rules", "alerts", "comments", "deliveries"])


def cascade_delete_channel(spark, sf_dir):
    deliveries = delivery_keys(spark, A.stored_alerts(spark, sf_dir))
    gone = B.channels(spark).where(F.col("type") == "slack_webhook").select("id")
    return tagged(M.delete_channels(B.channels(spark), deliveries, gone), ["channels", "deliveries"])


def cascade_delete_agents(spark, sf_dir):
    """What is left when the agents of one customer segment are deleted."""
    alerts, comments, deliveries = workflow_tables(spark, sf_dir)
    building = B.table(spark, sf_dir, "customer").where(F.col("c_mktsegment") == "BUILDING")
    gone = building.select(F.concat(F.lit("agent-"), F.col("c_custkey").cast("string")).alias("id"))
    telemetry = B.telemetry(spark, sf_dir)
    hourly = U.hourly_rollup(telemetry, B.AS_OF)
    parts = M.delete_agents(B.agents(spark, sf_dir), telemetry, hourly, alerts, comments, deliveries, gone)
    key = F.concat_ws("|", "agent_id", F.unix_micros("bucket_start"))
    parts["hourly"] = parts["hourly"].withColumn("id", key)
    return tagged(parts, ["agents", "telemetry", "hourly", "alerts", "comments", "deliveries"])


LOG_SQL = f"""{A.ALERT_CTES}, {A.ACKS_SQL}, {A.COMMENTS_SQL}, {K.SIGNUPS_SQL}, {D.EVENTS_SQL}
SELECT 'telemetry.updated' AS type, agent_id, ts AS timestamp, memory, NULL AS alert_status, NULL::DOUBLE AS alert_value,
  NULL AS data_text FROM telemetry
UNION ALL SELECT 'agent.registered', id, max(ts), NULL, NULL, NULL, arg_max(hostname, (ts, event_id)) FROM signups GROUP BY id
UNION ALL SELECT event_type, agent_id, "at", NULL, status, round(last_value, 9), NULL FROM occasions
UNION ALL SELECT 'alert.acknowledged', agent_id, acknowledged_at, NULL, 'acknowledged', round(started_value, 9), NULL
  FROM acked WHERE acknowledged_at IS NOT NULL
UNION ALL SELECT 'alert.comment_added', NULL, created_at, NULL, NULL, NULL, author_id FROM comments"""


# A whole number is written without a fraction.
NUMBER_SQL = """CAST(CASE WHEN last_value = floor(last_value) THEN CAST(CAST(last_value AS BIGINT) AS VARCHAR)
      ELSE CAST(last_value AS VARCHAR) END AS JSON)"""


def frame_sql(resolved: str) -> str:
    """Bodies list their keys in alphabetical order."""
    return f"""CAST(json_object('type', event_type, 'agent_id', agent_id, 'timestamp', {D.time_sql('"at"')}, 'alert', json_object(
    'agent_id', agent_id, 'created_at', {D.time_sql('created_at')}, 'id', alert_id, 'last_value', {NUMBER_SQL}, 'message', message,
    {resolved} 'rule_id', rule_id, 'rule_name', rule_name, 'severity', severity, 'started_at', {D.time_sql('started_at')},
    'status', status, 'updated_at', {D.time_sql('updated_at')})) AS VARCHAR)"""


REGISTERED_SQL = f"""CAST(json_object('type', 'agent.registered', 'agent_id', id, 'timestamp', {D.time_sql('ts')}, 'data', json_object(
    'arch', arch, 'created_at', {D.time_sql('first_time')}, 'hostname', hostname, 'id', id, 'last_seen', {D.time_sql('ts')},
    'name', name, 'os', os, 'status', 'online', 'version', version)) AS VARCHAR)"""

ACKED_SQL = f"""CAST(json_object('type', 'alert.acknowledged', 'agent_id', agent_id, 'timestamp', {D.time_sql('acknowledged_at')},
  'alert', json_object('acknowledged_at', {D.time_sql('acknowledged_at')}, 'acknowledged_by', acknowledged_by,
    'acknowledged_comment', acknowledged_comment, 'agent_id', agent_id, 'created_at', {D.time_sql('created_at')}, 'id', id,
    'last_value', {NUMBER_SQL}, 'message', message, 'rule_id', rule_id, 'rule_name', rule_name, 'severity', severity,
    'started_at', {D.time_sql('started_at')}, 'status', 'acknowledged', 'updated_at', {D.time_sql('acknowledged_at')})) AS VARCHAR)"""

COMMENTED_SQL = f"""CAST(json_object('type', 'alert.comment_added', 'timestamp', {D.time_sql('created_at')}, 'data', json_object(
    'alert_id', alert_id, 'author_id', author_id, 'comment', comment, 'created_at', {D.time_sql('created_at')}, 'id', id)) AS VARCHAR)"""

FRAMES_SQL = f"""{A.ALERT_CTES}, {A.ACKS_SQL}, {A.COMMENTS_SQL}, {K.SIGNUPS_SQL}, {D.EVENTS_SQL}, newcomers AS (
  SELECT *, min(ts) OVER (PARTITION BY id) AS first_time FROM signups
  QUALIFY row_number() OVER (PARTITION BY id ORDER BY ts DESC, event_id DESC) = 1
), confirmed AS (SELECT * REPLACE (started_value AS last_value) FROM acked WHERE acknowledged_at IS NOT NULL)
SELECT 'agent.registered' AS type, id AS agent_id, ts AS timestamp,
  'event: agent.registered' || chr(10) || 'data: ' || {REGISTERED_SQL} || chr(10) || chr(10) AS frame FROM newcomers
UNION ALL SELECT 'alert.acknowledged', agent_id, acknowledged_at,
  'event: alert.acknowledged' || chr(10) || 'data: ' || {ACKED_SQL} || chr(10) || chr(10) FROM confirmed
UNION ALL SELECT 'alert.comment_added', NULL, created_at,
  'event: alert.comment_added' || chr(10) || 'data: ' || {COMMENTED_SQL} || chr(10) || chr(10) FROM comments
UNION ALL SELECT event_type AS type, agent_id, "at" AS timestamp, 'event: ' || event_type || chr(10) || 'data: ' ||
  CASE WHEN resolved_at IS NULL THEN {frame_sql('')}
    ELSE {frame_sql(f"'resolved_at', {D.time_sql('resolved_at')},")} END || chr(10) || chr(10) AS frame
FROM occasions"""

UPSERT_SQL = f"""
WITH {TELEMETRY_SQL}, stored AS (
  SELECT agent_id, date_trunc('hour', ts)::TIMESTAMP AS bucket_start, {ROLLUP_COLUMNS_SQL}
  FROM telemetry WHERE ts < date_trunc('hour', TIMESTAMP '{EARLIER}') GROUP BY ALL
), fresh AS (
  SELECT agent_id, date_trunc('hour', ts)::TIMESTAMP AS bucket_start, {ROLLUP_COLUMNS_SQL}
  FROM telemetry WHERE ts < date_trunc('hour', {AS_OF_SQL}) AND ts >= {AS_OF_SQL} - INTERVAL {SHORT_DAYS} DAY GROUP BY ALL
)
SELECT * FROM fresh UNION ALL
SELECT * FROM stored WHERE (agent_id, bucket_start) NOT IN (SELECT (agent_id, bucket_start) FROM fresh)"""


def kept_sql(cutoff: str) -> str:
    return f"SELECT event_id AS id, 'agent-' || user_id AS agent_id, ts AS timestamp FROM events WHERE ts >= {cutoff}"


CUTOFF_SQL = f"({AS_OF_SQL} - INTERVAL {SHORT_DAYS} DAY)"
LEFT_SQL = """
UNION ALL SELECT 'alerts', id FROM left_alerts
UNION ALL SELECT 'comments', id FROM comments WHERE alert_id IN (SELECT id FROM left_alerts)
UNION ALL SELECT 'deliveries', id FROM deliveries WHERE alert_id IN (SELECT id FROM left_alerts)"""

QUERIES = {
    "event_log": Entry(event_log, LOG_SQL),
    "event_frames": Entry(event_frames, FRAMES_SQL),
    "hourly_rollup_upsert": Entry(hourly_rollup_upsert, UPSERT_SQL),
    "purge_retention": Entry(purge_retention, kept_sql(CUTOFF_SQL)),
    "purge_retention_by_hour": Entry(purge_retention_by_hour, kept_sql(f"date_trunc('hour', {CUTOFF_SQL})")),
    "purge_report": Entry(
        purge_report,
        f"SELECT count(*) FILTER (ts < {CUTOFF_SQL}) AS purged, count(*) FILTER (ts >= {CUTOFF_SQL}) AS kept FROM events",
    ),
    "cascade_delete": Entry(
        cascade_delete,
        f"""{A.ALERT_CTES}, {A.COMMENTS_SQL}, {D.PLAN_SQL}, left_alerts AS (
  SELECT id FROM alerts WHERE rule_id NOT IN ('rule-cpu-high', 'rule-cpu-sustained'))
SELECT 'rules' AS part, unnest(['rule-mem-high', 'rule-disk-high', 'rule-agent-offline', 'rule-disk-muted']) AS id {LEFT_SQL}""",
    ),
    "cascade_delete_channel": Entry(
        cascade_delete_channel,
        f"""{A.ALERT_CTES}, {D.PLAN_SQL}
SELECT 'channels' AS part, unnest(['chan-signed', 'chan-plain', 'chan-muted']) AS id
UNION ALL SELECT 'deliveries', id FROM deliveries WHERE channel_id <> 'chan-chat'""",
    ),
    "cascade_delete_agents": Entry(
        cascade_delete_agents,
        f"""{A.ALERT_CTES}, {A.COMMENTS_SQL}, {D.PLAN_SQL}, {K.AGENTS_SQL},
left_agents AS (SELECT id FROM agents WHERE c_mktsegment <> 'BUILDING'),
left_alerts AS (SELECT id FROM alerts WHERE agent_id IN (SELECT id FROM left_agents))
SELECT 'agents' AS part, id FROM left_agents
UNION ALL SELECT 'telemetry', CAST(id AS VARCHAR) FROM telemetry WHERE agent_id IN (SELECT id FROM left_agents)
UNION ALL SELECT DISTINCT 'hourly', agent_id || '|' || epoch_us(date_trunc('hour', ts)::TIMESTAMP) FROM telemetry
  WHERE agent_id IN (SELECT id FROM left_agents) AND ts < date_trunc('hour', {AS_OF_SQL}) {LEFT_SQL}""",
    ),
}
