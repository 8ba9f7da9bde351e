"""Rule evaluation, alert lifecycle and incident workflow queries."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from fleetpulse.operators import alerting as A
from fleetpulse.operators import incidents as I
from fleetpulse.operators import versions as V
from fleetpulse.plans.common import TELEMETRY_SQL, Entry, id_sql, rules_sql
from fleetpulse.plans.fleet import HEALTHY, STALE
from fleetpulse.sources import benchmark_tables as B
from fleetpulse.sources.tables import materialized

HOLD_SECONDS = 21600
TICK_START, TICK_STEP, TICK_COUNT = datetime(2024, 1, 1, 12), 12 * 3600, 60


def evaluations(spark, sf_dir):
    return A.evaluate(A.metric_samples(B.telemetry(spark, sf_dir)), B.rules(spark, HOLD_SECONDS))


def alerts(spark, sf_dir):
    return A.alerts(A.alert_episodes(evaluations(spark, sf_dir)), B.rules(spark, HOLD_SECONDS))


def stored_alerts(spark, sf_dir):
    """The alerts as the table that the workflow queries read, some of them more than once."""
    return materialized(alerts(spark, sf_dir), "alerts")


def rule_evaluation(spark, sf_dir):
    return evaluations(spark, sf_dir).withColumnRenamed("clock", "timestamp")


def alert_lifecycle(spark, sf_dir):
    return alerts(spark, sf_dir)


def alert_lifecycle_sustained(spark, sf_dir):
    rules = B.rules(spark, HOLD_SECONDS).where(F.col("for_duration_seconds") > 0)
    samples = A.metric_samples(B.telemetry(spark, sf_dir))
    return A.alert_episodes(A.evaluate(samples, rules))


def alert_offline(spark, sf_dir):
    segments = A.offline_segments(B.agents(spark, sf_dir), B.telemetry(spark, sf_dir), TICK_START, TICK_STEP, TICK_COUNT, HEALTHY, STALE)
    # A pair has no more rows than there are ticks, so one chunk may span them all.
    return A.alert_episodes(A.evaluate_offline(segments, B.rules(spark), TICK_START, TICK_STEP), TICK_STEP * TICK_COUNT)


def rule_changes(spark, sf_dir):
    """The rules, and a change of one of them for every nation: thresholds, hold times, metrics, on and off."""
    key = F.col("n_nationkey")
    updated = F.timestamp_add("HOUR", (key * 28 + 5).cast("int"), A.instant("2024-01-01T00:00:00"))
    one = F.when(key % 3 == 0, "rule-cpu-high").when(key % 3 == 1, "rule-cpu-sustained").otherwise("rule-disk-high")
    changes = B.table(spark, sf_dir, "nation").select(
        one.alias("id"),
        F.concat(F.lit("Changed by "), F.col("n_name")).alias("name"),
        F.when(key % 3 < 2, "cpu_usage").when(key % 2 == 0, "memory_usage").otherwise("disk_usage").alias("metric"),
        F.when(key % 5 == 4, "<=").otherwise(">").alias("operator"),
        (F.lit(15.0) + key * 2).alias("threshold"),
        F.lit(0).alias("duration_seconds"),
        ((key % 4) * 10800).cast("int").alias("for_duration_seconds"),
        F.lit(0).alias("cooldown_seconds"),
        F.when(key % 2 == 0, "critical").otherwise("warning").alias("severity"),
        (key % 7 != 6).alias("enabled"),
        updated.alias("created_at"),
        updated.alias("updated_at"),
    )
    return V.rule_versions(B.rules(spark, HOLD_SECONDS).unionByName(changes))


def rule_evaluation_versions(spark, sf_dir):
    found = V.evaluate_versions(A.metric_samples(B.telemetry(spark, sf_dir)), rule_changes(spark, sf_dir))
    return found.withColumnRenamed("clock", "timestamp")


def alert_lifecycle_versions(spark, sf_dir):
    """Episodes under changing rules, dense agents, so that rules change within breaches."""
    versions = materialized(rule_changes(spark, sf_dir), "rule-versions")
    found = V.evaluate_versions(A.metric_samples(B.telemetry(spark, sf_dir, dense=True)), versions)
    episodes = materialized(A.alert_episodes(found), "episodes")
    return V.named_at_start(episodes, versions)


def ack_commands(alerts):
    """Commands on every alert: too early, twice in time or after the fact, and one astray.

    Disk alerts get none in time, so some open alerts stay firing.
    """
    at = F.col("started_at")
    minute = lambda n: F.timestamp_add("MINUTE", F.lit(n), at)
    command = lambda seq, when, user, comment, suffix="": F.struct(
        F.lit(seq).alias("seq"), when.alias("at"), F.lit(user).alias("user"),
        F.lit(comment).alias("comment"), F.lit(suffix).alias("suffix"),
    )
    commands = F.array(
        command(1, minute(-1), "early", "too early"),
        command(2, minute(30), "", "looking"),
        command(3, minute(31), "alice", "me too"),
        command(4, F.coalesce("resolved_at", minute(60)), "late", "after"),
        command(5, minute(5), "bob", "lost", "-unknown"),
    )
    sent = alerts.select("id", "rule_id", F.explode(commands).alias("c"))
    return sent.where(~((F.col("rule_id") == "rule-disk-high") & F.col("c.seq").isin(2, 3))).select(
        F.concat("id", "c.suffix").alias("alert_id"), "c.seq", "c.at", "c.user", "c.comment"
    )


def acknowledged(spark, sf_dir):
    found = stored_alerts(spark, sf_dir)
    return I.acknowledge(found, ack_commands(found))


def alerts_acknowledged(spark, sf_dir):
    return acknowledged(spark, sf_dir).select(
        "id", "status", "acknowledged_at", "acknowledged_by", "acknowledged_comment", "updated_at", "last_value"
    )


def acknowledgements_refused(spark, sf_dir):
    found = stored_alerts(spark, sf_dir)
    return I.refused_acknowledgements(found, ack_commands(found)).select("alert_id", "seq", "at")


def alerts_enriched(spark, sf_dir):
    return I.list_alerts(acknowledged(spark, sf_dir), B.rules(spark)).select(
        "id", "rule_id", "agent_id", "rule_name", "severity", "status", "started_at", "resolved_at",
        "acknowledged_by", "acknowledged_comment", "last_value", "message", "updated_at",
    )


def alerts_filtered(spark, sf_dir):
    """The list with both filters: what is over for one agent, what another one has acknowledged."""
    stored = materialized(acknowledged(spark, sf_dir), "acknowledged")
    columns = ["id", "agent_id", "rule_name", "status", "acknowledged_by", "updated_at"]
    one = I.list_alerts(stored, B.rules(spark), "resolved", "agent-3").select(*columns)
    return one.unionByName(I.list_alerts(stored, B.rules(spark), "acknowledged", "agent-7").select(*columns))


def alerts_active(spark, sf_dir):
    return I.active_alerts(I.list_alerts(acknowledged(spark, sf_dir), B.rules(spark))).select(
        "id", "rule_name", "severity", "status", "acknowledged_at"
    )


def rule_comparators(spark, sf_dir):
    """Every comparator and an unknown one over all disk samples."""
    samples = A.metric_samples(B.telemetry(spark, sf_dir)).where(F.col("metric") == "disk_usage")
    return A.evaluate(samples, B.comparator_rules(spark)).select("rule_id", "agent_id", "id", "breaching")


def comment_requests(spark, sf_dir, alerts):
    """Conversations as comments on the first alert of the agent with the same number."""
    first = alerts.groupBy("agent_id").agg(F.min_by("id", F.struct("started_at", "id")).alias("alert_id"))
    turn = F.col("turn")
    return (
        B.table(spark, sf_dir, "conversations")
        .withColumn("agent_id", F.concat(F.lit("agent-"), F.col("conv_id").cast("string")))
        .join(first, "agent_id", "left")
        .select(
            F.coalesce("alert_id", F.lit("alert-none")).alias("alert_id"),
            F.when(F.col("role") == "system", "").otherwise(F.col("role")).alias("author_id"),
            F.when(turn % 5 == 4, " \t\n").otherwise(F.col("text")).alias("comment"),
            F.timestamp_add("MINUTE", (F.col("conv_id") * 10 + turn).cast("int"), A.instant("2024-02-01T00:00:00")).alias("at"),
            turn.alias("seq"),
        )
    )


def comments(spark, sf_dir):
    found = stored_alerts(spark, sf_dir)
    return I.add_comments(found, comment_requests(spark, sf_dir, found))


def comment_threads(spark, sf_dir):
    return I.comment_threads(comments(spark, sf_dir))


RULES_SQL = f"""
rules(rule_id, rule_name, metric, op, threshold, hold, severity) AS (VALUES
  {rules_sql()},
  ('rule-cpu-sustained', 'Sustained CPU', 'cpu_usage', '>', 20.0, {HOLD_SECONDS}, 'critical')
)"""


def evaluations_sql() -> str:
    return """
samples AS (
  SELECT agent_id, id, ts AS clock, 'cpu_usage' AS metric, cpu_strict AS value FROM telemetry
  WHERE cpu_strict IS NOT NULL
  UNION ALL SELECT agent_id, id, ts, 'memory_usage', memory FROM telemetry
  UNION ALL SELECT agent_id, id, ts, 'disk_usage', disk FROM telemetry
), evals AS (
  SELECT rule_id, agent_id, clock, id, value, value > threshold AS breaching, hold AS hold_seconds
  FROM samples JOIN rules USING (metric)
)"""


# Whole-history islands: a group is one clear sample and the breaching run after it.
EPISODES_SQL = """
grouped AS (
  SELECT *, sum(CASE WHEN breaching THEN 0 ELSE 1 END)
    OVER (PARTITION BY rule_id, agent_id ORDER BY clock, id ROWS UNBOUNDED PRECEDING) AS g FROM evals
), runs AS (
  SELECT *, min(clock) OVER (PARTITION BY rule_id, agent_id, g) AS first_breach FROM grouped WHERE breaching
), fired AS (
  SELECT * FROM runs WHERE epoch_us(clock) - epoch_us(first_breach) >= CAST(hold_seconds AS BIGINT) * 1000000
  QUALIFY row_number() OVER (PARTITION BY rule_id, agent_id, g ORDER BY clock, id) = 1
), episodes AS (
  SELECT f.rule_id, f.agent_id, f.first_breach, f.clock AS started_at, f.id AS started_id, f.value AS started_value,
    c.clock AS resolved_at, c.id AS resolved_id, c.value AS resolved_value
  FROM fired f LEFT JOIN (SELECT * FROM grouped WHERE NOT breaching) c
    ON c.rule_id = f.rule_id AND c.agent_id = f.agent_id AND c.g = f.g + 1
)"""

ALERTS_SQL = f"""
alerts AS MATERIALIZED (
  SELECT {id_sql("'alert'", 'rule_id', 'agent_id', 'epoch_us(started_at)', 'started_id')} AS id,
    rule_id, agent_id, CASE WHEN resolved_at IS NULL THEN 'firing' ELSE 'resolved' END AS status,
    started_at, resolved_at, started_value, coalesce(resolved_value, started_value) AS last_value,
    printf('[%s] %s: %.1f %s %.1f', severity, rule_name, started_value, op, threshold) AS message,
    started_at AS created_at, rule_name, severity
  FROM episodes JOIN rules USING (rule_id)
)"""

ACKS_SQL = """
commands AS MATERIALIZED (
  SELECT id AS alert_id, 1 AS seq, started_at - INTERVAL 1 MINUTE AS "at", 'early' AS who, 'too early' AS note FROM alerts
  UNION ALL SELECT id, 2, started_at + INTERVAL 30 MINUTE, '', 'looking' FROM alerts WHERE rule_id <> 'rule-disk-high'
  UNION ALL SELECT id, 3, started_at + INTERVAL 31 MINUTE, 'alice', 'me too' FROM alerts WHERE rule_id <> 'rule-disk-high'
  UNION ALL SELECT id, 4, coalesce(resolved_at, started_at + INTERVAL 60 MINUTE), 'late', 'after' FROM alerts
  UNION ALL SELECT id || '-unknown', 5, started_at + INTERVAL 5 MINUTE, 'bob', 'lost' FROM alerts
), winners AS (
  SELECT c.* FROM commands c JOIN alerts a ON a.id = c.alert_id AND c."at" >= a.started_at
    AND (a.resolved_at IS NULL OR c."at" < a.resolved_at)
  QUALIFY row_number() OVER (PARTITION BY c.alert_id ORDER BY c."at", c.seq) = 1
), acked AS (
  SELECT a.* EXCLUDE (status), CASE WHEN resolved_at IS NOT NULL THEN 'resolved' WHEN w.seq IS NOT NULL THEN 'acknowledged'
      ELSE 'firing' END AS status, w."at" AS acknowledged_at,
    CASE WHEN w.seq IS NOT NULL THEN coalesce(nullif(w.who, ''), 'operator') END AS acknowledged_by,
    w.note AS acknowledged_comment, greatest(started_at, w."at", resolved_at) AS updated_at
  FROM alerts a LEFT JOIN winners w ON w.alert_id = a.id
)"""

COMMENTS_SQL = f"""
requests AS (
  SELECT coalesce(f.alert_id, 'alert-none') AS alert_id, CASE WHEN role = 'system' THEN 'operator' ELSE role END AS author_id,
    CASE WHEN turn % 5 = 4 THEN ' ' || chr(9) || chr(10) ELSE text END AS comment,
    TIMESTAMP '2024-02-01 00:00:00' + to_minutes(conv_id * 10 + turn) AS "at", turn AS seq
  FROM conversations c LEFT JOIN (SELECT agent_id, arg_min(id, (started_at, id)) AS alert_id FROM alerts GROUP BY agent_id) f
    ON f.agent_id = 'agent-' || c.conv_id
), comments AS (
  SELECT {id_sql("'cmt'", 'alert_id', 'epoch_us("at")', 'seq')} AS id,
    alert_id, author_id, comment, "at" AS created_at
  FROM requests WHERE trim(comment, ' ' || chr(9) || chr(10)) <> '' AND alert_id IN (SELECT id FROM alerts)
)"""

VERSIONS_SQL = f"""
stored(rule_id, rule_name, metric, op, threshold, hold, severity, enabled, updated_at) AS (
  SELECT *, true, TIMESTAMP '2023-12-01 00:00:00' FROM rules
  UNION ALL SELECT CASE n_nationkey % 3 WHEN 0 THEN 'rule-cpu-high' WHEN 1 THEN 'rule-cpu-sustained' ELSE 'rule-disk-high' END,
    'Changed by ' || n_name, CASE WHEN n_nationkey % 3 < 2 THEN 'cpu_usage' WHEN n_nationkey % 2 = 0 THEN 'memory_usage' ELSE 'disk_usage' END,
    CASE WHEN n_nationkey % 5 = 4 THEN '<=' ELSE '>' END, 15.0 + n_nationkey * 2, (n_nationkey % 4) * 10800,
    CASE WHEN n_nationkey % 2 = 0 THEN 'critical' ELSE 'warning' END, n_nationkey % 7 <> 6,
    TIMESTAMP '2024-01-01 00:00:00' + to_hours(n_nationkey * 28 + 5) FROM nation
)"""


def versioned_sql(agent: str) -> str:
    """Samples judged by the version that an ASOF join finds; ``agent`` names the column that is the agent."""
    return f"""
asked AS (
  SELECT {agent} AS agent_id, t.id, ts AS clock, cpu_strict, memory, disk, rule_id FROM telemetry t, (SELECT DISTINCT rule_id FROM stored)
), evals AS (
  SELECT rule_id, agent_id, clock, id, value, CASE WHEN op = '>' THEN value > threshold ELSE value <= threshold END AS breaching, hold AS hold_seconds
  FROM (
    SELECT a.*, v.* EXCLUDE (rule_id, updated_at),
      CASE v.metric WHEN 'cpu_usage' THEN cpu_strict WHEN 'memory_usage' THEN memory WHEN 'disk_usage' THEN disk END AS value
    FROM asked a ASOF JOIN stored v ON a.rule_id = v.rule_id AND a.clock >= v.updated_at)
  WHERE enabled AND value IS NOT NULL
)"""


BASE_SQL = f"WITH {TELEMETRY_SQL}, {RULES_SQL}, {evaluations_sql()}"
ALERT_CTES = f"{BASE_SQL}, {EPISODES_SQL}, {ALERTS_SQL}"
EPISODE_COLUMNS = (
    "rule_id, agent_id, first_breach, started_at, started_id, round(started_value, 9) AS started_value, "
    "resolved_at, resolved_id, round(resolved_value, 9) AS resolved_value"
)

OFFLINE_SQL = f"""
WITH {RULES_SQL}, ticks AS (
  SELECT 'agent-' || c_custkey AS agent_id, c_custkey, i AS id, TIMESTAMP '2024-01-01 12:00:00' + to_hours(12 * i) AS clock
  FROM customer, range({TICK_COUNT}) r(i)
), states AS MATERIALIZED (
  SELECT agent_id, id, clock, ts AS seen FROM ticks t ASOF LEFT JOIN events e ON e.user_id = t.c_custkey AND t.clock >= e.ts
), evals AS (
  SELECT rule_id, agent_id, clock, id, breaching, hold AS hold_seconds, CASE WHEN breaching THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS value
  FROM (SELECT *, seen IS NULL OR (epoch_us(clock) - epoch_us(seen)) // 1000000 >= {STALE} AS breaching FROM states),
    (SELECT * FROM rules WHERE metric = 'agent_offline')
), {EPISODES_SQL}
SELECT {EPISODE_COLUMNS} FROM episodes"""

QUERIES = {
    "rule_evaluation": Entry(
        rule_evaluation, f"{BASE_SQL} SELECT * EXCLUDE (clock, value), clock AS timestamp, round(value, 9) AS value FROM evals"
    ),
    "alert_lifecycle": Entry(
        alert_lifecycle,
        f"""WITH {TELEMETRY_SQL}, {RULES_SQL}, {evaluations_sql()}, {EPISODES_SQL}, {ALERTS_SQL}
SELECT id, rule_id, agent_id, status, started_at, resolved_at, round(started_value, 9) AS started_value,
  round(last_value, 9) AS last_value, message, created_at, rule_name, severity FROM alerts""",
    ),
    "alert_lifecycle_sustained": Entry(
        alert_lifecycle_sustained,
        f"{BASE_SQL}, {EPISODES_SQL} SELECT {EPISODE_COLUMNS} FROM episodes WHERE rule_id = 'rule-cpu-sustained'",
    ),
    "rule_evaluation_versions": Entry(
        rule_evaluation_versions,
        f"""WITH {TELEMETRY_SQL}, {RULES_SQL}, {VERSIONS_SQL}, {versioned_sql('t.agent_id')}
SELECT * EXCLUDE (clock, value), clock AS timestamp, round(value, 9) AS value FROM evals""",
    ),
    "alert_lifecycle_versions": Entry(
        alert_lifecycle_versions,
        f"""WITH {TELEMETRY_SQL}, {RULES_SQL}, {VERSIONS_SQL}, {versioned_sql('dense_agent_id')}, {EPISODES_SQL}
SELECT e.rule_id, agent_id, first_breach, started_at, started_id, round(started_value, 9) AS started_value, resolved_at, resolved_id,
  round(resolved_value, 9) AS resolved_value, v.rule_name, v.severity, v.op AS operator, v.threshold::DOUBLE AS threshold
FROM episodes e ASOF JOIN stored v ON e.rule_id = v.rule_id AND e.started_at >= v.updated_at""",
    ),
    "alert_offline": Entry(alert_offline, OFFLINE_SQL),
    "alerts_acknowledged": Entry(
        alerts_acknowledged,
        f"""{ALERT_CTES}, {ACKS_SQL} SELECT id, status, acknowledged_at, acknowledged_by, acknowledged_comment,
  updated_at, round(last_value, 9) AS last_value FROM acked""",
    ),
    "acknowledgements_refused": Entry(
        acknowledgements_refused,
        f"""{ALERT_CTES}, {ACKS_SQL} SELECT alert_id, seq, "at" FROM commands c
WHERE NOT EXISTS (SELECT 1 FROM winners w WHERE w.alert_id = c.alert_id AND w.seq = c.seq)""",
    ),
    "alerts_enriched": Entry(
        alerts_enriched,
        f"""{ALERT_CTES}, {ACKS_SQL} SELECT id, rule_id, agent_id, rule_name, severity, status, started_at, resolved_at,
  coalesce(acknowledged_by, '') AS acknowledged_by, coalesce(acknowledged_comment, '') AS acknowledged_comment,
  round(last_value, 9) AS last_value, message, updated_at FROM acked""",
    ),
    "alerts_filtered": Entry(
        alerts_filtered,
        f"""{ALERT_CTES}, {ACKS_SQL} SELECT id, agent_id, rule_name, status, coalesce(acknowledged_by, '') AS acknowledged_by, updated_at
FROM acked WHERE (status, agent_id) IN (('resolved', 'agent-3'), ('acknowledged', 'agent-7'))""",
    ),
    "alerts_active": Entry(
        alerts_active,
        f"{ALERT_CTES}, {ACKS_SQL} SELECT id, rule_name, severity, status, acknowledged_at FROM acked WHERE status <> 'resolved'",
    ),
    "rule_comparators": Entry(
        rule_comparators,
        f"""WITH {TELEMETRY_SQL}
SELECT 'rule-' || op AS rule_id, agent_id, id, CASE op WHEN '>' THEN disk > 45 WHEN '>=' THEN disk >= 45 WHEN '<' THEN disk < 45
  WHEN '<=' THEN disk <= 45 WHEN '==' THEN disk = 45 ELSE false END AS breaching
FROM telemetry, (SELECT unnest(['>', '>=', '<', '<=', '==', '!=']) AS op) WHERE disk IS NOT NULL""",
    ),
    "comment_threads": Entry(comment_threads, f"{ALERT_CTES}, {COMMENTS_SQL} SELECT * FROM comments"),
}
