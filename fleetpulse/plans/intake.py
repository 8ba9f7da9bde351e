"""Ingest and registry queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetpulse.functions import documents as D
from fleetpulse.functions import numbers as N
from fleetpulse.operators import ingest as G
from fleetpulse.operators import registry as R
from fleetpulse.plans.common import Entry, id_sql, rules_sql, strip_sql
from fleetpulse.sources import benchmark_tables as B


def registered_agents(spark, sf_dir):
    """Agents of all customer segments but one, so that some telemetry has no agent."""
    known = B.table(spark, sf_dir, "customer").where(F.col("c_mktsegment") != "BUILDING")
    ids = known.select(F.concat(F.lit("agent-"), F.col("c_custkey").cast("string")).alias("id"))
    return B.agents(spark, sf_dir).join(ids, "id", "left_semi")


def payloads(spark, sf_dir):
    """Every event as payload text; of 40 events in a row, 17 are odd in a way of their own."""
    kind = F.col("event_id") % 40
    at = F.date_format(F.col("ts"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    own = F.concat(F.lit("agent-"), F.col("user_id").cast("string"))
    quoted = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    field = lambda name, c: F.concat(F.lit(f'"{name}":'), c)
    metrics = B.metrics_text(F.col("event_id"), F.col("value"), F.col("props"))

    agent = (
        F.when(kind == 2, field("agent_id", F.lit('" \\t\\n"')))
        .when(kind == 4, field("agent_id", F.lit("17")))
        .when(kind == 11, field("agent_id", F.lit('"agent-other"')))
        .when(kind != 3, field("agent_id", quoted(own)))
    )
    time = (
        F.when(kind == 6, field("timestamp", quoted(F.date_format("ts", "yyyy-MM-dd"))))
        .when(kind == 7, field("timestamp", F.lit('"0001-01-01T00:00:00Z"')))
        .when(kind == 14, field("timestamp", quoted(F.concat(at, F.lit("+02:30")))))
        .when(kind != 5, field("timestamp", quoted(F.concat(at, F.lit("Z")))))
    )
    body = (
        F.when(kind == 8, field("metrics", F.lit("null")))
        .when(kind == 10, field("metrics", F.lit("[1,2]")))
        .when(kind == 12, field("metrics", F.lit("{}")))
        .when(kind != 9, field("metrics", metrics))
    )
    extra = F.when(kind == 1, field("host", F.lit('"h"'))).when(kind == 15, field("agent_id", quoted(own)))
    whole = F.concat(F.lit("{"), F.concat_ws(",", agent, time, body, extra), F.lit("}"))
    text = (
        F.when(kind == 0, F.concat(F.lit("{"), metrics))
        .when(kind == 13, F.concat(F.lit("["), whole, F.lit("]")))
        .when(kind == 16, F.concat(whole, F.lit(" trailing words")))
        .otherwise(whole)
    )
    return B.table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"), own.alias("target_id"), text.alias("payload"), B.as_utc(F.col("ts")).alias("created_at")
    )


def judged(spark, sf_dir):
    return G.judge(payloads(spark, sf_dir), registered_agents(spark, sf_dir), target="target_id")


def ingest_accepted(spark, sf_dir):
    memory = N.strict_number(F.col("metrics"), "$.system.memory.used_percent")
    return G.accepted(judged(spark, sf_dir)).select(
        "id", "agent_id", "timestamp", memory.alias("memory"), "created_at"
    )


def ingest_rejected(spark, sf_dir):
    return G.rejected(judged(spark, sf_dir)).select("id", "target_id", "reject_reason")


def telemetry_of_known_agents(spark, sf_dir):
    rows = B.telemetry(spark, sf_dir).select("id", "agent_id", "timestamp")
    return G.known_agents(rows, registered_agents(spark, sf_dir))


def telemetry_of_unknown_agents(spark, sf_dir):
    rows = B.telemetry(spark, sf_dir).select("id", "agent_id", "timestamp")
    return G.known_agents(rows, registered_agents(spark, sf_dir), known=False)


def registrations(spark, sf_dir):
    """Signups as registration requests, some without a version."""
    user = F.col("user_id").cast("string")
    return (
        B.table(spark, sf_dir, "events")
        .where(F.col("event_type") == "signup")
        .select(
            F.concat(F.lit("agent-"), user).alias("id"),
            F.concat(F.lit("Agent "), user).alias("name"),
            F.concat(F.lit("node-"), (F.col("event_id") % 7).cast("string")).alias("hostname"),
            F.lit("linux").alias("os"),
            F.when(F.col("event_id") % 2 == 0, "amd64").otherwise("arm64").alias("arch"),
            F.when(F.col("event_id") % 17 == 0, "").otherwise(F.concat(F.lit("2."), F.col("event_id").cast("string"))).alias("version"),
            B.as_utc(F.col("ts")).alias("event_time"),
            F.col("event_id").alias("seq"),
        )
    )


def agents_upsert(spark, sf_dir):
    complete, _ = R.split_registrations(registrations(spark, sf_dir))
    return R.upsert_agents(registered_agents(spark, sf_dir), complete)


def registrations_refused(spark, sf_dir):
    _, refused = R.split_registrations(registrations(spark, sf_dir))
    return refused.select("id", "event_time", "seq")


def agent_documents(spark, sf_dir):
    agents = R.oldest_first(B.agents(spark, sf_dir))
    return agents.select("id", F.to_json(D.agent_document(agents.columns)).alias("document"))


def agents_by_ids(spark, sf_dir):
    """The agents that events name, and the names without an agent."""
    asked = B.table(spark, sf_dir, "events").select(F.concat(F.lit("agent-"), F.col("user_id").cast("string")).alias("id"))
    found, missing = R.by_ids(registered_agents(spark, sf_dir), asked)
    return found.select("id", "name").unionByName(missing.withColumn("name", F.lit(None).cast("string")))


def rules_listed(spark, sf_dir):
    return R.oldest_first(R.seed_rules(stored_rules(spark, sf_dir), B.AS_OF)).select("id", "created_at")


def channels_listed(spark, sf_dir):
    channels = R.normalize_channels(channel_requests(spark, sf_dir), B.AS_OF).where("reject_reason IS NULL")
    return R.oldest_first(channels).select("id", "name", "type")


def rule_requests(spark, sf_dir):
    """Parts as rule requests: names, metrics and operators of all kinds, some blank."""
    size = F.col("p_size")
    operators = F.array(*[F.lit(o) for o in (">", ">=", "<", "<=", "==", " ")])
    return B.table(spark, sf_dir, "part").select(
        F.when(size % 3 == 0, "").otherwise(F.concat(F.lit("rule-"), F.col("p_partkey").cast("string"))).alias("id"),
        F.when(size % 11 == 0, " \t\n").otherwise(F.col("p_name")).alias("name"),
        F.lower("p_type").alias("metric"),
        F.element_at(operators, (size % 6) + 1).alias("operator"),
        F.col("p_retailprice").alias("threshold"),
        size.alias("duration_seconds"),
        (size * 2).alias("for_duration_seconds"),
        F.lit(0).alias("cooldown_seconds"),
        F.when(size % 2 == 0, "").otherwise("critical").alias("severity"),
        (size % 4 != 0).alias("enabled"),
        F.col("p_partkey").alias("seq"),
    )


RULE_OUT = ["id", "name", "metric", "operator", "threshold", "for_duration_seconds", "severity", "enabled"]


def rules_normalized(spark, sf_dir):
    created, _ = R.new_rules(rule_requests(spark, sf_dir), B.AS_OF)
    return created.select(*RULE_OUT)


def rules_refused(spark, sf_dir):
    _, refused = R.new_rules(rule_requests(spark, sf_dir), B.AS_OF)
    return refused.select("seq", "name", "operator")


def stored_rules(spark, sf_dir):
    named = rule_requests(spark, sf_dir).withColumn("id", F.concat(F.lit("rule-"), F.col("seq").cast("string")))
    return R.new_rules(named, "2024-01-01T00:00:00")[0]


def rules_updated(spark, sf_dir):
    """Parts of one brand ask for a new severity and a blank name, which an update lets pass."""
    changes = (
        rule_requests(spark, sf_dir)
        .join(B.table(spark, sf_dir, "part").where("p_brand = 'Brand#2'").select(F.col("p_partkey").alias("seq")), "seq", "left_semi")
        .withColumn("id", F.concat(F.lit("rule-"), F.col("seq").cast("string")))
        .withColumn("name", F.lit(" "))
    )
    return R.update_rules(stored_rules(spark, sf_dir), changes, B.AS_OF).select(*RULE_OUT, "created_at", "updated_at")


def rules_seeded(spark, sf_dir):
    return R.seed_rules(stored_rules(spark, sf_dir), B.AS_OF).select("id", "name", "metric", "threshold", "severity")


def channel_requests(spark, sf_dir):
    """Pages as channel requests: their own URLs, some spoilt, all kinds of types, some sent twice."""
    page = F.col("page_id")
    kind = page % 12
    url = (
        F.when(kind == 0, " \u2003\n")
        .when(kind == 1, F.concat(F.lit("ftp://files.example.com/"), page.cast("string")))
        .when(kind == 2, F.concat(F.lit("not-a-url-"), page.cast("string")))
        .when(kind == 3, F.concat(F.lit("HTTPS://Hooks.example.com/"), page.cast("string")))
        .otherwise(F.concat(F.lit(" "), F.col("url"), F.lit(" ")))
    )
    types = F.array(F.lit("webhook"), F.lit("slack_webhook"), F.lit("\t"), F.lit("pager"), F.lit(" webhook\n"))
    times = F.when(page % 9 == 0, 2).otherwise(1)
    return B.table(spark, sf_dir, "pages").withColumn("_time", F.explode(F.sequence(F.lit(1), times))).select(
        page.alias("page_id"),
        F.when(page % 13 == 0, " ").otherwise(F.concat(F.lit(" page "), page.cast("string"))).alias("name"),
        F.element_at(types, (page % 5 + 1).cast("int")).alias("type"),
        url.alias("url"),
        F.when(page % 2 == 0, F.concat(F.lit(" s-"), page.cast("string"))).alias("secret"),
        F.when(page % 7 == 0, F.lit(False)).alias("enabled"),
    )


def channels_normalized(spark, sf_dir):
    return R.normalize_channels(channel_requests(spark, sf_dir), B.AS_OF).drop("created_at", "updated_at")


KNOWN_SQL = "SELECT c_custkey FROM customer WHERE c_mktsegment <> 'BUILDING'"
REASON_SQL = f"""
WITH judged AS (
  SELECT *, event_id % 40 AS kind, CASE event_id % 40
    WHEN 0 THEN 'malformed_json' WHEN 1 THEN 'unknown_field' WHEN 2 THEN 'missing_agent_id' WHEN 3 THEN 'missing_agent_id'
    WHEN 4 THEN 'bad_agent_id' WHEN 5 THEN 'missing_timestamp' WHEN 6 THEN 'bad_timestamp' WHEN 7 THEN 'missing_timestamp'
    WHEN 8 THEN 'missing_metrics' WHEN 9 THEN 'missing_metrics' WHEN 10 THEN 'bad_metrics' WHEN 11 THEN 'agent_mismatch'
    WHEN 13 THEN 'not_an_object' WHEN 15 THEN 'malformed_json'
    ELSE CASE WHEN user_id NOT IN ({KNOWN_SQL}) THEN 'agent_not_found' END END AS reject_reason
  FROM events
)"""

AGENTS_SQL = """
agents AS (
  SELECT 'agent-' || c_custkey AS id, c_name AS name, 'host-' || c_custkey AS hostname,
    CASE c_nationkey % 3 WHEN 0 THEN 'linux' WHEN 1 THEN 'darwin' ELSE 'windows' END AS os,
    CASE c_nationkey % 2 WHEN 0 THEN 'amd64' ELSE 'arm64' END AS arch, '1.' || c_nationkey || '.0' AS version,
    'online' AS status, TIMESTAMP '2023-12-01 00:00:00' + to_minutes(c_custkey) AS last_seen,
    TIMESTAMP '2023-12-01 00:00:00' + to_minutes(c_custkey) AS created_at, c_mktsegment
  FROM customer
)"""

SIGNUPS_SQL = """
signups AS (
  SELECT 'agent-' || user_id AS id, 'Agent ' || user_id AS name, 'node-' || (event_id % 7) AS hostname, 'linux' AS os,
    CASE WHEN event_id % 2 = 0 THEN 'amd64' ELSE 'arm64' END AS arch, '2.' || event_id AS version, ts, event_id
  FROM events WHERE event_type = 'signup' AND event_id % 17 <> 0
)"""

UPSERT_SQL = f"""
WITH {AGENTS_SQL}, {SIGNUPS_SQL}, newest AS (
  SELECT *, min(ts) OVER (PARTITION BY id) AS first_time FROM signups
  QUALIFY row_number() OVER (PARTITION BY id ORDER BY ts DESC, event_id DESC) = 1
)
SELECT coalesce(n.id, o.id) AS id, coalesce(n.name, o.name) AS name, coalesce(n.hostname, o.hostname) AS hostname,
  coalesce(n.os, o.os) AS os, coalesce(n.arch, o.arch) AS arch, coalesce(n.version, o.version) AS version,
  'online' AS status, coalesce(n.ts, o.last_seen) AS last_seen, coalesce(o.created_at, n.first_time) AS created_at
FROM (SELECT * FROM agents WHERE c_mktsegment <> 'BUILDING') o FULL JOIN newest n ON n.id = o.id"""

RULE_REQUESTS_SQL = """
requests AS (
  SELECT p_partkey, p_brand, CASE WHEN p_size % 3 = 0 THEN '' ELSE 'rule-' || p_partkey END AS id,
    CASE WHEN p_size % 11 = 0 THEN ' ' || chr(9) || chr(10) ELSE p_name END AS name, lower(p_type) AS metric,
    [ '>', '>=', '<', '<=', '==', ' '][p_size % 6 + 1] AS operator, p_retailprice AS threshold,
    p_size AS duration_seconds, p_size * 2 AS for_duration_seconds,
    CASE WHEN p_size % 2 = 0 THEN 'warning' ELSE 'critical' END AS severity, p_size % 4 <> 0 AS enabled,
    CASE WHEN p_size % 2 = 0 THEN '' ELSE 'critical' END AS asked_severity
  FROM part
), valid AS (SELECT * FROM requests WHERE trim(name, ' ' || chr(9) || chr(10)) <> '' AND trim(operator) <> '')"""

RULE_OUT_SQL = "name, metric, operator, round(threshold, 9) AS threshold, for_duration_seconds, severity, enabled"

# The made-up id hashes the request; numbers are spelt the way Spark casts them to text.
RULE_ID_SQL = id_sql(
    "'rule-' || metric", "name", "metric", "operator", "CAST(threshold AS VARCHAR)", "duration_seconds", "for_duration_seconds", "0",
    "severity", "CASE WHEN enabled THEN 'true' ELSE 'false' END",
)
RULES_SQL = f"""
WITH {RULE_REQUESTS_SQL}
SELECT DISTINCT CASE WHEN id <> '' THEN id ELSE {RULE_ID_SQL} END AS id, {RULE_OUT_SQL}
FROM valid"""

RULES_UPDATED_SQL = f"""
WITH {RULE_REQUESTS_SQL}
SELECT 'rule-' || p_partkey AS id, CASE WHEN p_brand = 'Brand#2' THEN ' ' ELSE name END AS name, metric, operator,
  round(threshold, 9) AS threshold, for_duration_seconds, severity, enabled, TIMESTAMP '2024-01-01 00:00:00' AS created_at,
  CASE WHEN p_brand = 'Brand#2' THEN TIMESTAMP '2024-01-31 00:30:00' ELSE TIMESTAMP '2024-01-01 00:00:00' END AS updated_at
FROM valid"""

RULES_SEEDED_SQL = f"""
WITH {RULE_REQUESTS_SQL}
SELECT 'rule-' || p_partkey AS id, name, metric, round(threshold, 9) AS threshold, severity FROM valid
UNION ALL SELECT id, name, metric, threshold, severity FROM (VALUES
  {rules_sql()}) defaults(id, name, metric, operator, threshold, hold, severity)"""

CHANNELS_SQL = f"""
WITH requests AS (
  SELECT page_id, CASE WHEN page_id % 13 = 0 THEN ' ' ELSE ' page ' || page_id END AS name,
    ['webhook', 'slack_webhook', chr(9), 'pager', ' webhook' || chr(10)][page_id % 5 + 1] AS type,
    CASE page_id % 12 WHEN 0 THEN ' ' || chr(8195) || chr(10) WHEN 1 THEN 'ftp://files.example.com/' || page_id
      WHEN 2 THEN 'not-a-url-' || page_id WHEN 3 THEN 'HTTPS://Hooks.example.com/' || page_id
      ELSE ' ' || url || ' ' END AS url
  FROM pages
)
SELECT DISTINCT {id_sql("'chan'", 'name', 'url', 'type')} AS id, {strip_sql('name')} AS name,
  coalesce(nullif({strip_sql('type')}, ''), 'webhook') AS type,
  CASE page_id % 12 WHEN 0 THEN NULL WHEN 2 THEN NULL WHEN 3 THEN 'https://Hooks.example.com/' || page_id ELSE {strip_sql('url')} END AS url,
  CASE WHEN page_id % 2 = 0 THEN 's-' || page_id ELSE '' END AS secret, page_id % 7 <> 0 AS enabled,
  CASE WHEN {strip_sql('name')} = '' THEN 'missing_name' WHEN {strip_sql('url')} = '' THEN 'missing_url'
    WHEN page_id % 12 = 2 THEN 'bad_url' WHEN page_id % 12 = 1 THEN 'bad_scheme'
    WHEN {strip_sql('type')} = 'pager' THEN 'bad_type' END AS reject_reason
FROM requests"""

DOCUMENTS_SQL = f"""
WITH {AGENTS_SQL}
SELECT id, CAST(json_object('id', id, 'name', name, 'hostname', hostname, 'os', os, 'arch', arch, 'version', version,
  'status', status, 'last_seen', strftime(last_seen, '%Y-%m-%dT%H:%M:%SZ'),
  'created_at', strftime(created_at, '%Y-%m-%dT%H:%M:%SZ')) AS VARCHAR) AS document
FROM agents"""

QUERIES = {
    "ingest_accepted": Entry(
        ingest_accepted,
        f"""{REASON_SQL} SELECT event_id AS id, 'agent-' || user_id AS agent_id,
  CASE WHEN kind = 14 THEN ts - INTERVAL 150 MINUTE ELSE ts END AS timestamp,
  CASE WHEN kind <> 12 THEN CAST(json_extract_string(props, '$.k') AS DOUBLE) END AS memory, ts AS created_at
FROM judged WHERE reject_reason IS NULL""",
    ),
    "ingest_rejected": Entry(
        ingest_rejected,
        f"""{REASON_SQL} SELECT event_id AS id, 'agent-' || user_id AS target_id, reject_reason
FROM judged WHERE reject_reason IS NOT NULL""",
    ),
    "telemetry_of_known_agents": Entry(
        telemetry_of_known_agents,
        f"SELECT event_id AS id, 'agent-' || user_id AS agent_id, ts AS timestamp FROM events WHERE user_id IN ({KNOWN_SQL})",
    ),
    "telemetry_of_unknown_agents": Entry(
        telemetry_of_unknown_agents,
        f"SELECT event_id AS id, 'agent-' || user_id AS agent_id, ts AS timestamp FROM events WHERE user_id NOT IN ({KNOWN_SQL})",
    ),
    "agents_upsert": Entry(agents_upsert, UPSERT_SQL),
    "registrations_refused": Entry(
        registrations_refused,
        """SELECT 'agent-' || user_id AS id, ts AS event_time, event_id AS seq FROM events
WHERE event_type = 'signup' AND event_id % 17 = 0""",
    ),
    "agents_by_ids": Entry(
        agents_by_ids,
        """SELECT DISTINCT 'agent-' || e.user_id AS id, c.c_name AS name FROM events e
LEFT JOIN customer c ON c.c_custkey = e.user_id AND c.c_mktsegment <> 'BUILDING'""",
    ),
    "rules_listed": Entry(
        rules_listed,
        f"""WITH {RULE_REQUESTS_SQL} SELECT 'rule-' || p_partkey AS id, TIMESTAMP '2024-01-01 00:00:00' AS created_at FROM valid
UNION ALL SELECT id, TIMESTAMP '2024-01-31 00:30:00' FROM (VALUES
  {rules_sql()}) defaults(id, name, metric, operator, threshold, hold, severity)""",
    ),
    "channels_listed": Entry(channels_listed, f"SELECT id, name, type FROM ({CHANNELS_SQL}) c WHERE reject_reason IS NULL"),
    "agent_documents": Entry(agent_documents, DOCUMENTS_SQL),
    "rules_normalized": Entry(rules_normalized, RULES_SQL),
    "rules_refused": Entry(
        rules_refused,
        f"WITH {RULE_REQUESTS_SQL} SELECT p_partkey AS seq, name, operator FROM requests WHERE trim(name, ' ' || chr(9) || chr(10)) = '' OR trim(operator) = ''",
    ),
    "rules_updated": Entry(rules_updated, RULES_UPDATED_SQL),
    "rules_seeded": Entry(rules_seeded, RULES_SEEDED_SQL),
    "channels_normalized": Entry(channels_normalized, CHANNELS_SQL),
}
