"""Notification ledger queries."""

from __future__ import annotations

import hashlib

from pyspark.sql import functions as F

from fleetpulse.operators import notify as N
from fleetpulse.plans.alerts import ALERT_CTES, stored_alerts
from fleetpulse.plans.common import Entry, id_sql
from fleetpulse.sources import benchmark_tables as B
from fleetpulse.sources.tables import materialized

ROUNDS = [f"2024-02-01T00:0{n}:00" for n in range(3)]
DUE_AT = "2024-01-15T00:00:00"
HEX = "0123456789abcdef"

# Answers of a receiver, chosen by the first digit of the delivery id.
OUTCOMES = [[200], [503, 200], [503, 503, 503], [503], []]


def planned(spark, sf_dir):
    return N.plan_deliveries(N.alert_events(stored_alerts(spark, sf_dir)), B.channels(spark))


def digit():
    return F.instr(F.lit(HEX), F.substring("id", 5, 1)) - 1


def attempts(deliveries):
    """Attempt rows ten seconds apart, as the receiver answered them."""
    codes = F.element_at(F.array(*[F.array(*map(F.lit, o)).cast("array<int>") for o in OUTCOMES]), digit() % len(OUTCOMES) + 1)
    return deliveries.select("id", "created_at", "channel", F.posexplode(codes).alias("n", "code")).select(
        F.col("id").alias("delivery_id"),
        (F.col("n") + 1).alias("attempt"),
        F.col("code").alias("response_status"),
        F.when(N.succeeded(F.col("code")), "").otherwise(N.failure_text(F.col("code"), F.col("channel.type"))).alias("error_message"),
        F.timestamp_add("SECOND", (F.col("n") + 1) * 10, "created_at").alias("at"),
    )


def ledger(spark, sf_dir):
    deliveries = materialized(planned(spark, sf_dir), "deliveries")
    return N.fold_attempts(deliveries, attempts(deliveries))


LEDGER_COLUMNS = [
    "id", "channel_id", "alert_id", "event_type", "status", "attempts",
    "response_status", "error_message", "created_at", "sent_at",
]


def delivery_plan(spark, sf_dir):
    return planned(spark, sf_dir).select(*LEDGER_COLUMNS)


def delivery_requests(spark, sf_dir):
    return N.build_requests(planned(spark, sf_dir)).select("delivery_id", "url", "body")


def webhook_signature(spark, sf_dir):
    signed = N.build_requests(planned(spark, sf_dir)).where(F.col("signature").isNotNull())
    return signed.select("delivery_id", "channel_id", "signature")


def answer(url, body, signature, delivery_id):
    code = OUTCOMES[HEX.index(delivery_id[4]) % len(OUTCOMES)]
    if not code:
        raise TimeoutError("no answer")
    return code[0]


def delivery_attempts(spark, sf_dir):
    requests = materialized(N.build_requests(planned(spark, sf_dir)), "requests")
    return N.attempt(requests, answer, B.AS_OF)


def delivery_rounds(spark, sf_dir):
    """Sent, sent again when due, until every delivery is delivered or failed."""
    return N.deliver(planned(spark, sf_dir), answer, ROUNDS)[0].select(*LEDGER_COLUMNS, "next_attempt_at")


def delivery_status(spark, sf_dir):
    return ledger(spark, sf_dir).select(*LEDGER_COLUMNS, "next_attempt_at")


def delivery_due(spark, sf_dir):
    return N.due(ledger(spark, sf_dir), DUE_AT).select("id", "attempts", "next_attempt_at")


def deliveries_newest(spark, sf_dir):
    return N.list_deliveries(ledger(spark, sf_dir)).select(*LEDGER_COLUMNS)


def pad_hex(secret: str, constant: int) -> str:
    key = secret.encode()
    if len(key) > 64:
        key = hashlib.sha256(key).digest()
    return bytes(b ^ constant for b in key.ljust(64, b"\0")).hex()


EVENTS_SQL = """
occasions AS (
  SELECT id AS alert_id, rule_id, agent_id, rule_name, severity, started_at, message, created_at, 'alert.firing' AS event_type,
    started_at AS "at", 'firing' AS status, started_value AS last_value, NULL::TIMESTAMP AS resolved_at, started_at AS updated_at
  FROM alerts
  UNION ALL SELECT id, rule_id, agent_id, rule_name, severity, started_at, message, created_at, 'alert.resolved',
    resolved_at, 'resolved', last_value, resolved_at, resolved_at
  FROM alerts WHERE resolved_at IS NOT NULL
)"""

PLAN_SQL = f"""
{EVENTS_SQL}, channels(channel_id, type, url) AS (VALUES ('chan-signed', 'webhook', 'https://hooks.example.com/a'),
  ('chan-plain', 'webhook', 'https://hooks.example.com/b'), ('chan-chat', 'slack_webhook', 'https://chat.example.com/c')
), deliveries AS (
  SELECT {id_sql("'del'", 'alert_id', 'event_type', 'channel_id')} AS id,
    {id_sql("'notif'", 'alert_id', 'event_type')} AS notification_id, channel_id, type, url,
    o.* EXCLUDE (created_at), "at" AS created_at, o.created_at AS alert_created_at
  FROM occasions o CROSS JOIN channels
)"""


def time_sql(c: str) -> str:
    """UTC text, the fraction without trailing zeros and left out when it is zero."""
    return f"""(strftime({c}, '%Y-%m-%dT%H:%M:%S') || CASE WHEN epoch_us({c}) % 1000000 = 0 THEN ''
      ELSE '.' || rtrim(strftime({c}, '%f'), '0') END || 'Z')"""


BODY_SQL = f"""
bodies AS (
  SELECT *, CASE WHEN type = 'slack_webhook' THEN CAST(json_object('text',
      CASE event_type WHEN 'alert.firing' THEN '🚨' ELSE '✅' END || ' *Notification: ' || event_type || '*' || chr(10)
      || 'Event: `' || event_type || '` | Time: `' || strftime("at", '%Y-%m-%dT%H:%M:%SZ') || '`') AS VARCHAR)
    WHEN resolved_at IS NULL THEN CAST(json_object('id', notification_id, 'event', event_type, 'timestamp', {time_sql('"at"')},
      'alert', json_object('id', alert_id, 'rule_id', rule_id, 'agent_id', agent_id, 'rule_name', rule_name,
        'severity', severity, 'status', status, 'started_at', {time_sql('started_at')}, 'last_value', last_value,
        'message', message, 'created_at', {time_sql('alert_created_at')}, 'updated_at', {time_sql('updated_at')})) AS VARCHAR)
    ELSE CAST(json_object('id', notification_id, 'event', event_type, 'timestamp', {time_sql('"at"')},
      'alert', json_object('id', alert_id, 'rule_id', rule_id, 'agent_id', agent_id, 'rule_name', rule_name,
        'severity', severity, 'status', status, 'started_at', {time_sql('started_at')}, 'resolved_at', {time_sql('resolved_at')},
        'last_value', last_value, 'message', message, 'created_at', {time_sql('alert_created_at')},
        'updated_at', {time_sql('updated_at')})) AS VARCHAR) END AS body
  FROM deliveries
)"""

LEDGER_SQL = f"""
{PLAN_SQL}, kinds AS (SELECT *, (strpos('{HEX}', substr(id, 5, 1)) - 1) % 5 AS kind FROM deliveries),
tried AS (
  SELECT *, CASE kind WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 3 WHEN 3 THEN 1 ELSE 0 END AS attempts FROM kinds
), ledger AS (
  SELECT id, channel_id, alert_id, event_type, created_at, CAST(attempts AS INTEGER) AS attempts,
    CASE WHEN kind IN (0, 1) THEN 'delivered' WHEN kind = 2 THEN 'failed' ELSE 'pending' END AS status,
    CAST(CASE WHEN kind IN (0, 1) THEN 200 WHEN kind IN (2, 3) THEN 503 ELSE 0 END AS INTEGER) AS response_status,
    CASE WHEN kind NOT IN (2, 3) THEN '' WHEN type = 'slack_webhook' THEN 'slack webhook responded with HTTP 503'
      ELSE 'webhook responded with HTTP 503' END AS error_message,
    CASE WHEN kind IN (0, 1) THEN created_at + to_seconds(attempts * 10) END AS sent_at,
    CASE WHEN kind = 3 THEN created_at + to_seconds(attempts * 10 + attempts * attempts) WHEN kind = 4 THEN created_at END AS next_attempt_at
  FROM tried
)"""

LEDGER_OUT_SQL = ", ".join(LEDGER_COLUMNS)

QUERIES = {
    "delivery_plan": Entry(
        delivery_plan,
        f"""{ALERT_CTES}, {PLAN_SQL} SELECT id, channel_id, alert_id, event_type, 'pending' AS status, 0 AS attempts,
  0 AS response_status, '' AS error_message, created_at, NULL::TIMESTAMP AS sent_at FROM deliveries""",
    ),
    "delivery_requests": Entry(
        delivery_requests, f"{ALERT_CTES}, {PLAN_SQL}, {BODY_SQL} SELECT id AS delivery_id, url, body FROM bodies"
    ),
    "webhook_signature": Entry(
        webhook_signature,
        f"""{ALERT_CTES}, {PLAN_SQL}, {BODY_SQL} SELECT id AS delivery_id, channel_id,
  'sha256=' || sha256(unhex('{pad_hex("super-secret-key", 0x5C)}')
    || unhex(sha256(unhex('{pad_hex("super-secret-key", 0x36)}') || encode(body)))) AS signature
FROM bodies WHERE channel_id = 'chan-signed'""",
    ),
    "delivery_attempts": Entry(
        delivery_attempts,
        f"""{ALERT_CTES}, {LEDGER_SQL} SELECT id AS delivery_id, 1 AS attempt,
  CASE WHEN kind = 0 THEN 200 WHEN kind = 4 THEN 0 ELSE 503 END AS response_status,
  CASE WHEN kind = 4 THEN 'no answer' WHEN kind = 0 THEN '' WHEN type = 'slack_webhook' THEN 'slack webhook responded with HTTP 503'
    ELSE 'webhook responded with HTTP 503' END AS error_message, TIMESTAMP '2024-01-31 00:30:00' AS "at" FROM kinds""",
    ),
    "delivery_rounds": Entry(
        delivery_rounds,
        f"""{ALERT_CTES}, {LEDGER_SQL} SELECT id, channel_id, alert_id, event_type, created_at, CASE WHEN kind = 0 THEN 1 ELSE 3 END AS attempts,
  CASE WHEN kind = 0 THEN 'delivered' ELSE 'failed' END AS status,
  CASE WHEN kind = 0 THEN 200 WHEN kind = 4 THEN 0 ELSE 503 END AS response_status,
  CASE WHEN kind = 4 THEN 'no answer' WHEN kind = 0 THEN '' WHEN type = 'slack_webhook' THEN 'slack webhook responded with HTTP 503'
    ELSE 'webhook responded with HTTP 503' END AS error_message,
  CASE WHEN kind = 0 THEN TIMESTAMP '2024-02-01 00:00:00' END AS sent_at, NULL::TIMESTAMP AS next_attempt_at FROM kinds""",
    ),
    "delivery_status": Entry(
        delivery_status, f"{ALERT_CTES}, {LEDGER_SQL} SELECT {LEDGER_OUT_SQL}, next_attempt_at FROM ledger"
    ),
    "delivery_due": Entry(
        delivery_due,
        f"""{ALERT_CTES}, {LEDGER_SQL} SELECT id, attempts, next_attempt_at FROM ledger
WHERE status = 'pending' AND next_attempt_at <= TIMESTAMP '{DUE_AT}'""",
    ),
    "deliveries_newest": Entry(
        deliveries_newest,
        f"{ALERT_CTES}, {LEDGER_SQL} SELECT {LEDGER_OUT_SQL} FROM ledger ORDER BY created_at DESC, id LIMIT 50",
    ),
}
