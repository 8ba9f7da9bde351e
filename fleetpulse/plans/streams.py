"""Streaming twins of batch queries, run over the events table as a file stream."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from fleetpulse.functions.clock import instant
from fleetpulse.plans import alerts as W
from fleetpulse.plans.alerts import BASE_SQL, EPISODE_COLUMNS, EPISODES_SQL, HOLD_SECONDS, RULES_SQL, TICK_START, TICK_STEP
from fleetpulse.plans import changes as C
from fleetpulse.plans import intake as K
from fleetpulse.plans.fleet import HEALTHY, STALE
from fleetpulse.plans.common import AS_OF_SQL, TELEMETRY_SQL, Entry
from fleetpulse.plans.rollups import ROLLUP_COLUMNS_SQL
from fleetpulse.session import scratch_dir
from fleetpulse.operators.retention import read_rollup
from fleetpulse.operators.rollup import hourly_rollup
from fleetpulse.operators import alerting as A
from fleetpulse.sources import benchmark_tables as B
from fleetpulse.sources.payloads import stream_payloads
from fleetpulse.sources.tables import read_telemetry
from fleetpulse.streaming import ack_stream as Q
from fleetpulse.streaming import alert_stream as L
from fleetpulse.streaming import keyed_alerts as S
from fleetpulse.streaming import log_stream as G
from fleetpulse.streaming import rollup_stream as H
from fleetpulse.streaming import touched as P
from fleetpulse.streaming.ingest_stream import start_ingest


def telemetry_stream(spark, sf_dir):
    """The events as a file stream; as a pattern the path may be one file or a folder of them."""
    events = spark.readStream.schema(B.EVENTS).parquet(f"{sf_dir}/events.parque[t]")
    return B.events_as_telemetry(events)


def agent_stream(spark, sf_dir):
    """Registrations (id, at) of the agents, as a file stream."""
    customers = spark.readStream.schema("c_custkey long").parquet(f"{sf_dir}/customer.parque[t]")
    at = F.timestamp_add("MINUTE", F.col("c_custkey").cast("int"), instant("2023-12-01T00:00:00"))
    return customers.select(F.concat(F.lit("agent-"), F.col("c_custkey").cast("string")).alias("id"), at.alias("at"))


def stream_rollup(spark, sf_dir):
    root = scratch_dir(spark, "stream-rollup")
    rollup = H.hourly_rollup_stream(telemetry_stream(spark, sf_dir))
    H.start_append(rollup, f"{root}/table", f"{root}/checkpoint").awaitTermination()
    return spark.read.schema(rollup.schema).parquet(f"{root}/table")


def stream_alerts(spark, sf_dir):
    root = scratch_dir(spark, "stream-alerts")
    rules = lambda: B.rules(spark, HOLD_SECONDS)
    L.start_alerts(telemetry_stream(spark, sf_dir), rules, root, f"{root}/checkpoint").awaitTermination()
    return L.streamed_episodes(spark, root)


def appended(spark, changes, root):
    """The changes of a keyed stream, after it has taken what is there."""
    H.start_append(changes, f"{root}/table", f"{root}/checkpoint").awaitTermination()
    return S.episodes(spark.read.schema(changes.schema).parquet(f"{root}/table"))


def stream_alerts_keyed(spark, sf_dir):
    samples = A.metric_samples(telemetry_stream(spark, sf_dir))
    changes = S.alert_changes(A.evaluate(samples, B.rules(spark, HOLD_SECONDS)))
    return appended(spark, changes, scratch_dir(spark, "stream-alerts-keyed"))


def stream_offline(spark, sf_dir):
    """Registrations and snapshots as streams; agents fall silent without a row that says so."""
    changes = S.offline_changes(agent_stream(spark, sf_dir), telemetry_stream(spark, sf_dir), B.rules(spark), TICK_START, TICK_STEP, HEALTHY, STALE)
    return appended(spark, changes, scratch_dir(spark, "stream-offline"))


def stream_event_log(spark, sf_dir):
    """Five sources as file streams into one log."""
    root = scratch_dir(spark, "stream-log")
    streams = {"telemetry": telemetry_stream(spark, sf_dir)}
    for name, rows in C.log_sources(spark, sf_dir).items():
        rows.write.parquet(f"{root}/{name}")
        streams[name] = spark.readStream.schema(rows.schema).parquet(f"{root}/{name}")
    changes = [C.CHANGES[name](rows) for name, rows in streams.items()]
    G.start_log(changes, f"{root}/log", f"{root}/checkpoint", B.AS_OF).awaitTermination()
    return C.one_value_each(G.read_log(spark, f"{root}/log", changes[0]))


def stream_acknowledgements(spark, sf_dir):
    """Firings, resolutions and commands as streams; every command up to the watermark with what became of it."""
    root = scratch_dir(spark, "stream-acks")
    alerts = W.stored_alerts(spark, sf_dir)
    happened = F.array(F.struct(F.lit(Q.FIRING).alias("kind"), F.col("started_at").alias("at")), F.struct(F.lit(Q.RESOLVED).alias("kind"), F.col("resolved_at").alias("at")))
    inputs = {"changes": alerts.select(F.col("id").alias("alert_id"), F.inline(happened)).where("at IS NOT NULL"), "commands": W.ack_commands(alerts)}
    streams = []
    for name, rows in inputs.items():
        rows.write.parquet(f"{root}/{name}")
        streams.append(spark.readStream.schema(rows.schema).parquet(f"{root}/{name}"))
    told = Q.acknowledgement_decisions(*streams)
    H.start_append(told, f"{root}/table", f"{root}/checkpoint").awaitTermination()
    return spark.read.schema(told.schema).parquet(f"{root}/table").drop("comment")


def stream_rollup_late(spark, sf_dir):
    """Stored telemetry with its rollup kept up by touched hours: first the rows in time, then those that come days late."""
    root = scratch_dir(spark, "stream-late")
    events = B.table(spark, sf_dir, "events")
    as_of = datetime.fromisoformat(B.AS_OF)
    for part, late in enumerate((False, True)):
        events.where((F.col("event_id") % 7 == 3) == late).write.parquet(f"{root}/in/part={part}")
        stream = B.events_as_telemetry(spark.readStream.schema(B.EVENTS).parquet(f"{root}/in/part=*"))
        P.start_store(stream, f"{root}/raw", f"{root}/ledger", f"{root}/checkpoint").awaitTermination()
        P.patch_rollup(spark, f"{root}/raw", f"{root}/rollup", f"{root}/ledger", as_of)
    return read_rollup(spark, f"{root}/rollup").drop("bucket_date")


def ingest_to_rollup(spark, sf_dir):
    """Payload files through the ingest stream into stored telemetry, and that into the rollup."""
    root = scratch_dir(spark, "ingest")
    K.payloads(spark, sf_dir).select("payload").write.text(f"{root}/in")
    agents = lambda: K.registered_agents(spark, sf_dir)
    start_ingest(stream_payloads(spark, f"{root}/in"), agents, f"{root}/out", f"{root}/checkpoint", arrived=B.AS_OF).awaitTermination()
    return hourly_rollup(read_telemetry(spark, f"{root}/out/accepted"), B.AS_OF)


QUERIES = {
    "ingest_to_rollup": Entry(
        ingest_to_rollup,
        f"""{K.REASON_SQL}, {TELEMETRY_SQL}, taken AS (
  SELECT t.agent_id, CASE WHEN kind = 14 THEN t.ts - INTERVAL 150 MINUTE ELSE t.ts END AS ts,
    CASE WHEN kind <> 12 THEN cpu_sql END AS cpu_sql, CASE WHEN kind <> 12 THEN t.memory END AS memory,
    CASE WHEN kind <> 12 THEN root_disk END AS root_disk, CASE WHEN kind <> 12 THEN received ELSE 0 END AS received,
    CASE WHEN kind <> 12 THEN sent ELSE 0 END AS sent
  FROM judged j JOIN telemetry t ON t.id = j.event_id WHERE reject_reason IS NULL)
SELECT agent_id, date_trunc('hour', ts)::TIMESTAMP AS bucket_start, {ROLLUP_COLUMNS_SQL}
FROM taken WHERE ts < date_trunc('hour', {AS_OF_SQL}) GROUP BY ALL""",
    ),
    "stream_rollup": Entry(
        stream_rollup,
        f"""
WITH {TELEMETRY_SQL}
SELECT agent_id, date_trunc('hour', ts)::TIMESTAMP AS bucket_start, {ROLLUP_COLUMNS_SQL}
FROM telemetry
WHERE date_trunc('hour', ts) + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE
GROUP BY ALL""",
    ),
    "stream_alerts": Entry(
        stream_alerts,
        f"""{BASE_SQL}, {EPISODES_SQL}
SELECT rule_id, agent_id, started_at, started_id, round(started_value, 9) AS started_value,
  resolved_at, resolved_id, round(resolved_value, 9) AS resolved_value FROM episodes""",
    ),
    "stream_acknowledgements": Entry(
        stream_acknowledgements,
        f"""{W.ALERT_CTES}, {W.ACKS_SQL}, ended AS (
  SELECT max(t) - INTERVAL 10 MINUTE AS passed FROM (
    SELECT "at" AS t FROM commands UNION ALL SELECT started_at FROM alerts UNION ALL SELECT resolved_at FROM alerts))
SELECT c.alert_id, c.seq::BIGINT AS seq, c."at", CASE WHEN w.seq IS NOT NULL THEN coalesce(nullif(c.who, ''), 'operator') ELSE c.who END AS user,
  w.seq IS NOT NULL AS accepted, CASE WHEN w.seq IS NOT NULL THEN NULL WHEN a.id IS NULL THEN 'no_such_alert'
    WHEN c."at" < a.started_at THEN 'too_early' WHEN c."at" >= a.resolved_at THEN 'resolved' ELSE 'acknowledged' END AS reason
FROM commands c LEFT JOIN alerts a ON a.id = c.alert_id LEFT JOIN winners w ON w.alert_id = c.alert_id AND w.seq = c.seq
WHERE c."at" < (SELECT passed FROM ended)""",
    ),
    "stream_rollup_late": Entry(
        stream_rollup_late,
        f"""WITH {TELEMETRY_SQL}
SELECT agent_id, date_trunc('hour', ts)::TIMESTAMP AS bucket_start, {ROLLUP_COLUMNS_SQL}
FROM telemetry WHERE ts < date_trunc('hour', {AS_OF_SQL}) GROUP BY ALL""",
    ),
    "stream_event_log": Entry(stream_event_log, C.LOG_SQL),
    "stream_alerts_keyed": Entry(stream_alerts_keyed, f"{BASE_SQL}, {EPISODES_SQL} SELECT {EPISODE_COLUMNS} FROM episodes"),
    "stream_offline": Entry(
        stream_offline,
        f"""
WITH {RULES_SQL}, ticks AS (
  SELECT 'agent-' || c_custkey AS agent_id, c_custkey, i AS id, TIMESTAMP '{TICK_START}' + to_hours({TICK_STEP // 3600} * i) AS clock
  FROM customer, range(1000) r(i)
  WHERE TIMESTAMP '{TICK_START}' + to_hours({TICK_STEP // 3600} * i) <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE
), states AS MATERIALIZED (
  SELECT agent_id, id, clock, ts AS seen FROM ticks t ASOF LEFT JOIN events e ON e.user_id = t.c_custkey AND t.clock >= e.ts
), evals AS (
  SELECT rule_id, agent_id, clock, id, breaching, hold AS hold_seconds, CASE WHEN breaching THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS value
  FROM (SELECT *, seen IS NULL OR (epoch_us(clock) - epoch_us(seen)) // 1000000 >= {STALE} AS breaching FROM states),
    (SELECT * FROM rules WHERE metric = 'agent_offline')
), {EPISODES_SQL}
SELECT {EPISODE_COLUMNS} FROM episodes""",
    ),
}
