"""Payload checks, registry upserts and channel normalization on small frames."""

import json
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from fleetpulse import model
from fleetpulse.functions import documents as D
from fleetpulse.operators import ingest as G
from fleetpulse.operators import registry as R
from fleetpulse.operators.registry import literal_rows
from fleetpulse.operators.retention import read_rollup, run_retention
from fleetpulse.sources import payloads as P
from fleetpulse.sources.tables import purge_telemetry, read_telemetry, store_batch
from fleetpulse.streaming.alert_stream import start_alerts, streamed_episodes
from fleetpulse.streaming.ingest_stream import start_ingest, stored_rows

T = '"timestamp":"2026-08-08T18:00:00Z"'
OK = '"agent_id":"agent-1",' + T
PAYLOADS = [
    ('{%s,"metrics":{"cpu":10.5}}' % OK, "agent-1", None),
    ('{%s,"metrics":{}}' % OK, "agent-1", None),
    ('{%s,"metrics":{}} and more' % OK, "agent-1", None),
    ('{%s,"metrics":{}}' % OK, "agent-2", "agent_mismatch"),
    ('{"agent_id":"agent-3",%s,"metrics":{}}' % T, "agent-3", "agent_not_found"),
    ('{%s,"metrics":{},"x":1}' % OK, "agent-1", "unknown_field"),
    ('{%s,"metrics":null}' % OK, "agent-1", "missing_metrics"),
    ("{%s}" % OK, "agent-1", "missing_metrics"),
    ('{%s,"metrics":[1]}' % OK, "agent-1", "bad_metrics"),
    ('{%s,"metrics":"m"}' % OK, "agent-1", "bad_metrics"),
    ('{"agent_id":" ",%s,"metrics":{}}' % T, "agent-1", "missing_agent_id"),
    ('{"agent_id":null,%s,"metrics":{}}' % T, "agent-1", "missing_agent_id"),
    ('{%s,"metrics":{}}' % T, "agent-1", "missing_agent_id"),
    ('{"agent_id":5,%s,"metrics":{}}' % T, "agent-1", "bad_agent_id"),
    ('{"agent_id":"agent-1","metrics":{}}', "agent-1", "missing_timestamp"),
    ('{"agent_id":"agent-1","timestamp":null,"metrics":{}}', "agent-1", "missing_timestamp"),
    ('{"agent_id":"agent-1","timestamp":"0001-01-01T00:00:00Z","metrics":{}}', "agent-1", "missing_timestamp"),
    ('{"agent_id":"agent-1","timestamp":"2026-08-08","metrics":{}}', "agent-1", "bad_timestamp"),
    ('{"agent_id":"agent-1","timestamp":17,"metrics":{}}', "agent-1", "bad_timestamp"),
    ('{"agent_id":"agent-1","timestamp":"","metrics":{}}', "agent-1", "bad_timestamp"),
    ('{"agent_id":"agent-1","agent_id":"agent-1",%s,"metrics":{}}' % T, "agent-1", "malformed_json"),
    ("[]", "agent-1", "not_an_object"),
    ("7", "agent-1", "not_an_object"),
    ("null", "agent-1", "missing_agent_id"),
    ("{", "agent-1", "malformed_json"),
    ("", "agent-1", "malformed_json"),
]


def agents(spark):
    return literal_rows(spark, [("agent-1",), ("agent-2",)], ["id"])


def test_reasons(spark):
    df = spark.createDataFrame(PAYLOADS, "payload string, target string, want string")
    judged = G.judge(df, agents(spark), target="target").select("payload", "target", "reject_reason")
    assert sorted(map(repr, map(tuple, judged.collect()))) == sorted(map(repr, PAYLOADS))


def test_split_covers_every_payload(spark):
    df = spark.createDataFrame(PAYLOADS, "payload string, target string, want string").drop("want")
    judged = G.judge(df, agents(spark), target="target")
    taken = G.accepted(judged, "2026-08-08T18:00:01").collect()
    assert len(taken) == 3 and G.rejected(judged).count() == len(PAYLOADS) - 3
    assert {r.created_at.second for r in taken} == {1}


def test_without_target_no_mismatch(spark):
    df = spark.createDataFrame([(PAYLOADS[3][0],)], "payload string")
    assert G.judge(df, agents(spark)).first().reject_reason is None


def test_payload_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    lines = [p for p, target, _ in PAYLOADS if p]
    for n in range(3):
        (tmp_path / "in" / f"{n}.jsonl").write_text("\n".join(lines[n::3]) + "\n")
    stream = P.stream_payloads(spark, str(tmp_path / "in"), max_files=1)
    out = str(tmp_path / "out")
    start_ingest(stream, lambda: agents(spark), out, str(tmp_path / "cp")).awaitTermination()
    taken, refused = spark.read.parquet(f"{out}/accepted"), spark.read.parquet(f"{out}/rejected")
    whole = G.judge(P.read_payloads(spark, str(tmp_path / "in")), agents(spark))
    assert taken.count() + refused.count() == len(lines) == whole.count()
    assert taken.count() == G.accepted(whole).count()
    assert set(model.TELEMETRY.names) | {"event_date", "batch"} == set(taken.columns)
    assert refused.select("batch").distinct().count() == 3


def test_a_replayed_batch_replaces_itself(spark, tmp_path):
    out = str(tmp_path / "t")
    rows = stored_rows(G.judge(spark.createDataFrame([(p,) for p, target, _ in PAYLOADS if p], "payload string"), agents(spark)), "2026-08-08T18:00:01")
    for batch in (0, 1, 1, 0):
        store_batch(rows, out, batch)
    stored = read_telemetry(spark, out)
    assert stored.count() == 2 * rows.count() and stored.select("id").distinct().count() == rows.select("id").distinct().count()


def test_ingest_feeds_alerts_rollup_and_purge(spark, tmp_path):
    """Payload files in; the other jobs read what the ingest stream stored."""
    (tmp_path / "in").mkdir()
    for day in range(3):
        lines = [
            f'{{"agent_id":"a","timestamp":"2026-08-0{day + 1}T{h:02d}:{m}:00Z","metrics":{{"system":{{"cpu":{{"usage_percent":{90 if h == 5 else 10}}}}}}}}}'
            for h in range(24)
            for m in ("00", "30")
        ]
        (tmp_path / "in" / f"{day}.jsonl").write_text("\n".join([*lines, "not json"]) + "\n")
    known = lambda: spark.createDataFrame([("a",)], "id string")
    out, hourly = str(tmp_path / "out"), str(tmp_path / "hourly")
    stream = P.stream_payloads(spark, str(tmp_path / "in"), max_files=1)
    start_ingest(stream, known, out, str(tmp_path / "cp")).awaitTermination()
    accepted = f"{out}/accepted"
    assert read_telemetry(spark, accepted).count() == 3 * 48
    assert read_telemetry(spark, accepted, "2026-08-02", "2026-08-02").count() == 48

    telemetry = spark.readStream.schema(model.TELEMETRY).parquet(f"{accepted}/event_date=*/batch=*")
    rules = lambda: R.default_rules(spark, "2026-08-01T00:00:00")
    start_alerts(telemetry, rules, str(tmp_path / "alerts"), str(tmp_path / "cp2")).awaitTermination()
    episodes = streamed_episodes(spark, str(tmp_path / "alerts")).collect()
    assert len(episodes) == 3 and all((e.resolved_at - e.started_at).total_seconds() == 3600 for e in episodes)

    now = datetime(2026, 8, 4, tzinfo=timezone.utc)
    run_retention(spark, accepted, hourly, now, days=1, align="hour")
    assert read_rollup(spark, hourly).count() == 72
    assert read_telemetry(spark, accepted).count() == 48
    purge_telemetry(spark, accepted, datetime(2026, 8, 3, 12, 15, tzinfo=timezone.utc))
    assert read_telemetry(spark, accepted).count() == 23


def test_upsert_agents(spark, at):
    stored = spark.createDataFrame(
        [("a", "A", "h", "linux", "amd64", "1", "offline", at(0), at(0)), ("b", "B", "h", "linux", "amd64", "1", "offline", at(1), at(1))],
        model.AGENT,
    )
    requests = spark.createDataFrame(
        [("a", "A2", "h2", "linux", "amd64", "2", at(10), 1), ("a", "A3", "h3", "linux", "arm64", "3", at(10), 2),
         ("c", "C", "h", "linux", "amd64", "1", at(20), 3), ("c", "C0", "h", "linux", "amd64", "1", at(5), 4),
         ("d", "", "h", "linux", "amd64", "1", at(20), 5), ("e", "E", "h", None, "amd64", "1", at(20), 6)],
        "id string, name string, hostname string, os string, arch string, version string, event_time timestamp, seq bigint",
    )
    complete, refused = R.split_registrations(requests)
    assert {r.id for r in refused.collect()} == {"d", "e"}
    found = {r.id: r for r in R.upsert_agents(stored, complete).collect()}
    assert set(found) == {"a", "b", "c"}
    assert (found["a"].name, found["a"].version, found["a"].status) == ("A3", "3", "online")
    assert found["b"].status == "offline"
    assert found["c"].name == "C"
    key = lambda r: (r.created_at.timestamp(), r.last_seen.timestamp())
    local = {r.id: key(r) for r in stored.collect()}
    assert key(found["a"])[0] == local["a"][0] and key(found["b"]) == local["b"]
    assert key(found["c"])[1] - key(found["c"])[0] == 15
    listed = [r.id for r in R.oldest_first(R.upsert_agents(stored, complete)).collect()]
    assert listed == ["a", "b", "c"]
    assert R.by_id(stored, "b").count() == 1 and R.by_id(stored, "zzz").count() == 0


def rule_rows(spark, rows):
    columns = "id string, name string, metric string, operator string, threshold double, severity string"
    return spark.createDataFrame(rows, columns).withColumns(
        {"duration_seconds": F.lit(0), "for_duration_seconds": F.lit(0), "cooldown_seconds": F.lit(0), "enabled": F.lit(True)}
    )


def test_rules_are_created_updated_and_seeded(spark):
    asked = rule_rows(spark, [("", "n", "cpu_usage", ">", 1.0, ""), ("x", "n", "m", "<", 2.0, "info"), ("y", " ", "m", "<", 2.0, "info")])
    created, refused = R.new_rules(asked, "2024-01-01T00:00:00")
    found = {r.id: r for r in created.collect()}
    made = next(i for i in found if i != "x")
    assert made.startswith("rule-cpu_usage-") and found[made].severity == "warning" and found["x"].severity == "info"
    assert [r.id for r in refused.collect()] == ["y"]

    updates = rule_rows(spark, [("x", "", "", "", 9.0, ""), ("x", "old", "", "", 8.0, ""), ("nobody", "n", "m", ">", 1.0, "")])
    updates = updates.withColumn("seq", F.col("threshold"))
    updated = {r.id: r for r in R.update_rules(created, updates, "2024-01-02T00:00:00").collect()}
    assert set(updated) == set(found)
    assert (updated["x"].name, updated["x"].threshold, updated["x"].severity) == ("", 9.0, "warning")
    assert updated["x"].updated_at > updated["x"].created_at == found["x"].created_at
    assert updated[made] == found[made]

    own = created.withColumn("id", F.when(F.col("id") == "x", "rule-cpu-high").otherwise(F.col("id")))
    seeded = {r.id: r for r in R.seed_rules(own, "2024-01-03T00:00:00").collect()}
    assert len(seeded) == 5 and seeded["rule-cpu-high"].threshold == 2.0
    assert seeded["rule-agent-offline"].operator == "=="
    again = R.seed_rules(R.seed_rules(own, "2024-01-03T00:00:00"), "2024-01-04T00:00:00")
    assert again.count() == 5


CHANNELS = [
    ((" n ", None, " https://h.example.com/x?y=1 ", None, None), ("n", "webhook", "https://h.example.com/x?y=1", "", True, None)),
    (("n", "slack_webhook", "HTTP://h", " s ", False), ("n", "slack_webhook", "http://h", "s", False, None)),
    (("n", "webhook", "ftp://h/x", "", True), "bad_scheme"),
    (("n", "unsupported", "https://h/x", "", True), "bad_type"),
    ((" ", "webhook", "https://h/x", "", True), "missing_name"),
    (("n", "webhook", None, "", True), "missing_url"),
    (("n", "webhook", "h/x", "", True), "bad_url"),
    (("n", "webhook", "https://", "", True), "bad_url"),
]


@pytest.mark.parametrize(("request_row", "want"), CHANNELS)
def test_channels(spark, request_row, want):
    df = spark.createDataFrame([request_row], "name string, type string, url string, secret string, enabled boolean")
    row = R.normalize_channels(df, "2024-01-01T00:00:00").first()
    if isinstance(want, str):
        assert row.reject_reason == want
    else:
        assert (row.name, row.type, row.url, row.secret, row.enabled, row.reject_reason) == want


def test_documents_leave_empty_values_out(spark, at):
    row = spark.createDataFrame([("a", "", None, at(0))], "id string, rule_name string, resolved_at timestamp, started_at timestamp")
    text = row.select(F.to_json(D.alert_document(row.columns))).first()[0]
    assert json.loads(text) == {"id": "a", "started_at": "2023-11-14T22:13:20Z"}
    assert D.listing(row.where("id = 'none'"), "alert").collect() == []


def test_equal_requests_are_one_row(spark):
    rows = [("n", "webhook", "https://h/x", "s", True)] * 2 + [(" n ", "webhook", "https://h/x", "", None)]
    df = spark.createDataFrame(rows, "name string, type string, url string, secret string, enabled boolean")
    assert R.normalize_channels(df, "2024-01-01T00:00:00").count() == 2
    blank = spark.createDataFrame([("\t\u2003\n", "webhook", "https://h/x", "", True)], df.schema)
    assert R.normalize_channels(blank, "2024-01-01T00:00:00").first().reject_reason == "missing_name"


def test_lookup_of_many_ids(spark):
    found, missing = R.by_ids(agents(spark), spark.createDataFrame([("agent-1",), ("agent-1",), ("nobody",), (None,)], "id string"))
    assert [r.id for r in found.select("id").collect()] == ["agent-1"]
    assert [r.id for r in missing.collect()] == ["nobody"]
