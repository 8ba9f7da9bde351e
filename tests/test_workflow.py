"""Acknowledgement, comments, deliveries, change log, fleet reads and the rollup stream."""

import json

import pytest
from pyspark.sql import functions as F

from fleetpulse import model
from fleetpulse.operators import eventlog as E
from fleetpulse.operators import fleet as O
from fleetpulse.operators import incidents as I
from fleetpulse.operators import notify as N
from fleetpulse.operators import rollup as U
from fleetpulse.operators import series as S
from fleetpulse.operators.registry import literal_rows
from fleetpulse.streaming import rollup_stream as H

ALERT = "id string, rule_id string, agent_id string, started_at timestamp, resolved_at timestamp, started_value double, last_value double, message string, rule_name string, severity string, created_at timestamp"


def alerts(spark, at):
    return spark.createDataFrame(
        [
            ("x", "r", "a", at(100), at(200), 90.0, 10.0, "m", "Name", "warning", at(100)),
            ("y", "r", "a", at(300), None, 91.0, 91.0, "m", "Name", "warning", at(300)),
            ("z", "r", "b", at(0), None, 1.0, 1.0, "m", "Name", "warning", at(0)),
        ],
        ALERT,
    )


def commands(spark, at):
    rows = [
        ("x", "u0", "early", at(99), 1), ("x", "", "first", at(100), 3), ("x", "u2", "tie", at(100), 4), ("x", "u3", "late", at(200), 5),
        ("y", "u4", None, at(5000), 6), ("nobody", "u5", "lost", at(1), 7),
    ]
    rows += [("y", "again", "", at(6000 + i), 100 + i) for i in range(500)]  # one alert with nearly all commands
    return spark.createDataFrame(rows, "alert_id string, user string, comment string, at timestamp, seq bigint")


def test_first_command_in_time_acknowledges(spark, at):
    found = {r.id: r for r in I.acknowledge(alerts(spark, at), commands(spark, at)).collect()}
    x, y, z = found["x"], found["y"], found["z"]
    assert (x.status, x.acknowledged_by, x.acknowledged_comment) == ("resolved", "operator", "first")
    assert x.updated_at == x.resolved_at
    assert (y.status, y.acknowledged_by, y.acknowledged_comment) == ("acknowledged", "u4", None)
    assert y.updated_at == y.acknowledged_at
    assert (z.status, z.acknowledged_by, z.updated_at) == ("firing", None, z.started_at)
    assert {r.id for r in I.active_alerts(I.acknowledge(alerts(spark, at), commands(spark, at))).collect()} == {"y", "z"}


def test_the_other_commands_are_refused(spark, at):
    refused = I.refused_acknowledgements(alerts(spark, at), commands(spark, at)).collect()
    assert {r.seq for r in refused} == {1, 4, 5, 7, *range(100, 600)}


def test_list_alerts(spark, at):
    rules = literal_rows(spark, [("r", "Rule", "info")], ["id", "name", "severity"])
    acked = I.acknowledge(alerts(spark, at), commands(spark, at))
    listed = I.list_alerts(acked, rules).collect()
    assert [r.id for r in listed] == ["y", "x", "z"]
    assert listed[2].acknowledged_by == "" and listed[2].rule_name == "Rule"
    assert [r.id for r in I.list_alerts(acked, rules, status="firing").collect()] == ["z"]
    assert [r.id for r in I.list_alerts(acked, rules, agent_id="a").collect()] == ["y", "x"]


def test_comments(spark, at):
    rows = [("x", "", "one", at(5), 1), ("x", "me", " ", at(6), 2), ("nobody", "me", "two", at(7), 3), ("x", "me", "zero", at(4), 4)]
    requests = spark.createDataFrame(rows, "alert_id string, author_id string, comment string, at timestamp, seq bigint")
    comments = I.add_comments(alerts(spark, at), requests)
    thread = I.comment_threads(comments, "x").collect()
    assert [(r.author_id, r.comment) for r in thread] == [("me", "zero"), ("operator", "one")]


def channels(spark, at):
    rows = [("c1", "n", "webhook", "https://a", "k", True, at(0), at(0)), ("c2", "n", "slack_webhook", "https://b", "k", True, at(0), at(0)),
            ("c3", "n", "webhook", "https://c", "", False, at(0), at(0))]
    return spark.createDataFrame(rows, model.CHANNEL)


def test_requests(spark, at):
    planned = N.plan_deliveries(N.alert_events(alerts(spark, at)), channels(spark, at))
    assert planned.count() == 4 * 2 and planned.select("id").distinct().count() == 8
    assert planned.select("notification_id").distinct().count() == 4
    rows = N.build_requests(planned).collect()
    hooks = [r for r in rows if r.channel_id == "c1"]
    body = next(json.loads(r.body) for r in hooks if r.alert_id == "x" and r.event_type == model.ALERT_RESOLVED)
    assert body["alert"]["resolved_at"].endswith("Z") and body["alert"]["last_value"] == 10.0 and "agent" not in body
    assert (body["alert"]["rule_name"], body["alert"]["severity"]) == ("Name", "warning")
    assert body["alert"]["updated_at"] == body["alert"]["resolved_at"] != body["alert"]["created_at"]
    assert all(r.signature.startswith("sha256=") for r in hooks)
    chats = [r for r in rows if r.channel_id == "c2"]
    assert all(r.signature is None and "`alert." in json.loads(r.body)["text"] for r in chats)
    assert {json.loads(r.body)["text"][0] for r in chats} == {"🚨", "✅"}


FOLD = [
    ([], "pending", 0, 0, 0),
    ([200], "delivered", 1, 200, None),
    ([299], "delivered", 1, 299, None),
    ([503, 200], "delivered", 2, 200, None),
    ([503, 503, 503], "failed", 3, 503, None),
    ([503], "pending", 1, 503, 1 + 1),
    ([503, 300], "pending", 2, 300, 2 + 4),
    ([200, 503], "delivered", 1, 200, None),
]


def test_fold(spark, at):
    deliveries = spark.createDataFrame(
        [(f"d{i}", "pending", 0, 0, "", at(0), None) for i in range(len(FOLD))],
        "id string, status string, attempts int, response_status int, error_message string, created_at timestamp, sent_at timestamp",
    )
    tried = [(f"d{i}", n, code, "" if code < 300 else "e", at(n)) for i, f in enumerate(FOLD) for n, code in enumerate(f[0], 1)]
    folded = N.fold_attempts(deliveries, spark.createDataFrame(tried, "delivery_id string, attempt int, response_status int, error_message string, at timestamp"))
    rows = {r.id: r for r in folded.collect()}
    for i, (codes, status, attempts, code, due) in enumerate(FOLD):
        r = rows[f"d{i}"]
        assert (r.status, r.attempts, r.response_status) == (status, attempts, code)
        assert (r.sent_at is not None) == (status == "delivered")
        assert (r.error_message == "e") == (status != "delivered" and bool(codes))
        wait = None if r.next_attempt_at is None else (r.next_attempt_at - r.created_at).total_seconds()
        assert wait == due
    assert {r.id for r in N.due(folded, at(2)).collect()} == {"d0", "d5"}
    assert N.list_deliveries(folded, 0).count() == len(FOLD) and N.list_deliveries(folded, 3).count() == 3


def test_attempts_name_the_error(spark, at):
    planned = N.plan_deliveries(N.alert_events(alerts(spark, at)), channels(spark, at))

    def sender(url, body, signature, delivery_id):
        if url == "https://b":
            raise RuntimeError("no route")
        return 204

    rows = N.attempt(N.build_requests(planned), sender, at(0)).collect()
    assert {(r.attempt, r.response_status, r.error_message) for r in rows} == {(1, 204, ""), (1, 0, "no route")}
    refused = N.attempt(N.build_requests(planned), lambda *request: 503, at(0)).collect()
    assert {r.error_message for r in refused} == {"webhook responded with HTTP 503", "slack webhook responded with HTTP 503"}


def test_an_attempt_is_sent_once_whatever_is_read_later(spark, at, tmp_path):
    planned = N.plan_deliveries(N.alert_events(alerts(spark, at)), channels(spark, at))

    def sender(url, body, signature, delivery_id):
        with open(f"{tmp_path}/{delivery_id}", "a") as f:
            f.write("x")
        return 200

    sent = N.attempt(N.build_requests(planned), sender, at(0))
    assert sent.count() == sent.count() == len(sent.collect()) == 8
    assert {p.read_text() for p in tmp_path.iterdir()} == {"x"}


def test_rounds_end_final(spark, at):
    planned = N.plan_deliveries(N.alert_events(alerts(spark, at)), channels(spark, at))
    final, attempts = N.deliver(planned, lambda url, *request: 200 if url == "https://a" else 500, [at(1000 + 60 * n) for n in range(4)])
    assert {(r.channel_id, r.status, r.attempts) for r in final.collect()} == {("c1", "delivered", 1), ("c2", "failed", 3)}
    assert attempts.count() == 4 + 3 * 4


def test_requests_stay_with_failed_attempts(spark, at):
    planned = N.plan_deliveries(N.alert_events(alerts(spark, at)), channels(spark, at))
    # The second round comes too early for all, the third for none.
    times = [at(1000), at(1000.5), at(1060), at(1100)]
    sender = lambda url, body, signature, delivery_id: 200 if url == "https://a" else 503
    final, attempts = N.deliver(planned.unionByName(planned), sender, times)
    assert {(r.channel_id, r.status, r.attempts) for r in final.collect()} == {("c1", "delivered", 1), ("c2", "failed", 3)}
    assert {(r.attempt, r["at"].replace(tzinfo=None)) for r in attempts.collect()} == {(1, at(1000).replace(tzinfo=None)), (2, at(1060).replace(tzinfo=None)), (3, at(1100).replace(tzinfo=None))}
    sent = N.attempt(N.build_requests(planned), sender, at(0), keep_below=2).collect()
    assert {(r.response_status, r.body is None, r.url) for r in sent} == {(200, True, None), (503, False, sent_url(sent))}


def sent_url(sent):
    return next(r.url for r in sent if r.response_status == 503)


def test_change_without_time_gets_the_clock(spark, at):
    rows = spark.createDataFrame([("a", None)], "agent_id string, timestamp timestamp").withColumn("metrics", F.parse_json(F.lit('{"cpu":1}')))
    log = E.event_log(E.telemetry_changes(rows), as_of=at(7))
    assert log.first().timestamp is not None
    frame = E.frames(log).first().frame
    head, data, *rest = frame.split("\n")
    assert head == "event: telemetry.updated" and rest == ["", ""]
    assert json.loads(data.removeprefix("data: ")) == {
        "type": "telemetry.updated", "agent_id": "a", "timestamp": "2023-11-14T22:13:27Z", "metrics": {"cpu": 1},
    }


def test_summary_of_two_snapshots(spark, at):
    doc = '{"system":{"cpu":{"usage_percent":%d},"memory":{"used_percent":%d},"processes":{"running_count":%d},"network":{"interfaces":[{"bytes_recv":%d,"bytes_sent":%d}]}}}'
    rows = [(1, "a", at(0), doc % (10, 40, 20, 60, 30)), (2, "a", at(1), doc % (30, 60, 40, 40, 20)), (3, "a", at(2), '{"cpu":1}'), (4, "b", at(3), '{"system":3}')]
    df = spark.createDataFrame(rows, "id bigint, agent_id string, timestamp timestamp, t string").withColumn("metrics", F.parse_json("t"))
    found = {r.agent_id: r for r in S.metric_summary(df).collect()}
    a, b = found["a"], found["b"]
    assert (a.cpu_average, a.cpu_minimum, a.cpu_maximum, a.memory_average, a.processes_average) == (20, 10, 30, 50, 30)
    assert (a.total_bytes_received, a.total_bytes_sent, a.disk_current) == (100, 50, None)
    assert (b.cpu_average, b.disk_current, b.total_bytes_received) == (None, None, 0)


def samples(spark, n=400):
    """Most rows belong to one agent, and many share a time."""
    agent = F.when(F.col("id") % 10 < 8, "hot").otherwise(F.concat(F.lit("a"), (F.col("id") % 10).cast("string")))
    ts = F.timestamp_seconds(F.lit(1_700_000_000) + F.floor(F.col("id") / 3) * 7000)
    doc = F.concat(F.lit('{"n":'), F.col("id").cast("string"), F.lit("}"))
    return spark.range(n).select("id", agent.alias("agent_id"), ts.alias("timestamp"), F.parse_json(doc).alias("metrics"))


def brute_newest(df, n):
    rows = {}
    for r in df.select("agent_id", "timestamp", "id").collect():
        rows.setdefault(r.agent_id, []).append((r.timestamp, r.id))
    return {a: [i for _, i in sorted(v, reverse=True)[:n]] for a, v in rows.items()}


@pytest.mark.parametrize("n", [1, 3, 50, 1000])
def test_history_is_the_newest_rows(spark, n):
    found = {}
    for r in O.history(samples(spark), n).collect():
        found.setdefault(r.agent_id, []).append(r.id)
    assert found == brute_newest(samples(spark), n)


def test_latest_breaks_ties_by_id(spark):
    found = {r.agent_id: [r.id] for r in O.latest_telemetry(samples(spark)).collect()}
    assert found == brute_newest(samples(spark), 1)
    one = O.agent_history(samples(spark), "hot", 5).collect()
    assert [r.id for r in one] == brute_newest(samples(spark), 5)["hot"]


def test_range_bounds_are_closed(spark, at):
    df = spark.createDataFrame([(i, at(i)) for i in range(5)], "id bigint, timestamp timestamp")
    assert {r.id for r in O.in_range(df, at(1), at(3)).collect()} == {1, 2, 3}
    assert O.in_range(df).count() == 5


def test_rollup_keeps_hours_without_values(spark, at):
    rows = [(1, "a", "{}"), (2, "a", '{"system":{"cpu":{"usage_percent":7}}}')]
    df = spark.createDataFrame(rows, "id bigint, agent_id string, t string").withColumn("metrics", F.parse_json("t"))
    early, exact = df.withColumn("timestamp", F.lit(at(0))), df.withColumn("timestamp", F.date_trunc("hour", F.lit(at(7200))))
    row = U.hourly_rollup(early.unionByName(exact), at(7200)).collect()
    assert [(r.cpu_avg, r.memory_min, r.sample_count) for r in row] == [(7.0, 0.0, 2)]


def test_rollup_stream_over_many_files(spark, tmp_path):
    rows = samples(spark, 300).withColumn("created_at", F.col("timestamp"))
    doc = F.concat(F.lit('{"system":{"cpu":{"usage_percent":'), (F.col("id") % 97).cast("string"), F.lit("}}}"))
    rows = rows.withColumn("metrics", F.parse_json(doc))
    for n in range(5):
        part = rows.where((F.col("id") >= n * 60) & (F.col("id") < (n + 1) * 60)).coalesce(1)
        part.write.parquet(str(tmp_path / "in" / f"part={n}"))
    stream = spark.readStream.schema(model.TELEMETRY).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "part=*"))
    streamed = H.hourly_rollup_stream(stream)
    H.start_append(streamed, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    edge = rows.agg(F.max("timestamp")).first()[0]
    closed = F.col("bucket_start") + F.expr("interval 1 hour") <= F.lit(edge) - F.expr("interval 10 minutes")
    batch = U.hourly_rollup(rows, "2030-01-01T00:00:00").where(closed)
    key = lambda r: (r.agent_id, r.bucket_start)
    found = sorted(spark.read.parquet(str(tmp_path / "out")).select(*batch.columns).collect(), key=key)
    assert found == sorted(batch.collect(), key=key) and len(found) > 50
