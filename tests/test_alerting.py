"""Alert episodes against a plain walk through each history, in batch and as a stream."""

import random

import pytest
from pyspark.sql import functions as F

from fleetpulse import model
from fleetpulse.operators import alerting as A
from fleetpulse.operators.registry import literal_rows
from fleetpulse.streaming import alert_stream as L

EVALUATION = "rule_id string, agent_id string, clock timestamp, id bigint, value double, breaching boolean, hold_seconds int"


def walk(samples, hold):
    """(started, started id, value, resolved, resolved id, resolved value) of one history."""
    found, first, active = [], None, None
    for clock, row_id, value, breaching in sorted(samples):
        if breaching:
            first = clock if first is None else first
            if active is None and clock - first >= hold:
                active = [clock, row_id, value, None, None, None]
        else:
            first = None
            if active:
                found.append(tuple(active[:3] + [clock, row_id, value]))
                active = None
    return found + ([tuple(active)] if active else [])


def episodes_by_pair(rows, at):
    base = at(0).timestamp()
    seconds = lambda t: None if t is None else round(t.astimezone().timestamp() - base, 6)
    out = {}
    for r in rows:
        out.setdefault((r.rule_id, r.agent_id), []).append(
            (seconds(r.started_at), r.started_id, r.started_value, seconds(r.resolved_at), r.resolved_id, r.resolved_value)
        )
    return {k: sorted(v) for k, v in out.items()}


def frame(spark, at, histories):
    rows = [
        (*pair, at(clock), row_id, value, breaching, hold)
        for (pair, hold), samples in histories.items()
        for clock, row_id, value, breaching in samples
    ]
    random.Random(1).shuffle(rows)
    return spark.createDataFrame(rows, EVALUATION)


def expected(histories):
    walked = {pair: walk(samples, hold) for (pair, hold), samples in histories.items()}
    return {pair: found for pair, found in walked.items() if found}


@pytest.mark.parametrize(
    ("trace", "want"),
    [
        ([(0, 90), (59, 90)], []),
        ([(0, 90), (60, 91)], [(60, 91, None, None)]),
        ([(0, 90), (30, 70), (60, 90), (119, 90)], []),
        ([(0, 90), (60, 91), (70, 99), (80, 70)], [(60, 91, 80, 70)]),
        ([(0, 70)], []),
        ([(0, 90), (60, 90), (61, 10), (62, 90), (122, 95), (123, 10)], [(60, 90, 61, 10), (122, 95, 123, 10)]),
    ],
)
@pytest.mark.parametrize("chunk", [1, 30, 45, 3600])
def test_sustained(spark, at, trace, want, chunk):
    samples = [(s, i, float(v), v > 80) for i, (s, v) in enumerate(trace)]
    found = A.alert_episodes(frame(spark, at, {(("r", "a"), 60): samples}), chunk).collect()
    got = episodes_by_pair(found, at).get(("r", "a"), [])
    assert [(s, v, e, w) for s, _, v, e, _, w in got] == want


def random_histories(seed, agents=12, rows=160, spacing=20):
    rng = random.Random(seed)
    histories = {}
    for n in range(agents):
        keep = rng.choice([0.1, 0.5, 0.9, 0.98])
        breaching, clock, samples = rng.random() < 0.5, 0.0, []
        for i in range(rows * (12 if n == 0 else 1)):  # one agent has as many rows as all others
            clock += rng.choice([0, 1, 5, spacing, spacing * 10])
            breaching = breaching if rng.random() < keep else not breaching
            samples.append((clock, n * 100_000 + i, round(rng.uniform(0, 100), 2), breaching))
        histories[(("rule", f"agent-{n}"), rng.choice([0, 0, 30, 200, 1500]))] = samples
    return histories


@pytest.mark.parametrize("seed", range(4))
@pytest.mark.parametrize("chunk", [60, 600, 100_000])
def test_chunks_do_not_change_episodes(spark, at, seed, chunk):
    histories = random_histories(seed)
    found = A.alert_episodes(frame(spark, at, histories), chunk).collect()
    assert episodes_by_pair(found, at) == expected(histories)


def test_both_readings_share_one_shuffle(spark, at):
    plan = A.alert_episodes(frame(spark, at, random_histories(1, 2, 20)))
    plan.collect()
    assert "ReusedExchange" in plan._jdf.queryExecution().executedPlan().toString()


def telemetry(spark, at, rows):
    """rows: (id, agent, seconds, cpu)"""
    df = spark.createDataFrame([(i, a, at(s), float(v)) for i, a, s, v in rows], "id bigint, agent_id string, timestamp timestamp, v double")
    metrics = F.concat(F.lit('{"system":{"cpu":{"usage_percent":'), F.col("v").cast("string"), F.lit("}}}"))
    return df.select("id", "agent_id", "timestamp", F.parse_json(metrics).alias("metrics"), F.col("timestamp").alias("created_at"))


def rules(spark, at, hold=60, enabled=True, operator=">"):
    row = ("rule", "CPU", "cpu_usage", operator, 80.0, 0, hold, 0, "warning", enabled, at(0), at(0))
    return spark.createDataFrame([row], model.RULE)


def test_unknown_operator_never_breaches(spark, at):
    samples = A.metric_samples(telemetry(spark, at, [(1, "a", 0, 90)]))
    assert [r.breaching for r in A.evaluate(samples, rules(spark, at, operator="!="))  .collect()] == [False]


def test_disabled_rules_are_not_evaluated(spark, at):
    samples = A.metric_samples(telemetry(spark, at, [(1, "a", 0, 90)]))
    assert A.evaluate(samples, rules(spark, at, enabled=False)).count() == 0


def test_missing_metric_does_not_break_a_run(spark, at):
    rows = telemetry(spark, at, [(1, "a", 0, 90), (2, "a", 30, 0), (3, "a", 60, 91)])
    blank = F.when(F.col("id") == 2, F.parse_json(F.lit('{"system":{"cpu":{}}}'))).otherwise(F.col("metrics"))
    found = A.alert_episodes(A.evaluate(A.metric_samples(rows.withColumn("metrics", blank)), rules(spark, at)))
    assert [(r.started_id, r.started_value) for r in found.collect()] == [(3, 91.0)]


@pytest.mark.parametrize("stale, hold", [(120, 0), (120, 250), (250, 100), (60, 0), (60, 230), (1000, 0)])
def test_offline_episodes_equal_a_grid(spark, at, stale, hold):
    """Against the state of every agent at every tick; a stale limit under the step leaves gaps in between."""
    step, count, rng = 100, 30, random.Random(stale + hold)
    times = {f"a{n}": sorted(rng.uniform(-200, 3200) for _ in range(rng.choice([0, 1, 4, 12]))) for n in range(12)}
    times["exact"] = [0.0, 100.0, 300.0, 1500.0]
    agents = literal_rows(spark, [(a,) for a in times], ["id"])
    rows = telemetry(spark, at, [(n, a, t, 1) for a, ts in [*times.items(), ("stranger", [5.0])] for n, t in enumerate(ts)])
    rule = literal_rows(spark, [("r", "agent_offline", hold, True)], ["id", "metric", "for_duration_seconds", "enabled"])
    segments = A.offline_segments(agents, rows, at(0), step, count, healthy=30, stale=stale)
    found = A.alert_episodes(A.evaluate_offline(segments, rule, at(0), step), step * count).collect()
    expected = []
    for agent, ts in times.items():
        states = []
        for tick in range(count):
            seen = [t for t in ts if t <= tick * step]
            states.append(not seen or int(tick * step - max(seen)) >= stale)
        tick = 0
        while tick < count:
            if not states[tick]:
                tick += 1
                continue
            first = tick
            while tick < count and states[tick]:
                tick += 1
            fires = next((t for t in range(first, tick) if (t - first) * step >= hold), None)
            if fires is not None:
                expected.append((agent, fires, tick if tick < count else None))
    assert sorted((r.agent_id, r.started_id, r.resolved_id) for r in found) == sorted(expected, key=lambda e: (e[0], e[1]))
    assert all(r.started_value == 1.0 for r in found)


def test_a_quiet_agent_is_one_row(spark, at):
    agents = literal_rows(spark, [("a",), ("b",)], ["id"])
    rows = telemetry(spark, at, [(1, "a", 0, 1), (2, "a", 50, 1)])
    segments = A.offline_segments(agents, rows, at(0), 10, 1_000_000, healthy=30, stale=120)
    assert sorted(map(tuple, segments.collect())) == [("a", 0, 12, 5, None), ("a", 5, 17, 1_000_000, 17), ("b", 0, 0, 1_000_000, 0)]


def test_message_and_ids(spark, at):
    episodes = A.alert_episodes(A.evaluate(A.metric_samples(telemetry(spark, at, [(1, "a", 0, 80.25)])), rules(spark, at, 0)))
    first, second = A.alerts(episodes, rules(spark, at, 0)).collect(), A.alerts(episodes, rules(spark, at, 0)).collect()
    assert first == second and len(first) == 1
    assert first[0].message == "[warning] CPU: 80.2 > 80.0" and first[0].id.startswith("alert-")


def test_stream_equals_batch_over_many_files(spark, at, tmp_path):
    rng = random.Random(5)
    histories = random_histories(3, agents=5, rows=60)
    rows = [
        (i, agent, clock, 90.0 if breaching else 10.0)
        for ((_, agent), _), samples in histories.items()
        for clock, i, _, breaching in samples
    ]
    rows.sort(key=lambda r: (r[2], r[0]))
    cuts = sorted(rng.sample(range(1, len(rows)), 4))
    for n, (lo, hi) in enumerate(zip([0, *cuts], [*cuts, len(rows)])):
        telemetry(spark, at, rows[lo:hi]).coalesce(1).write.parquet(str(tmp_path / "in" / f"part={n}"))
    late = [(10**9, "agent-1", -50.0, 90.0)]
    telemetry(spark, at, late).coalesce(1).write.parquet(str(tmp_path / "in" / "part=9"))

    stream = spark.readStream.schema(model.TELEMETRY).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "part=*"))
    root = str(tmp_path / "out")
    query = L.start_alerts(stream, lambda: rules(spark, at, 30), root, str(tmp_path / "cp"), chunk_seconds=300)
    query.awaitTermination()
    assert len(query.recentProgress) >= 6

    batch = A.alert_episodes(A.evaluate(A.metric_samples(telemetry(spark, at, rows)), rules(spark, at, 30)))
    streamed = L.streamed_episodes(spark, root)
    assert episodes_by_pair(streamed.collect(), at) == episodes_by_pair(batch.collect(), at)
    kept_late = spark.read.parquet(f"{root}/samples").where("late = 'true'").collect()
    assert [r.id for r in kept_late] == [10**9]


def test_an_idle_active_alert_costs_nothing(spark, at, tmp_path):
    """Ten batches; the alert that fires in the first and then gets no samples is written once."""
    for n in range(10):
        rows = [(n, "busy", float(n), 10.0)] + ([(100, "idle", 0.0, 90.0)] if n == 0 else [])
        telemetry(spark, at, rows).coalesce(1).write.parquet(str(tmp_path / "in" / f"part={n}"))
    stream = spark.readStream.schema(model.TELEMETRY).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "part=*"))
    root = tmp_path / "out"
    L.start_alerts(stream, lambda: rules(spark, at, 0), str(root), str(tmp_path / "cp")).awaitTermination()
    touched = spark.read.parquet(f"{root}/touched").where("agent_id = 'idle'").groupBy("batch").count().collect()
    assert len(touched) == 1
    assert len(list((root / "state").iterdir())) == 2
    open_ = L.streamed_episodes(spark, str(root)).where("agent_id = 'idle'").collect()
    assert open_ and all(r.resolved_at is None for r in open_)
