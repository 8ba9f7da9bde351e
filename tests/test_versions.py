"""Rules that change: as-of judging against a plain search, episodes against a plain walk with changing hold times."""

import random

import pytest
from pyspark.sql import functions as F
from test_alerting import EVALUATION, episodes_by_pair

from fleetpulse import model
from fleetpulse.operators import alerting as A
from fleetpulse.operators import versions as V


def walk(samples):
    """Episodes of one history whose samples are (clock, id, value, breaching, hold)."""
    found, first, active = [], None, None
    for clock, row_id, value, breaching, hold in sorted(samples):
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


def histories(seed, agents=10, rows=150):
    r = random.Random(seed)
    out = {}
    for n in range(agents):
        keep, clock, breaching, hold = r.choice([0.3, 0.9, 0.98]), 0.0, False, 0
        for i in range(rows * (8 if n == 0 else 1)):
            clock += r.choice([0, 1, 20, 300])
            breaching = breaching if r.random() < keep else not breaching
            hold = hold if r.random() < 0.9 else r.choice([0, 30, 400, 2000])
            out.setdefault(("rule", f"agent-{n}"), []).append((clock, n * 10_000 + i, float(i), breaching, hold))
    return out


@pytest.mark.parametrize("seed", range(3))
@pytest.mark.parametrize("chunk", [1, 60, 600, 100_000])
def test_hold_times_that_change_within_a_run(spark, at, seed, chunk):
    told = histories(seed)
    rows = [(*pair, at(c), i, v, b, h) for pair, samples in told.items() for c, i, v, b, h in samples]
    random.Random(2).shuffle(rows)
    found = A.alert_episodes(spark.createDataFrame(rows, EVALUATION), chunk).collect()
    assert episodes_by_pair(found, at) == {p: w for p, s in told.items() if (w := walk(s))}


def test_a_longer_hold_does_not_fire_again(spark, at):
    samples = [(0, 1, 9.0, True, 0), (10, 2, 9.0, True, 600), (700, 3, 9.0, True, 600), (800, 4, 1.0, False, 600)]
    for chunk in (5, 60, 10_000):
        frame = spark.createDataFrame([("r", "a", at(c), i, v, b, h) for c, i, v, b, h in samples], EVALUATION)
        assert episodes_by_pair(A.alert_episodes(frame, chunk).collect(), at) == {("r", "a"): [(0, 1, 9.0, 800, 4, 1.0)]}


def rule(at, second, rule_id="r", threshold=50.0, hold=0, enabled=True, metric="cpu_usage", operator=">"):
    return (rule_id, "Name", metric, operator, threshold, 0, hold, 0, "warning", enabled, at(0), None if second is None else at(second))


def samples(spark, at, rows):
    """rows: (agent, id, second, value)"""
    schema = "agent_id string, id bigint, clock timestamp, metric string, value double"
    return spark.createDataFrame([(a, i, None if s is None else at(s), "cpu_usage", v) for a, i, s, v in rows], schema)


def judged(df):
    return sorted((r.rule_id, r.id, r.breaching, r.hold_seconds) for r in df.collect())


@pytest.mark.parametrize("slice_seconds", [7, 100, 10**6])
@pytest.mark.parametrize("small", [True, False])
def test_as_of_against_plain_search(spark, at, slice_seconds, small):
    r = random.Random(slice_seconds)
    stored = [(f"r{k % 4}", r.randrange(0, 500), float(r.randrange(100)), r.random() < 0.8) for k in range(40)]
    stored = list({s[:2]: s for s in stored}.values())
    rules = spark.createDataFrame([rule(at, s, i, t, k, e) for k, (i, s, t, e) in enumerate(stored)], model.RULE)
    rows = [(f"a{k % 3}", k, r.randrange(-50, 600), float(r.randrange(100))) for k in range(200)] + [("a", 999, None, 1.0)]
    versions = V.rule_versions(rules).select(F.col("id").alias("rule_id"), "metric", "threshold", "enabled", "valid_from", "valid_to")
    found = V.as_of(samples(spark, at, rows), versions.where("enabled"), ["metric"], "clock", slice_seconds, small)
    expected = []
    for agent, row_id, second, _ in rows[:-1]:
        for rule_id in {s[0] for s in stored}:
            before = [s for s in stored if s[0] == rule_id and s[1] <= second]
            if before and (last := max(before, key=lambda s: s[1]))[3]:
                expected.append((row_id, rule_id, last[2]))
    assert sorted((x.id, x.rule_id, x.threshold) for x in found.collect()) == sorted(expected)


def test_change_in_the_middle_of_a_breach(spark, at):
    rules = spark.createDataFrame([rule(at, 0, threshold=80.0, hold=60), rule(at, 30, threshold=60.0, hold=60), rule(at, 90, threshold=95.0, hold=60)], model.RULE)
    rows = [("a", k, 10 * k, 70.0 if k < 3 else 90.0) for k in range(12)]
    evaluated = V.evaluate_versions(samples(spark, at, rows), V.rule_versions(rules))
    assert [b for _, _, b, _ in judged(evaluated)] == [False] * 3 + [True] * 6 + [False] * 3
    assert episodes_by_pair(A.alert_episodes(evaluated).collect(), at) == {}
    sooner = rules.withColumn("for_duration_seconds", F.when(F.col("threshold") == 60, 20).otherwise(60))
    found = A.alert_episodes(V.evaluate_versions(samples(spark, at, rows), V.rule_versions(sooner))).collect()
    assert episodes_by_pair(found, at) == {("r", "a"): [(50, 5, 90.0, 90, 9, 90.0)]}


def test_gaps_ends_and_ties(spark, at):
    stored = [rule(at, 10, threshold=1.0), rule(at, 20, enabled=False), rule(at, 30, threshold=2.0), rule(at, 50, threshold=3.0), rule(at, 50, threshold=4.0), rule(at, None, "lost")]
    rules = spark.createDataFrame(stored, model.RULE)
    removed = spark.createDataFrame([("r", at(40)), ("r", at(40)), ("none", at(1))], "id string, at timestamp")
    versions = V.rule_versions(rules, removed)
    assert sorted((r.threshold, r.enabled) for r in versions.collect()) == [(1.0, True), (2.0, True), (4.0, True), (50.0, False)]
    rows = [("a", s, s, 3.5) for s in (9, 10, 19, 20, 29, 30, 39, 40, 49, 50, 500)]
    assert judged(V.evaluate_versions(samples(spark, at, rows), versions)) == [("r", s, s < 50, 0) for s in (10, 19, 30, 39, 50, 500)]


def test_empty_tables(spark, at):
    rules = spark.createDataFrame([rule(at, 0)], model.RULE)
    assert V.evaluate_versions(samples(spark, at, []), V.rule_versions(rules)).collect() == []
    assert V.evaluate_versions(samples(spark, at, [("a", 1, 5, 1.0)]), V.rule_versions(rules.limit(0))).collect() == []


def test_no_history_is_ranked(spark, at):
    rules = spark.createDataFrame([rule(at, 0)], model.RULE)
    found = V.evaluate_versions(samples(spark, at, [("a", 1, 5, 1.0)]), V.rule_versions(rules))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "agent_id" not in "".join(line for line in plan.splitlines() if "Window" in line)
