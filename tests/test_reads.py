"""Newest rows: one per agent on ties, few scans whatever the number of agents."""

import random
import re

import pytest
from pyspark.sql import functions as F

from fleetpulse.operators import fleet as O
from fleetpulse.operators import joins as J
from fleetpulse.sources.tables import append_telemetry, read_telemetry

# The measured table is broadcast, or a filter of its keys is, ample or so small that it lets nearly all through.
WAYS = [{}, {"most_bytes": 0}, {"most_bytes": 0, "most_words": 1}]


def telemetry(spark, at, rows):
    """rows: (agent, id, second, cpu, stored second)"""
    frame = spark.createDataFrame(
        [(a, i, None if s is None else at(s), float(v), at(c)) for a, i, s, v, c in rows], "agent_id string, id bigint, timestamp timestamp, v double, created_at timestamp"
    )
    metrics = F.parse_json(F.concat(F.lit('{"cpu":'), F.col("v").cast("string"), F.lit("}")))
    return frame.select("id", "agent_id", "timestamp", metrics.alias("metrics"), "created_at")


def given():
    r = random.Random(4)
    rows = [("hot" if k % 3 == 0 else f"agent-{k % 40}", k, r.randrange(300_000), k, k) for k in range(1500)]
    rows += [(a, i, s, v, c) for a, i, s, v, c in rows[::5]]  # posted twice
    rows += [(a, i, s, v, c + 5) for a, i, s, v, c in rows[:30]]  # and stored again later
    return rows + [("hot", 9001, 400_000, 1, 1)] * 3 + [("hot", 9002, 400_000, 1, 1), (None, 1, 5, 1, 1), ("timeless", 7, None, 1, 1)]


def newest(rows, n):
    out = {}
    for a, i, s, _, c in rows:
        if a is not None and s is not None:
            kept = out.setdefault(a, {})
            kept[s, i] = max(c, kept.get((s, i), c))
    return {a: sorted(((s, i, c) for (s, i), c in kept.items()), reverse=True)[:n] for a, kept in out.items()}


def found(df, at):
    base, out = at(0).timestamp(), {}
    for r in df.collect():
        second = lambda t: round(t.astimezone().timestamp() - base)
        out.setdefault(r.agent_id, []).append((second(r.timestamp), r.id, second(r.created_at)))
    return {a: sorted(v, reverse=True) for a, v in out.items()}


@pytest.mark.parametrize("way", WAYS, ids=str)
def test_one_row_per_agent(spark, at, way):
    rows = given()
    df = O.latest_telemetry(telemetry(spark, at, rows), **way)
    assert set(df.columns) == {"agent_id", "id", "timestamp", "metrics", "created_at"}
    assert found(df, at) == newest(rows, 1)


@pytest.mark.parametrize("way", WAYS, ids=str)
@pytest.mark.parametrize("n", [1, 7, 10_000])
def test_history(spark, at, way, n):
    rows = given()
    assert found(O.history(telemetry(spark, at, rows), n, **way), at) == newest(rows, n)


def test_history_in_a_range(spark, at):
    rows = given()
    inside = [r for r in rows if r[2] is not None and 1000 <= r[2] <= 90_000]
    assert found(O.history(telemetry(spark, at, rows), 3, at(1000), at(90_000)), at) == newest(inside, 3)


def test_empty_table(spark, at):
    assert O.latest_telemetry(telemetry(spark, at, [])).collect() == [] and O.history(telemetry(spark, at, [])).collect() == []


def test_filter_never_loses_a_key(spark):
    rows = spark.range(20_000).select(F.concat(F.lit("k"), (F.col("id") % 7000).cast("string")).alias("k"), (F.col("id") % 3).alias("j"))
    keys = rows.where("j = 0").select("k", "j").distinct().limit(900)
    exact = rows.join(keys, ["k", "j"]).count()
    for words in (1, 225, 5000):
        left = J.key_filter(rows, keys, ["k", "j"], words)
        assert left.join(keys, ["k", "j"]).count() == exact and left.columns == rows.columns
    assert J.key_filter(rows, keys, ["k", "j"], 225).count() < exact + 2000


def test_two_scans_of_the_stored_table(spark, at, tmp_path):
    append_telemetry(telemetry(spark, at, given()[:-1]), f"{tmp_path}/t")
    stored = read_telemetry(spark, f"{tmp_path}/t")
    for way in WAYS:
        plan = O.latest_telemetry(stored, **way)._jdf.queryExecution().executedPlan().toString()
        scans = [x for x in re.findall(r"FileScan parquet .*", plan) if "metrics" in x]
        assert len(scans) == 1
