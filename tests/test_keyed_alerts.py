"""Alert streams with keyed state: against plain walks and the batch operators, after failures, and by what they write."""

import random
from datetime import timedelta
from pathlib import Path

import pytest
from pyspark.sql import functions as F
from test_alerting import episodes_by_pair
from test_versions import EVALUATION, histories, walk

from fleetpulse import model
from fleetpulse.operators import alerting as A
from fleetpulse.streaming import keyed_alerts as K
from fleetpulse.streaming.rollup_stream import start_append

ONE_FILE = {"availableNow": True}


def files(spark, rows, schema, path, parts):
    """Rows as files that a stream takes one by one."""
    size = -(-len(rows) // parts)
    for k in range(parts):
        spark.createDataFrame(rows[k * size : (k + 1) * size], schema).coalesce(1).write.mode("append").parquet(f"{path}/p{k:03d}")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(path))


def run(spark, changes, root):
    start_append(changes, f"{root}/table", f"{root}/checkpoint").awaitTermination()
    return spark.read.schema(changes.schema).parquet(f"{root}/table")


def evaluation_rows(told, at):
    rows = [(*pair, at(c), i, v, b, h) for pair, samples in told.items() for c, i, v, b, h in samples]
    return sorted(rows, key=lambda r: (r[2], r[3]))


@pytest.mark.parametrize(("seed", "parts"), [(0, 1), (1, 7), (2, 4)])
def test_stream_equals_walk(spark, at, tmp_path, seed, parts):
    told = histories(seed, agents=6, rows=60)
    rows = evaluation_rows(told, at) + [(None, "a", at(9e6), 1, 1.0, True, 0), ("r", None, at(9e6), 1, 1.0, True, 0)]
    stream = files(spark, rows, EVALUATION, tmp_path / "in", parts)
    changes = run(spark, K.alert_changes(stream), tmp_path)
    assert changes.where("change = 'late'").count() == 0
    assert episodes_by_pair(K.episodes(changes).collect(), at) == {p: w for p, s in told.items() if (w := walk(s))}


def test_late_samples_change_nothing(spark, at, tmp_path):
    early = [("r", "a", at(s), s, float(s), s >= 100, 0) for s in (0, 50, 100, 200)]
    late = [("r", "a", at(150), 7, 7.0, False, 0), ("r", "a", at(200), 200, 9.0, False, 0), ("r", "a", at(200), 201, 1.0, True, 0), ("r", "a", at(300), 300, 3.0, False, 0)]
    stream = files(spark, early + late, EVALUATION, tmp_path / "in", 2)
    changes = run(spark, K.alert_changes(stream), tmp_path)
    assert sorted((r.resolved_id, r.resolved_value) for r in changes.where("change = 'late'").collect()) == [(7, 7.0), (200, 9.0)]
    assert episodes_by_pair(K.episodes(changes).collect(), at) == {("r", "a"): [(100, 100, 100.0, 300, 300, 3.0)]}


def test_restart_in_the_middle_of_a_batch(spark, at, tmp_path):
    told = histories(5, agents=4, rows=40)
    stream = files(spark, evaluation_rows(told, at), EVALUATION, tmp_path / "in", 5)
    marker = tmp_path / "failed-once"

    def fail_once(batches):
        for n, batch in enumerate(batches):
            yield batch
        if not marker.exists() and list(Path(tmp_path / "table").glob("part-*")):  # in a batch after the first
            marker.touch()
            raise RuntimeError("lost in mid-batch")

    changes = K.alert_changes(stream).mapInArrow(fail_once, K.alert_changes(stream).schema)
    with pytest.raises(Exception, match="lost in mid-batch"):
        run(spark, changes, tmp_path)
    assert marker.exists()
    found = run(spark, changes, tmp_path)
    assert episodes_by_pair(K.episodes(found).collect(), at) == {p: w for p, s in told.items() if (w := walk(s))}
    assert found.count() == found.distinct().count()


def test_a_batch_writes_what_it_touches(spark, at, tmp_path):
    many = [("r", f"agent-{n}", at(n % 50), n, 90.0, True, 0) for n in range(4000)]
    stream = files(spark, many, EVALUATION, tmp_path / "in", 1)
    run(spark, K.alert_changes(stream), tmp_path)
    files(spark, [("r", "agent-7", at(100), 9000, 1.0, False, 0)], EVALUATION, tmp_path / "in" / "later", 1)
    changes = run(spark, K.alert_changes(stream), tmp_path)
    assert K.episodes(changes).where("resolved_id = 9000").count() == 1
    written = lambda version: sum(p.stat().st_size for p in Path(tmp_path / "checkpoint" / "state").rglob(f"{version}.delta"))
    first, second = written(1), max(written(v) for v in (2, 3))
    assert 0 < second < first / 20


def test_hot_agent_comes_as_rows_of_chunks(spark, at):
    rows = [("r", "hot", at(k), k, 1.0, True, 0) for k in range(6000)] + [("r", f"cold-{k}", at(k), k, 1.0, True, 0) for k in range(50)]
    packed = K.chunk_rows(spark.createDataFrame(rows, EVALUATION)).groupBy("agent_id").count().collect()
    assert {r.agent_id: r["count"] for r in packed if r.agent_id == "hot"}["hot"] in (10, 11) and sum(r["count"] for r in packed) <= 61


REGISTERED = "id string, at timestamp"
HEARD = "agent_id string, timestamp timestamp"
STEP, HEALTHY, STALE, COUNT = 600, 100, 900, 60


def offline_rules(spark, at, holds=(0, 1500)):
    rows = [(f"off-{h}", "Off", model.OFFLINE_METRIC, "==", 1.0, 0, h, 0, "warning", True, at(0), at(0)) for h in holds]
    muted = ("muted", "Off", model.OFFLINE_METRIC, "==", 1.0, 0, 0, 0, "warning", False, at(0), at(0))
    return spark.createDataFrame([*rows, muted], model.RULE)


def offline(spark, at, tmp_path, agents, heard, parts, holds=(0, 1500), lateness="1 second"):
    start = at(0)
    known = files(spark, agents, REGISTERED, tmp_path / "agents", 1)
    beats = files(spark, heard, HEARD, tmp_path / "heard", parts)
    changes = K.offline_changes(known, beats, offline_rules(spark, at, holds), start, STEP, HEALTHY, STALE, lateness)
    return run(spark, changes, tmp_path)


@pytest.mark.parametrize(("seed", "parts"), [(1, 1), (2, 4), (3, 9)])
def test_offline_stream_equals_batch(spark, at, tmp_path, seed, parts):
    r = random.Random(seed)
    agents = [(f"agent-{n}", at(-60)) for n in range(12)]
    heard = [("beacon", at(s)) for s in range(0, STEP * COUNT, 300)]
    for n in range(10):  # two agents never report
        clock = -1000.0
        while clock < STEP * (COUNT - 5):
            clock += r.choice([30, 200, 700, 4000]) * r.random() * 2
            if clock < STEP * COUNT:
                heard.append((f"agent-{n}", at(round(clock))))
    heard.sort(key=lambda h: h[1])
    heard.append(("beacon", at(STEP * COUNT + 10)))
    changes = offline(spark, at, tmp_path, agents, heard, parts)
    telemetry = spark.createDataFrame(heard, HEARD)
    ids = spark.createDataFrame(agents, REGISTERED).select("id")
    segments = A.offline_segments(ids, telemetry, at(0), STEP, COUNT + 1, HEALTHY, STALE)
    batch = A.alert_episodes(A.evaluate_offline(segments, offline_rules(spark, at), at(0), STEP), STEP * COUNT)
    found = episodes_by_pair(K.episodes(changes).collect(), at)
    assert found == episodes_by_pair(batch.collect(), at) and len(found) > 12


def test_a_silent_agent_fires_by_the_watermark_alone(spark, at, tmp_path):
    agents = [("quiet", at(-60)), ("busy", at(-60))]
    heard = [("quiet", at(10)), ("busy", at(20)), *[("busy", at(s)) for s in range(600, 3000, 600)]]
    changes = offline(spark, at, tmp_path, agents, heard, len(heard), holds=(0,))
    # Heard at 10 s, it counts from the tick at 600 s and is stale from that at 1,200 s on.
    told = [(r.change, (r.started_at - at(0).replace(tzinfo=None)) / timedelta(seconds=1)) for r in changes.collect() if r.agent_id == "quiet"]
    assert sorted(told) == [("firing", 0.0), ("firing", 1200.0), ("resolved", 0.0)]


def test_order_registration_and_late_rows(spark, at, tmp_path):
    heard = [("early", at(650)), ("clock", at(700)), ("clock", at(2000)), ("early", at(100)), ("stranger", at(1900)), ("clock", at(9000))]
    known = files(spark, [("clock", at(-1)), ("early", at(0))], REGISTERED, tmp_path / "agents", 1)
    beats = files(spark, heard, HEARD, tmp_path / "heard", len(heard))
    changes = K.offline_changes(known, beats, offline_rules(spark, at, (0,)), at(0), STEP, HEALTHY, STALE, "1 second")
    found = episodes_by_pair(K.episodes(run(spark, changes, tmp_path)).collect(), at)
    assert {a for _, a in found} == {"clock", "early"}
    assert found["off-0", "early"] == [(0, 0, 1.0, 1200, 2, 0.0), (1800, 3, 1.0, None, None, None)]


def test_empty_streams(spark, at, tmp_path):
    stream = files(spark, [], EVALUATION, tmp_path / "in", 1)
    assert run(spark, K.alert_changes(stream), tmp_path).count() == 0
    changes = offline(spark, at, tmp_path / "offline", [], [], 1)
    assert changes.count() == 0


def test_no_offline_rule(spark, at, tmp_path):
    assert offline(spark, at, tmp_path, [("a", at(0))], [("a", at(1)), ("a", at(9000))], 2, holds=()).count() == 0
