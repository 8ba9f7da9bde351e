"""The change log as a stream, and charts of long ranges, against plain Python."""

import random
from datetime import timedelta
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from fleetpulse.operators import eventlog as E
from fleetpulse.operators import series as S
from fleetpulse.streaming import log_stream as G

ALERT = "alert_id string, event_type string, at timestamp, agent_id string, status string, last_value double"
COMMENT = "id string, alert_id string, author_id string, comment string, created_at timestamp"
HEARD = "id bigint, agent_id string, timestamp timestamp, v int"


def sources(spark, at, path, parts=3):
    """Two sources in files of their own, as streams of changes, and the same rows at once."""
    alerts = [(f"a{k}", f"alert.{'firing' if k % 2 else 'resolved'}", at(k) if k % 5 else None, f"agent-{k}", "firing", float(k)) for k in range(12)]
    comments = [(f"c{k}", f"a{k}", "me", f"text {k}", at(100 + k)) for k in range(9)]
    streams, whole = [], []
    for name, rows, schema, change in (("alerts", alerts, ALERT, E.alert_changes), ("comments", comments, COMMENT, E.comment_changes)):
        for k in range(parts):
            spark.createDataFrame(rows[k::parts], schema).coalesce(1).write.parquet(f"{path}/{name}/p{k}")
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{path}/{name}")
        streams.append(change(stream))
        whole.append(change(spark.createDataFrame(rows, schema)))
    return streams, E.event_log(*whole, as_of=at(999))


def rows(log):
    told = log.select("type", "agent_id", "timestamp", *[F.to_json(b).alias(b) for b in E.BODIES])
    return sorted((tuple(r) for r in told.collect()), key=repr)


def test_stream_equals_batch_and_survives_replays(spark, at, tmp_path):
    streams, whole = sources(spark, at, tmp_path / "in")
    root = f"{tmp_path}/log"
    G.start_log(streams, root, f"{tmp_path}/checkpoint", at(999)).awaitTermination()
    log = G.read_log(spark, root, whole)
    assert rows(log) == rows(whole) and len(list(Path(root).glob("batch=*"))) == 3
    # The last batch was written, but its end not noted: it comes again.
    for mark in (tmp_path / "checkpoint" / "commits").glob("*2*"):
        mark.unlink()
    G.start_log(streams, root, f"{tmp_path}/checkpoint", at(999)).awaitTermination()
    assert rows(G.read_log(spark, root, whole)) == rows(whole)
    later = G.since(spark, root, whole, 1)
    assert {r.batch for r in later.select("batch").distinct().collect()} == {2} and 0 < later.count() < whole.count()


def test_a_batch_that_failed_half_way(spark, at, tmp_path, monkeypatch):
    streams, whole = sources(spark, at, tmp_path / "in")
    root, real, failed = f"{tmp_path}/log", G.write_batch, []

    def half(log, path, batch_id, as_of=None):
        if batch_id == 1 and not failed:
            failed.append(real(log.limit(2), path, batch_id, as_of))
            raise RuntimeError("half written")
        real(log, path, batch_id, as_of)

    monkeypatch.setattr(G, "write_batch", half)
    with pytest.raises(Exception, match="half written"):
        G.start_log(streams, root, f"{tmp_path}/checkpoint", at(999)).awaitTermination()
    G.start_log(streams, root, f"{tmp_path}/checkpoint", at(999)).awaitTermination()
    assert failed and rows(G.read_log(spark, root, whole)) == rows(whole)


def test_no_time_and_no_rows(spark, at, tmp_path):
    streams, whole = sources(spark, at, tmp_path / "in", 1)
    G.start_log(streams[:1], f"{tmp_path}/log", f"{tmp_path}/checkpoint").awaitTermination()
    log = G.read_log(spark, f"{tmp_path}/log", whole)
    assert log.where("timestamp IS NULL").count() == 3
    G.write_batch(whole.limit(0), f"{tmp_path}/empty", 0)
    assert G.read_log(spark, f"{tmp_path}/empty", whole).collect() == []


def snapshots(spark, rows):
    """rows: (id, agent, time, cpu or None)"""
    cpu = F.when(F.col("v").isNull(), F.lit('"none"')).otherwise(F.col("v").cast("string"))
    frame = spark.createDataFrame(rows, HEARD)
    metrics = F.parse_json(F.concat(F.lit('{"system":{"cpu":{"usage_percent":'), cpu, F.lit('},"memory":{"used_percent":'), F.col("id").cast("string"), F.lit("}}}")))
    return frame.select("id", "agent_id", "timestamp", metrics.alias("metrics"), F.col("timestamp").alias("created_at"))


@pytest.mark.parametrize("max_points", [1, 7, 500])
def test_downsampling_keeps_extremes(spark, at, max_points):
    r, week, end = random.Random(max_points), 7 * 86400, at(0)
    told = [(k, "hot" if k % 3 else f"a{k % 7}", end - timedelta(seconds=r.choice([0, week, week + 1, r.randrange(week)])), r.choice([None, r.randrange(-5, 100)])) for k in range(900)]
    told += told[:20] + [(5000, "hot", end + timedelta(seconds=1), 1000), (5001, "hot", None, 1000)]
    found = S.downsampled_points(snapshots(spark, told), "7d", end, max_points).collect()
    expected = {}
    for row_id, agent, time, v in told:
        if time is not None and (since := (time - (end - timedelta(seconds=week))).total_seconds()) >= 0 and time <= end:
            slot = min(int(since) * max_points // week, max_points - 1)
            expected.setdefault((agent, slot), []).append((time, row_id, float(v or 0)))
    assert [(x.agent_id, x.slice) for x in found] == sorted(expected)
    for x in found:
        samples = expected[x.agent_id, x.slice]
        values = [v for *_, v in samples]
        assert (x.samples, x.cpu_minimum, x.cpu_maximum, x.cpu_last) == (len(samples), min(values), max(values), max(samples)[2])
        assert (x.memory_last, x.timestamp.replace(tzinfo=None)) == (float(max(samples)[1]), max(samples)[0].replace(tzinfo=None)) and x["range"] == "7d"
    agents = {a for a, _ in expected}
    assert all(sum(a == b for a, _ in expected) <= max_points for b in agents)


def test_downsampling_of_nothing(spark, at):
    assert S.downsampled_points(snapshots(spark, []), "24h", at(0)).collect() == []
