"""The stored rollup kept up by touched hours: equal to a rollup of everything, and no more work than needed."""

import os
import random
from datetime import timedelta
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from fleetpulse import model
from fleetpulse.operators.retention import read_rollup
from fleetpulse.operators.rollup import hourly_rollup
from fleetpulse.streaming import touched as P

AS_OF = 6 * 86400


def rows(seed, n=400, late=0):
    r = random.Random(seed)
    return [(1000 * seed + k, None if k % 97 == 50 else f"agent-{k % 9 and 'hot' or k % 4}", r.randrange(AS_OF if not late else late)) for k in range(n)]


def telemetry(spark, at, given):
    frame = spark.createDataFrame([(i, a, at(s)) for i, a, s in given], "id bigint, agent_id string, timestamp timestamp")
    metrics = F.parse_json(F.concat(F.lit('{"system":{"cpu":{"usage_percent":'), F.col("id").cast("string"), F.lit("}}}")))
    return frame.select("id", "agent_id", "timestamp", metrics.alias("metrics"), F.col("timestamp").alias("created_at"))


def take(spark, at, tmp_path, given, part):
    telemetry(spark, at, given).coalesce(1).write.parquet(f"{tmp_path}/in/p{part}")
    stream = spark.readStream.schema(model.TELEMETRY).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    P.start_store(stream, f"{tmp_path}/raw", f"{tmp_path}/ledger", f"{tmp_path}/checkpoint").awaitTermination()


def patch(spark, at, tmp_path, as_of=AS_OF, **more):
    return P.patch_rollup(spark, f"{tmp_path}/raw", f"{tmp_path}/rollup", f"{tmp_path}/ledger", at(as_of), **more)


def told(df):
    columns = sorted(set(df.columns) - {"bucket_date"})
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def files(tmp_path):
    return {d.name: sorted((p.name, os.stat(p).st_mtime_ns) for p in d.glob("*.parquet")) for d in Path(tmp_path, "rollup").glob("bucket_date=*")}


def test_rows_that_come_days_late(spark, at, tmp_path):
    first, late = rows(1), rows(2, 30, 86400 + 7200)
    take(spark, at, tmp_path, first, 0)
    assert patch(spark, at, tmp_path) > 100
    known = telemetry(spark, at, first).where("agent_id IS NOT NULL")
    assert told(read_rollup(spark, f"{tmp_path}/rollup")) == told(hourly_rollup(known, at(AS_OF)))
    before = files(tmp_path)
    take(spark, at, tmp_path, late, 1)
    assert 0 < patch(spark, at, tmp_path) <= len(late)
    known = telemetry(spark, at, first + late).where("agent_id IS NOT NULL")
    assert told(read_rollup(spark, f"{tmp_path}/rollup")) == told(hourly_rollup(known, at(AS_OF)))
    after = files(tmp_path)
    changed = {day for day in after if after[day] != before.get(day)}
    assert 0 < len(changed) < len(after) - 2
    assert patch(spark, at, tmp_path) == 0 and files(tmp_path) == after


def test_open_hours_wait(spark, at, tmp_path):
    given = [(k, "a", k * 900) for k in range(20)]
    take(spark, at, tmp_path, given, 0)
    for as_of in (7000, 9000, 18_001):
        patch(spark, at, tmp_path, as_of)
        expected = hourly_rollup(telemetry(spark, at, given), at(as_of))
        assert told(read_rollup(spark, f"{tmp_path}/rollup")) == told(expected)
    patch(spark, at, tmp_path, 90_000)
    assert patch(spark, at, tmp_path, 90_000) == 0


def test_a_stop_before_the_entries_go(spark, at, tmp_path, monkeypatch):
    take(spark, at, tmp_path, rows(3, 60), 0)
    with monkeypatch.context() as m:
        m.setattr(P, "remove", lambda *a: (_ for _ in ()).throw(RuntimeError("stopped")))
        with pytest.raises(RuntimeError):
            patch(spark, at, tmp_path)
    assert patch(spark, at, tmp_path) > 0
    known = telemetry(spark, at, rows(3, 60)).where("agent_id IS NOT NULL")
    assert told(read_rollup(spark, f"{tmp_path}/rollup")) == told(hourly_rollup(known, at(AS_OF)))
    assert patch(spark, at, tmp_path) == 0


def test_purged_hours_keep_their_rollup(spark, at, tmp_path):
    take(spark, at, tmp_path, [(1, "a", 100), (2, "a", 90_000)], 0)
    patch(spark, at, tmp_path)
    before = told(read_rollup(spark, f"{tmp_path}/rollup"))
    take(spark, at, tmp_path, [(3, "a", 200)], 1)
    assert patch(spark, at, tmp_path, oldest=at(0) + timedelta(hours=5)) == 0
    assert told(read_rollup(spark, f"{tmp_path}/rollup")) == before


def test_nothing_noted(spark, at, tmp_path):
    assert patch(spark, at, tmp_path) == 0
