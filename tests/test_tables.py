"""Stored tables, the retention job and the join helpers."""

from datetime import datetime, timedelta, timezone

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from fleetpulse.operators import joins as J
from fleetpulse.operators import maintenance as M
from fleetpulse.operators import retention as R
from fleetpulse.operators import rollup as U
from fleetpulse.sources import tables as S

NOON = datetime(2024, 1, 10, 12, 30, tzinfo=timezone.utc)


def snapshots(spark, days=8):
    """One row per half hour and agent, the last ones at NOON."""
    count = days * 48
    return spark.range(count * 2).select(
        "id",
        F.concat(F.lit("agent-"), (F.col("id") % 2).cast("string")).alias("agent_id"),
        (F.lit(NOON) - F.make_dt_interval(F.lit(0), F.lit(0), (F.floor(F.col("id") / 2) * 30).cast("int"))).alias("timestamp"),
        F.parse_json(F.lit('{"system":{"cpu":{"usage_percent":5}}}')).alias("metrics"),
    )


def test_append_prunes_by_date(spark, tmp_path):
    path = str(tmp_path / "t")
    S.append_telemetry(snapshots(spark), path)
    S.append_telemetry(snapshots(spark).limit(3), path)
    assert spark.read.parquet(path).count() == 8 * 96 + 3
    day = S.read_telemetry(spark, path, "2024-01-08", "2024-01-08")
    assert day.count() == 96
    assert "PartitionFilters: [isnotnull(event_date" in day._jdf.queryExecution().executedPlan().toString()


def test_scan_reads_named_paths_and_skips_by_time(spark, tmp_path):
    path = str(tmp_path / "t")
    S.append_telemetry(snapshots(spark, 1), path)
    recent = spark.read.parquet(path).where(F.col("timestamp") > F.lit(NOON))
    cpu = recent.select(F.try_variant_get("metrics", "$.system.cpu.usage_percent", "double"))
    plan = cpu._jdf.queryExecution().executedPlan().toString()
    assert "metrics:struct<0:double>" in plan
    assert "GreaterThan(timestamp,2024-01-10 12:30" in plan
    columns = pq.ParquetFile(next((tmp_path / "t").rglob("*.parquet"))).metadata.row_group(0)
    times = [columns.column(i) for i in range(columns.num_columns) if columns.column(i).path_in_schema == "timestamp"]
    assert times[0].is_stats_set and times[0].statistics.has_min_max


@pytest.mark.parametrize("align", ["exact", "hour"])
def test_retention_run(spark, tmp_path, align):
    raw, hourly = str(tmp_path / "raw"), str(tmp_path / "hourly")
    S.append_telemetry(snapshots(spark), raw)
    before = U.hourly_rollup(snapshots(spark), NOON).count()
    R.run_retention(spark, raw, hourly, NOON, days=3, align=align)
    oldest = spark.read.parquet(raw).agg(F.min("timestamp").cast("timestamp_ntz")).first()[0]
    edge = NOON - timedelta(days=3)
    assert oldest == (edge if align == "exact" else edge.replace(minute=0)).replace(tzinfo=None)
    assert R.read_rollup(spark, hourly).count() == before

    R.run_retention(spark, raw, hourly, NOON, days=3, align=align)
    table = R.read_rollup(spark, hourly)
    assert table.count() == before
    hour = table.where(F.col("bucket_start") == F.lit(edge.replace(minute=0)))
    # An exact cut leaves half of its hour, and the second run rolls up that half only.
    assert {r.sample_count for r in hour.collect()} == ({1} if align == "exact" else {2})


def test_retention_since(spark, tmp_path):
    raw, hourly = str(tmp_path / "raw"), str(tmp_path / "hourly")
    S.append_telemetry(snapshots(spark), raw)
    R.run_retention(spark, raw, hourly, NOON, since=NOON - timedelta(hours=2))
    assert R.read_rollup(spark, hourly).count() == 4


def test_purge_matches_the_keep_filter(spark, tmp_path):
    raw = str(tmp_path / "raw")
    S.append_telemetry(snapshots(spark), raw)
    S.purge_telemetry(spark, raw, R.cutoff_time(NOON, 2))
    kept = M.retained(snapshots(spark), NOON, 2)
    assert {r.id for r in spark.read.parquet(raw).collect()} == {r.id for r in kept.collect()}
    report = M.purge_report(snapshots(spark), NOON, 2).first()
    assert report.kept == kept.count() and report.purged + report.kept == 8 * 96


class Stop(Exception):
    pass


@pytest.mark.parametrize("step", range(3))
def test_a_purge_stopped_at_any_step_loses_nothing(spark, tmp_path, monkeypatch, step):
    raw = str(tmp_path / "raw")
    S.append_telemetry(snapshots(spark), raw)
    move, calls = S._move, []

    def failing(fs, source, target):
        calls.append(1)
        if len(calls) > step:
            raise Stop
        move(fs, source, target)

    monkeypatch.setattr(S, "_move", failing)
    with pytest.raises(Stop):
        S.purge_telemetry(spark, raw, R.cutoff_time(NOON, 2))
    monkeypatch.setattr(S, "_move", move)
    S.purge_telemetry(spark, raw, R.cutoff_time(NOON, 2))
    kept = {r.id for r in M.retained(snapshots(spark), NOON, 2).collect()}
    assert {r.id for r in spark.read.parquet(raw).collect()} == kept
    assert not [p for p in (tmp_path / "raw").iterdir() if p.name.startswith(("_old", "_ready", "_stage"))]


@pytest.mark.parametrize("step", [0, 1, 2, 4, 7])
def test_a_rollup_stopped_at_any_step_keeps_all_hours(spark, tmp_path, monkeypatch, step):
    raw, hourly = str(tmp_path / "raw"), str(tmp_path / "hourly")
    S.append_telemetry(snapshots(spark, 4), raw)
    R.run_retention(spark, raw, hourly, NOON, days=3)
    before = sorted(map(tuple, R.read_rollup(spark, hourly).select("agent_id", "bucket_start").collect()))
    move, calls = S._move, []

    def failing(fs, source, target):
        calls.append(1)
        if len(calls) > step:
            raise Stop
        move(fs, source, target)

    monkeypatch.setattr(S, "_move", failing)
    with pytest.raises(Stop):
        R.run_retention(spark, raw, hourly, NOON, days=2)
    monkeypatch.setattr(S, "_move", move)
    assert sorted(map(tuple, R.read_rollup(spark, hourly).select("agent_id", "bucket_start").collect())) == before
    R.run_retention(spark, raw, hourly, NOON, days=2)
    assert sorted(map(tuple, R.read_rollup(spark, hourly).select("agent_id", "bucket_start").collect())) == before


def test_following_runs_rewrite_only_new_dates(spark, tmp_path):
    raw, hourly = str(tmp_path / "raw"), tmp_path / "hourly"
    S.append_telemetry(snapshots(spark), raw)
    R.run_retention(spark, raw, str(hourly), NOON - timedelta(days=1))
    files = {p.parent.name: p.name for p in hourly.rglob("*.parquet")}
    R.run_retention(spark, raw, str(hourly), NOON, follow=timedelta(hours=1))
    again = {p.parent.name: p.name for p in hourly.rglob("*.parquet")}
    assert {d for d in again if again[d] != files.get(d)} == {"bucket_date=2024-01-09", "bucket_date=2024-01-10"}
    whole = U.hourly_rollup(snapshots(spark), NOON)
    assert R.read_rollup(spark, str(hourly)).count() == whole.count()


def test_row_exactly_at_the_cutoff_stays(spark):
    df = spark.createDataFrame([(1, NOON - timedelta(days=30)), (2, NOON - timedelta(days=30, microseconds=1))], "id bigint, timestamp timestamp")
    assert [r.id for r in M.retained(df, NOON, 0).collect()] == [1]


def test_versions(spark, tmp_path):
    root = str(tmp_path / "v")
    assert S.current(spark, root) is None
    assert S.publish(spark.range(3), root) == 1
    assert S.publish(spark.range(5), root) == 2
    assert S.publish(spark.range(4), root, version=2) == 2
    assert S.current(spark, root).count() == 4
    assert S.current(spark, root, below=2).count() == 3
    (tmp_path / "v" / "version=3").mkdir()
    assert S.current(spark, root).count() == 4


def hot(spark):
    """Half of all rows share key 0."""
    return spark.range(2000).select("id", F.when(F.col("id") % 2 == 0, 0).otherwise(F.col("id") % 50).alias("k"))


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_lookup_equals_plain_join(spark, how):
    dim = spark.range(0, 40, 2).select(F.col("id").alias("k"), (F.col("id") * 10).alias("v"))
    plain = hot(spark).join(dim, ["k"], how)
    for joined in (J.lookup(hot(spark), dim, ["k"], how), J.lookup(hot(spark), dim, ["k"], how, limit=0)):
        assert sorted(map(tuple, joined.select(plain.columns).collect())) == sorted(map(tuple, plain.collect()))


SKEW = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.shuffle.partitions": "200",
    "spark.sql.adaptive.coalescePartitions.enabled": "false",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16k",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "32k",
}


@pytest.fixture
def skew_settings(spark):
    before = {k: spark.conf.get(k) for k in SKEW}
    for k, v in SKEW.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def test_a_hot_key_is_split_over_tasks(spark, tmp_path, skew_settings):
    """A third of the rows share a key; 200 partitions. The rows in the fullest task stay near the median."""
    rows = spark.range(0, 400_000, 1, 32).select(F.xxhash64("id").alias("h"), F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 20_000).alias("k"))
    rows.write.parquet(f"{tmp_path}/rows")
    dim = spark.range(20_000).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    dim.write.parquet(f"{tmp_path}/dim")
    left, right = spark.read.parquet(f"{tmp_path}/rows"), spark.read.parquet(f"{tmp_path}/dim")
    joined = J.lookup(left, right, ["k"], limit=0)
    tasks = joined.select("h", "v", F.spark_partition_id().alias("p")).groupBy("p")
    sizes = sorted(r["n"] for r in tasks.agg(F.count("*").alias("n"), F.max("h"), F.max("v")).collect())
    assert sum(sizes) == 400_000
    assert sizes[-1] < 30_000, "one task would hold 133,000"


def test_uniform_keys_are_not_repeated(spark, skew_settings):
    dim = spark.range(5000).select(F.col("id").alias("k"), F.lit(1).alias("v"))
    joined = J.lookup(spark.range(5000).select(F.col("id").alias("k")), dim, ["k"], limit=0)
    assert "Generate" not in joined._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("limit", [J.BROADCAST_BYTES, 100])
def test_pick(spark, limit):
    narrow = spark.range(0, 40, 2).select(F.col("id").alias("k"), F.lit(7).alias("v"))
    assert J.pick(hot(spark), narrow, ["k"], limit).count() == hot(spark).join(narrow, "k").count()


@pytest.mark.parametrize("limit", [J.BROADCAST_BYTES, 0])
def test_fan_out(spark, limit):
    items = spark.range(5).select(F.col("id").alias("item"), F.lit("x").alias("s"))
    out = J.fan_out(hot(spark), items, "i", limit)
    assert out.count() == 2000 * 5
    assert out.select("id", "i.item").distinct().count() == 2000 * 5
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_a_large_fan_out_uses_all_tasks(spark, skew_settings):
    items = spark.range(400).select(F.col("id").alias("item"))
    out = J.fan_out(hot(spark), items, "i", 0)
    assert out.groupBy(F.spark_partition_id()).count().count() > 150


def test_fan_out_to_nothing(spark):
    items = spark.range(5).where("id < 0")
    assert J.fan_out(hot(spark), items, "i").count() == 0
