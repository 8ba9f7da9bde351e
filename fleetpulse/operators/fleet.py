"""Fleet reads: newest snapshot, recent history, health and overview, for all agents at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fleetpulse import model
from fleetpulse.functions.clock import instant, row_order
from fleetpulse.functions.conditions import age_seconds, health_class
from fleetpulse.operators.joins import pick


def in_range(df: DataFrame, start=None, end=None, column: str = "timestamp") -> DataFrame:
    """Closed time range; a bound of None is no bound."""
    if start is not None:
        df = df.where(F.col(column) >= instant(start))
    if end is not None:
        df = df.where(F.col(column) <= instant(end))
    return df


def newest_rows(rows: DataFrame, n: int, key: str = "agent_id", rank=F.row_number) -> DataFrame:
    """The newest ``n`` rows per key, exactly, ties by id; with ``F.dense_rank`` rows of equal time and id count once.

    A day holds at most ``n`` of them, so each day is cut to ``n`` first. The final
    cut then sees ``n`` rows per day of a hot key and not its whole history.
    """
    newest_first = [F.desc("timestamp"), F.desc("id")]
    daily = Window.partitionBy(key, "_day").orderBy(*newest_first)
    overall = Window.partitionBy(key).orderBy(*newest_first)
    return (
        rows.withColumn("_day", F.date_trunc("day", "timestamp"))
        .withColumn("_rank", rank().over(daily))
        .where(F.col("_rank") <= n)
        .withColumn("_rank", rank().over(overall))
        .where(F.col("_rank") <= n)
        .drop("_day", "_rank")
    )


def _one_of_equals(rows: DataFrame) -> DataFrame:
    """One row of those that share agent, time and id (``_order``): the one stored last, if that is told, then the greater body."""
    last = [F.desc_nulls_last("created_at")] if "created_at" in rows.columns else []
    equals = Window.partitionBy("agent_id", "_order").orderBy(*last, F.desc_nulls_last(F.to_json("metrics")))
    return rows.withColumn("_equal", F.row_number().over(equals)).where(F.col("_equal") == 1).drop("_equal", "_order")


def _wanted(telemetry: DataFrame, keys: DataFrame, **sizes: int) -> DataFrame:
    """The snapshots of narrow keys (agent_id, _order), one each: no JSON is shuffled but theirs."""
    ordered = telemetry.withColumn("_order", row_order(F.col("timestamp"), F.col("id")))
    return _one_of_equals(pick(ordered, keys, ["agent_id", "_order"], **sizes))


def latest_telemetry(telemetry: DataFrame, **sizes: int) -> DataFrame:
    """Newest snapshot per agent, exactly one.

    The newest row is found from three narrow columns by hash aggregation. The second scan meets
    the rows found in the tasks that read the JSON, so the table is read twice, however many agents
    there are. Of rows with equal time and id (a snapshot posted twice) one is returned. Rows without
    an agent or a time are no snapshots of anyone.
    """
    order = row_order(F.col("timestamp"), F.col("id"))
    newest = telemetry.groupBy("agent_id").agg(F.max(order).alias("_order"))
    return _wanted(telemetry, newest, **sizes)


def history(telemetry: DataFrame, limit: int = model.HISTORY_DEFAULT, start=None, end=None, **sizes: int) -> DataFrame:
    """Newest ``limit`` snapshots per agent within a range, newest first; equal ones (agent, time, id) count once.

    Ranks narrow columns to find the rows wanted. The second scan drops all others in the tasks that
    read the JSON; only the rows wanted are sorted.
    """
    within = in_range(telemetry, start, end)
    narrow = within.select("agent_id", "timestamp", "id").where(F.col("agent_id").isNotNull() & F.col("timestamp").isNotNull())
    kept = newest_rows(narrow, limit, rank=F.dense_rank).select("agent_id", row_order(F.col("timestamp"), F.col("id")).alias("_order"))
    return _wanted(within, kept.distinct(), **sizes).orderBy("agent_id", F.desc("timestamp"), F.desc("id"))


def agent_history(telemetry: DataFrame, agent_id: str, limit: int = model.HISTORY_DEFAULT, start=None, end=None):
    """History of one agent: a top-n, which needs no ranking shuffle."""
    one = in_range(telemetry.where(F.col("agent_id") == agent_id), start, end)
    return one.orderBy(F.desc("timestamp"), F.desc("id")).limit(limit)


def last_seen(telemetry: DataFrame) -> DataFrame:
    return telemetry.groupBy("agent_id").agg(F.max("timestamp").alias("last_seen"))


def agent_health(
    agents: DataFrame, telemetry: DataFrame, as_of, healthy: int | None = None, stale: int | None = None
) -> DataFrame:
    """Status of every agent; one that never reported is offline."""
    seen = last_seen(telemetry).withColumnRenamed("agent_id", "id")
    age = age_seconds(F.col("last_seen"), instant(as_of))
    return (
        agents.select("id")
        .join(seen, "id", "left")
        .select(
            F.col("id").alias("agent_id"),
            health_class(age, healthy, stale).alias("status"),
            "last_seen",
            age.alias("seconds_since_last_seen"),
        )
    )


def fleet_overview(
    agents: DataFrame, telemetry: DataFrame, as_of, healthy: int | None = None, stale: int | None = None
) -> DataFrame:
    """One row: how many agents are in each state, and when the newest snapshot came."""
    status = F.col("status")
    return agent_health(agents, telemetry, as_of, healthy, stale).agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(status == "healthy").alias("healthy"),
        F.count_if(status == "stale").alias("stale"),
        F.count_if(status == "offline").alias("offline"),
        F.max("last_seen").alias("latest_telemetry"),
    )
