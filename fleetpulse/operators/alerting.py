"""Threshold rules over telemetry, and the alert episodes they lead to.

An episode starts at the first breaching sample that lies at least its hold time after
the first breaching sample of its run, and ends at the next sample that does not breach. A rule
may change while it breaches: every sample counts with the hold time of the rule as it was then.

One (rule, agent) may hold a large part of all samples, so no step sorts a whole history
in one task. Samples are ordered within short time chunks only. What one chunk has to know
of the others (the run open at its start, the first clear sample after it) is carried along
one summary row per chunk.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetpulse import model
from fleetpulse.functions import numbers as N
from fleetpulse.functions.clock import instant
from fleetpulse.functions.conditions import compare, health_thresholds
from fleetpulse.functions.text import alert_message, stable_id
from fleetpulse.operators.joins import fan_out, lookup

# At one sample in ten seconds a chunk holds 60 of them, and a month of one pair 4,320 chunks.
CHUNK_SECONDS = 600

PAIR = ["rule_id", "agent_id"]
CHUNK = [*PAIR, "chunk"]
EVALUATION = [*PAIR, "clock", "id", "value", "breaching", "hold_seconds"]


def metric_samples(telemetry: DataFrame, clock: str = "timestamp") -> DataFrame:
    """(agent_id, id, clock, metric, value): one row per metric a snapshot has a number for."""
    m = F.col("metrics")
    readings = [
        F.struct(F.lit(name).alias("metric"), N.strict_number(m, path).alias("value"))
        for name, path in model.RULE_METRICS.items()
    ]
    tall = telemetry.select("agent_id", "id", F.col(clock).alias("clock"), F.inline(F.array(*readings)))
    return tall.where(F.col("value").isNotNull())


def evaluate(samples: DataFrame, rules: DataFrame) -> DataFrame:
    """Each sample against the enabled rules of its metric."""
    active = rules.where("enabled").select(
        F.col("id").alias("rule_id"), "metric", "operator", "threshold",
        F.col("for_duration_seconds").alias("hold_seconds"),
    )
    breaching = compare(F.col("value"), F.col("operator"), F.col("threshold"))
    return (
        lookup(samples, active, ["metric"])
        .withColumn("breaching", breaching)
        .select(*EVALUATION)
    )


def offline_segments(
    agents: DataFrame, telemetry: DataFrame, start: datetime, step_seconds: int, count: int, healthy=None, stale=None
) -> DataFrame:
    """When agents are offline at ``count`` regular evaluation times, as ticks 0, 1, 2, ...

    Telemetry is folded to the newest sample per agent and interval. Such a sample holds from its tick
    ``first`` until before the tick ``until`` of the next one, and its agent is offline from the tick ``off`` on, when the
    sample has become stale; ``run`` is where that offline run began. An agent has a row per
    interval with samples and one for the time before, so a quiet agent costs nothing.
    """
    _, limit = health_thresholds(healthy, stale)
    begin, step = F.unix_micros(instant(start)), step_seconds * 1_000_000
    tick_after = lambda micros: F.greatest(F.ceil((micros - begin) / F.lit(step)), F.lit(0)).cast("bigint")
    seen = (
        telemetry.select("agent_id", tick_after(F.unix_micros("timestamp")).alias("first"), F.unix_micros("timestamp").alias("at"))
        .where(F.col("first") < count)
        .groupBy("agent_id", "first")
        .agg(F.max("at").alias("at"))
    )
    known = agents.select(F.col("id").alias("agent_id")).distinct()
    unseen = known.withColumns({"first": F.lit(0).cast("bigint"), "at": F.lit(None).cast("bigint")})
    in_time = Window.partitionBy("agent_id").orderBy("first", F.col("at").asc_nulls_first())
    so_far = in_time.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    off = F.greatest(F.col("first"), F.coalesce(tick_after(F.col("at") + limit * 1_000_000), F.lit(0).cast("bigint")))
    begins = F.col("offline") & ((F.col("off") > F.col("first")) | ~F.coalesce(F.lag("offline").over(in_time), F.lit(False)))
    return (
        seen.join(known, "agent_id", "left_semi")
        .unionByName(unseen)
        .withColumn("until", F.coalesce(F.lead("first").over(in_time), F.lit(count).cast("bigint")))
        .withColumn("off", off)
        .where(F.col("first") < F.col("until"))
        .withColumn("offline", F.col("off") < F.col("until"))
        .withColumn("begins", begins)
        .withColumn("run", F.last(F.when(F.col("begins"), F.col("off")), ignorenulls=True).over(so_far))
        .select("agent_id", "first", "off", "until", "run")
    )


def evaluate_offline(segments: DataFrame, rules: DataFrame, start: datetime, step_seconds: int) -> DataFrame:
    """Offline states (1 or 0) against the rules for them, whatever operator and threshold these name.

    Only the ticks that decide are rows: where an agent is back, where it goes offline, and where it
    has been so for the hold time. All segments share one metric, so every rule of it meets them all.
    """
    active = rules.where(F.col("enabled") & (F.col("metric") == model.OFFLINE_METRIC)).select(
        F.col("id").alias("rule_id"), F.col("for_duration_seconds").alias("hold_seconds")
    )
    back = F.when(F.col("first") < F.col("off"), F.col("first"))
    off = F.when(F.col("off") < F.col("until"), F.col("off"))
    due = F.col("run") + F.ceil(F.col("rule.hold_seconds") / F.lit(step_seconds)).cast("bigint")
    held = F.when((due > F.col("off")) & (due < F.col("until")), due)
    ticks = F.array_compact(F.array(back, off, held))
    clock = F.timestamp_micros(F.unix_micros(instant(start)) + F.col("id") * F.lit(step_seconds * 1_000_000))
    return (
        fan_out(segments, active, "rule")
        .withColumn("id", F.explode(ticks))
        .withColumn("breaching", F.col("id") >= F.col("off"))
        .withColumns({"clock": clock, "value": F.when(F.col("breaching"), 1.0).otherwise(0.0)})
        .select("*", "rule.*")
        .select(*EVALUATION)
    )


def _reaches(due: Column, first: Column) -> Column:
    """Whether a run that began at ``first`` had gone on long enough for a sample, or for one of several."""
    return F.coalesce(due >= F.unix_micros(first), F.lit(False))


def _marked(evaluations: DataFrame, chunk_seconds: int) -> DataFrame:
    """Samples with their place in the runs of their chunk.

    ``run``     first breaching sample (clock, id) of the run the sample belongs to, within the chunk
    ``leading`` breaching, with no clear sample before it in the chunk
    ``due``     a run that began by then has been held long enough at the sample
    ``reach``   the latest ``due`` of the samples before it in its run, within the chunk

    The frame is read twice, for the summary and for the candidates. The key filter stands
    here so that both readings have the same plan below the shuffle and share it.
    """
    chunk = F.floor(F.unix_seconds("clock") / chunk_seconds).cast("bigint")
    here = Window.partitionBy(*CHUNK).orderBy("clock", "id")
    so_far = here.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    breaching = F.col("breaching")
    run_start = F.when(breaching & ~F.coalesce("prev_breaching", F.lit(False)), F.struct("clock", "id"))
    # Runs come one after the other, so the greatest of all before is of the sample's own run if that has any.
    latest = F.max(F.when(breaching, F.struct("run", "due"))).over(here.rowsBetween(Window.unboundedPreceding, -1))
    return (
        evaluations.withColumn("chunk", chunk)
        .where(F.col("rule_id").isNotNull() & F.col("agent_id").isNotNull() & F.col("chunk").isNotNull())
        .withColumn("due", F.unix_micros("clock") - F.col("hold_seconds") * F.lit(1_000_000).cast("bigint"))
        .withColumn("prev_breaching", F.lag("breaching").over(here))
        .withColumns(
            {
                "run": F.last(run_start, ignorenulls=True).over(so_far),
                "leading": breaching & ~F.max(~breaching).over(so_far),
            }
        )
        .withColumn("_latest", latest)
        .withColumn("reach", F.when(breaching & (F.col("_latest.run") == F.col("run")), F.col("_latest.due")))
        .drop("_latest")
    )


def _chunk_summary(marked: DataFrame) -> DataFrame:
    """Per chunk: its first clear sample, and the run still open at its end, if any."""
    sample = F.struct("clock", "id", "value")
    breaching = F.col("breaching")
    open_run = [F.when(breaching, F.col("run.clock")).alias("open_first"), F.when(breaching, F.greatest("reach", "due")).alias("open_reach")]
    return (
        marked.groupBy(*CHUNK)
        .agg(
            F.min(F.when(~breaching, sample)).alias("first_clear"),
            F.max(F.struct("clock", "id", *open_run)).alias("tail"),
        )
        .select(
            *CHUNK,
            "first_clear",
            F.col("tail.open_first").alias("open_first"),
            F.col("tail.open_reach").alias("open_reach"),
            F.col("tail.clock").alias("last_clock"),
            F.col("tail.id").alias("last_id"),
        )
    )


def _carried(summary: DataFrame) -> DataFrame:
    """Adds what each chunk gets from its neighbours; one row per chunk, so rows stay few.

    ``open_out``    start of the run open at the chunk's end
    ``reach_out``   the latest ``due`` of that run so far
    ``open_in``, ``reach_in``  the same for the chunk before
    ``next_clear``  first clear sample in a later chunk
    """
    forward = Window.partitionBy(*PAIR).orderBy("chunk")
    so_far = forward.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    later = Window.partitionBy(*PAIR).orderBy(F.desc("chunk")).rowsBetween(Window.unboundedPreceding, -1)
    # A chunk decides anew what is open at its end unless it only prolongs an open run.
    prolongs = F.col("first_clear").isNull() & F.col("_open_before").isNotNull()
    decided = F.when(~prolongs, F.struct("chunk", "open_first"))
    return (
        summary.withColumn("_open_before", F.lag("open_first").over(forward))
        .withColumn("_decided", F.last(decided, ignorenulls=True).over(so_far))
        .withColumns({"open_out": F.col("_decided.open_first"), "_reach": F.max(F.struct("_decided.chunk", "open_reach")).over(so_far)})
        .withColumn("reach_out", F.col("_reach.open_reach"))
        .withColumns(
            {
                "open_in": F.lag("open_out").over(forward),
                "reach_in": F.lag("reach_out").over(forward),
                "next_clear": F.last("first_clear", ignorenulls=True).over(later),
            }
        )
        .drop("_open_before", "_decided", "_reach")
    )


def episodes_and_chunks(
    evaluations: DataFrame, chunk_seconds: int = CHUNK_SECONDS, before: DataFrame | None = None
) -> tuple[DataFrame, DataFrame]:
    """Episodes that start in the samples, and the carried chunk summary.

    ``before`` has one summary row per pair that stands for all earlier samples; a stream
    passes what it remembered of them.
    """
    marked = _marked(evaluations, chunk_seconds)
    summary = _chunk_summary(marked)
    if before is not None:
        summary = summary.unionByName(before)
    carried = _carried(summary)

    breaching, leading, due = F.col("breaching"), F.col("leading"), F.col("due")
    clears_run = ~breaching & F.coalesce("prev_breaching", F.lit(False))
    first_held = breaching & _reaches(due, F.col("run.clock")) & ~_reaches(F.col("reach"), F.col("run.clock"))
    candidates = marked.where(clears_run | leading | first_held)

    continues = leading & F.col("open_in").isNotNull()
    first = F.when(continues, F.col("open_in")).otherwise(F.col("run.clock"))
    reach = F.when(continues, F.greatest("reach", "reach_in")).otherwise(F.col("reach"))
    fires = breaching & _reaches(due, first) & ~_reaches(reach, first)

    neighbours = carried.select(*CHUNK, "open_in", "reach_in", "next_clear")
    marks = (
        candidates.join(neighbours, CHUNK)
        .withColumns({"fires": fires, "first_breach": first})
        .where(F.col("fires") | ~breaching)
    )
    # Within a chunk the mark after a firing one is the clear sample that ends its run.
    here = Window.partitionBy(*CHUNK).orderBy("clock", "id")
    cleared_here = F.lead(F.struct("clock", "id", "value")).over(here)
    episodes = (
        marks.withColumn("cleared", F.coalesce(cleared_here, "next_clear"))
        .where("fires")
        .select(
            *PAIR,
            "first_breach",
            F.col("clock").alias("started_at"),
            F.col("id").alias("started_id"),
            F.col("value").alias("started_value"),
            F.col("cleared.clock").alias("resolved_at"),
            F.col("cleared.id").alias("resolved_id"),
            F.col("cleared.value").alias("resolved_value"),
        )
    )
    return episodes, carried


def alert_episodes(evaluations: DataFrame, chunk_seconds: int = CHUNK_SECONDS) -> DataFrame:
    return episodes_and_chunks(evaluations, chunk_seconds)[0]


def alert_id() -> Column:
    return stable_id("alert", F.col("rule_id"), F.col("agent_id"), F.unix_micros("started_at"), F.col("started_id"))


def alerts(episodes: DataFrame, rules: DataFrame) -> DataFrame:
    """Alert rows before anyone acted on them: firing or resolved, with their rule's name and severity.

    ``last_value`` is the value that fired, or after resolution the value that cleared.
    """
    named = rules.select(
        F.col("id").alias("rule_id"), F.col("name").alias("rule_name"), "severity", "operator", "threshold"
    )
    resolved = F.col("resolved_at").isNotNull()
    message = alert_message(
        F.col("severity"), F.col("rule_name"), F.col("started_value"), F.col("operator"), F.col("threshold")
    )
    return lookup(episodes, named, ["rule_id"]).select(
        alert_id().alias("id"),
        *PAIR,
        F.when(resolved, "resolved").otherwise("firing").alias("status"),
        "started_at",
        "resolved_at",
        "started_value",
        F.when(resolved, F.col("resolved_value")).otherwise(F.col("started_value")).alias("last_value"),
        message.alias("message"),
        F.col("started_at").alias("created_at"),
        "rule_name",
        "severity",
    )
