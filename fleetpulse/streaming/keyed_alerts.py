"""Alert lifecycle and the offline rule with keyed state: what a micro-batch writes follows the buckets of pairs it touches.

State is a few numbers per (rule, agent) in Spark's state store, a row for each bucket of pairs, written as changes per
batch. Before it, a micro-batch is packed in parallel: samples to one row per pair and chunk, heartbeats to one per
agent and evaluation tick. So a hot agent reaches its state as few rows, which are folded as arrays.
Both streams append changes (``firing``, ``resolved``, ``late``) to a table; ``episodes`` reads them back as episodes.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime, timezone

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetpulse import model
from fleetpulse.functions.clock import instant
from fleetpulse.functions.conditions import health_thresholds
from fleetpulse.operators import alerting as A
from fleetpulse.operators.joins import fan_out
from fleetpulse.streaming.buckets import BUCKETS, by_bucket

SAMPLE = np.dtype([("clock", "<i8"), ("id", "<i8"), ("value", "<f8"), ("hold", "<i8"), ("breaching", "?")])
FIRING, RESOLVED, LATE = "firing", "resolved", "late"
SECOND = 1_000_000
LATENESS = "10 minutes"

_CHANGE = (
    "rule_id string, agent_id string, change string, first_breach long, started_at long, started_id long, started_value double, "
    "resolved_at long, resolved_id long, resolved_value double"
)
_TIMES = ["first_breach", "started_at", "resolved_at"]


def _as_times(changes: DataFrame) -> DataFrame:
    return changes.withColumns({c: F.timestamp_micros(c) for c in _TIMES})


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per (rule, agent, chunk) with its samples in order, from all rows of a task."""
    names = ["rule_id", "agent_id", "chunk", "clock", "id", "value", "hold", "breaching"]
    taken = pa.Table.from_batches(list(batches)) if (batches := [b for b in batches if b.num_rows]) else None
    if taken is None:
        return
    rows = taken.sort_by([(c, "ascending") for c in names[:5]])
    samples = np.empty(rows.num_rows, SAMPLE)
    for c in SAMPLE.names:
        samples[c] = rows.column(c).to_numpy()
    codes = [rows.column(c).combine_chunks().dictionary_encode().indices.to_numpy() for c in names[:2]] + [rows.column("chunk").to_numpy()]
    begins = np.flatnonzero(np.concatenate([[True], np.any([c[1:] != c[:-1] for c in codes], axis=0)]))
    blobs = [samples[a:b].tobytes() for a, b in zip(begins, np.append(begins[1:], len(samples)))]
    first = rows.select(names[:3]).take(pa.array(begins)).combine_chunks()
    yield pa.RecordBatch.from_arrays([*[first.column(c).combine_chunks() for c in names[:3]], pa.array(blobs, pa.binary())], [*names[:3], "samples"])


def chunk_rows(evaluations: DataFrame, chunk_seconds: int = A.CHUNK_SECONDS) -> DataFrame:
    """(rule_id, agent_id, chunk, samples) of a micro-batch; a pair with a third of all samples is spread by its chunks."""
    chunk = F.floor(F.unix_seconds("clock") / chunk_seconds).cast("bigint")
    narrow = evaluations.select(
        *A.PAIR, chunk.alias("chunk"), F.unix_micros("clock").alias("clock"), "id", "value", F.col("hold_seconds").cast("bigint").alias("hold"), "breaching"
    ).where(F.col("rule_id").isNotNull() & F.col("agent_id").isNotNull() & F.col("chunk").isNotNull() & F.col("breaching").isNotNull())
    return narrow.repartition(*A.CHUNK).mapInArrow(_packed, "rule_id string, agent_id string, chunk long, samples binary")


def _fold(_: tuple, rows: list[tuple], life: list | None, __: int) -> tuple[list, None, list[tuple]]:
    """Walks the runs of a pair's new samples, from what is known of the earlier ones."""
    samples = np.frombuffer(b"".join(b for (b,) in rows), SAMPLE)
    samples = samples[np.lexsort((samples["id"], samples["clock"]))]
    open_first, last_clock, last_id, *active = life or (None,) * 7
    active = None if active[1] is None else tuple(active)
    told = []
    if last_clock is not None:
        late = (samples["clock"] < last_clock) | ((samples["clock"] == last_clock) & (samples["id"] <= last_id))
        told += [(LATE, None, None, None, None, int(s["clock"]), int(s["id"]), float(s["value"])) for s in samples[late]]
        samples = samples[~late]
    if len(samples):
        breaching = samples["breaching"]
        begins = np.flatnonzero(np.concatenate([[True], breaching[1:] != breaching[:-1]]))
        for a, b in zip(begins, np.append(begins[1:], len(samples))):
            run = samples[a:b]
            if not breaching[a]:
                if active:
                    told.append((RESOLVED, *active, int(run[0]["clock"]), int(run[0]["id"]), float(run[0]["value"])))
                open_first = active = None
                continue
            open_first = int(run[0]["clock"]) if open_first is None else open_first
            if not active:
                held = np.flatnonzero(run["clock"] - run["hold"] * SECOND >= open_first)
                if len(held):
                    s = run[held[0]]
                    active = (open_first, int(s["clock"]), int(s["id"]), float(s["value"]))
                    told.append((FIRING, *active, None, None, None))
        life = [open_first, int(samples[-1]["clock"]), int(samples[-1]["id"]), *(active or (None,) * 4)]
    return life, None, told


def alert_changes(evaluations: DataFrame, chunk_seconds: int = A.CHUNK_SECONDS, buckets: int = BUCKETS) -> DataFrame:
    """Changes of a stream of ``alerting.evaluate`` rows; equal to the batch operator on samples in order.

    * A sample not newer than the last one its pair was judged on changes nothing; it comes out as ``late``, with
      its own values in the ``resolved`` columns.
    * Rules may differ from sample to sample (``hold_seconds`` of each). Those the query was started with
      hold until it is started again; the state stays.
    * Rows without rule, agent, time or answer are left out.
    """
    return _as_times(by_bucket(chunk_rows(evaluations, chunk_seconds), A.PAIR, ["samples"], _fold, _CHANGE, buckets=buckets))


def _newest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The newest heartbeat per agent and tick of a task's rows, and whether one was a registration."""
    newest: dict[tuple, tuple] = {}
    for batch in batches:
        frame = pa.Table.from_batches([batch]).group_by(["agent_id", "tick", "registered"]).aggregate([("at", "max")])
        for agent, tick, registered, at in zip(*(frame.column(c).to_pylist() for c in ("agent_id", "tick", "registered", "at_max"))):
            key = (agent, tick, registered)
            newest[key] = max(at, newest.get(key, at))
    keys, ats = list(newest), list(newest.values())
    kinds = (pa.string(), pa.int64(), pa.bool_())
    columns = [pa.array([k[i] for k in keys], kind) for i, kind in enumerate(kinds)]
    yield pa.RecordBatch.from_arrays([*columns, pa.array(ats, pa.int64())], ["agent_id", "tick", "registered", "at"])


def _watch(begin: int, step: int, limit: int):
    """Judge of one (rule, agent): what the ticks up to the watermark show, and when to look at the next that matters.

    ``first``, ``at``  the tick from which the newest heartbeat counts, and its time
    ``run``, ``fired`` the ticks at which the offline run began and at which it fired
    ``waiting``        heartbeats that count from a tick which the watermark has not passed
    """
    ceil = lambda micros: max(0, -((begin - micros) // step))
    clock = lambda tick: begin + tick * step

    def run(_: tuple, rows: list[tuple], life: list | None, watermark_ms: int) -> tuple[list, int | None, list[tuple]]:
        known, done, first, at, began, fired, hold, waiting = life or (False, -1, None, None, None, None, 0, [])
        watermark, wake = watermark_ms * 1000, None
        passed = (watermark - begin) // step if watermark >= begin else -1
        waiting = dict(waiting)
        for tick, registered, when, held in rows:
            hold = int(held)
            if registered and not known:
                known, first = True, max(tick, done + 1)
            elif not registered:
                waiting[tick] = max(when, waiting.get(tick, when))
        told = []

        def change(kind: str, resolved: int | None = None) -> None:
            end = (clock(resolved), resolved, 0.0) if resolved is not None else (None, None, None)
            told.append((kind, clock(began), clock(fired), fired, 1.0, *end))

        stale_from = lambda: max(first, ceil(at + limit)) if at is not None else first
        due = lambda: began + -(-hold * SECOND // step)

        def advance(to: int) -> None:
            nonlocal began, fired, done
            if began is None and stale_from() <= to:
                began = stale_from()
            if began is not None and fired is None and due() <= to:
                fired = due()
                change(FIRING)
            done = max(done, to)

        if known:
            for tick in sorted(t for t in waiting if t <= passed):
                if tick > first:
                    advance(tick - 1)
                first, at = max(tick, first), max(waiting.pop(tick), at or 0)
                if stale_from() > first:
                    if fired is not None:
                        change(RESOLVED, first)
                    began = fired = None
            if first <= passed:
                advance(passed)
            later = [*waiting]
            if began is None:
                later.append(stale_from())
            elif fired is None:
                later.append(due())
            if later:
                wake = -(-clock(max(min(later), passed + 1)) // 1000)
        elif waiting:  # not registered yet: only the newest heartbeat can matter
            waiting = dict([max(waiting.items())])
        return [known, done, first, at, began, fired, hold, list(waiting.items())], wake, told

    return run


def offline_changes(
    agents: DataFrame, telemetry: DataFrame, rules: DataFrame, start: datetime, step_seconds: int,
    healthy: int | None = None, stale: int | None = None, lateness: str = LATENESS, buckets: int = BUCKETS,
) -> DataFrame:
    """Changes of the offline rules over streams of registrations (id, at) and telemetry, judged every ``step_seconds`` from ``start``.

    An agent goes offline because nothing came: a timer in event time stands at the next tick at which its
    state can change, and fires when the watermark (the newest time of all agents, less ``lateness``) has passed it.
    Equal to ``evaluate_offline`` with ``alert_episodes`` up to the watermark, in whatever order rows come that are not late.

    * An agent is judged from its registration on; heartbeats of others are kept until they register, the newest only.
    * State holds of each agent, besides five numbers, a heartbeat per tick that the watermark has not passed.
    * Rows without agent or time are left out, rows behind the watermark are late and dropped.
    """
    _, limit = health_thresholds(healthy, stale)
    if start.tzinfo is None:
        start = start.replace(tzinfo=timezone.utc)
    begin, step = int(start.timestamp()) * SECOND, step_seconds * SECOND
    tick = F.greatest(F.ceil((F.col("at") - begin) / F.lit(step)), F.lit(0)).cast("bigint")
    heard = telemetry.select("agent_id", F.unix_micros("timestamp").alias("at"), F.lit(False).alias("registered"))
    met = agents.select(F.col("id").alias("agent_id"), F.unix_micros("at").alias("at"), F.lit(True).alias("registered"))
    beats = heard.unionByName(met).where(F.col("agent_id").isNotNull() & F.col("at").isNotNull()).select("agent_id", tick.alias("tick"), "registered", "at")
    newest = beats.mapInArrow(_newest, "agent_id string, tick long, registered boolean, at long")
    timed = newest.withColumn("clock", F.timestamp_micros("at")).withWatermark("clock", lateness)
    active = rules.where(F.col("enabled") & (F.col("metric") == model.OFFLINE_METRIC)).select(
        F.col("id").alias("rule_id"), F.col("for_duration_seconds").alias("hold_seconds")
    )
    asked = fan_out(timed, active, "rule").select("rule.rule_id", "agent_id", "tick", "registered", "at", "rule.hold_seconds", "clock")
    values = ["tick", "registered", "at", "hold_seconds"]
    return _as_times(by_bucket(asked, A.PAIR, values, _watch(begin, step, limit * SECOND), _CHANGE, "clock", buckets))


def episodes(changes: DataFrame) -> DataFrame:
    """Episodes of appended changes: each fired once and resolved at most once."""
    end = F.struct("resolved_at", "resolved_id", "resolved_value")
    begun = ["first_breach", "started_at", "started_id", "started_value"]
    return (
        changes.where(F.col("change") != LATE)
        .groupBy(*A.PAIR, *begun)
        .agg(F.max(F.when(F.col("change") == RESOLVED, end)).alias("end"))
        .select(*A.PAIR, *begun, "end.resolved_at", "end.resolved_id", "end.resolved_value")
    )
