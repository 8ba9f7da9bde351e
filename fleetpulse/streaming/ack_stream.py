"""Acknowledgements on streams: firings, resolutions and commands meet per alert, in order of event time."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetpulse.operators.incidents import actor
from fleetpulse.streaming.buckets import BUCKETS, by_bucket

FIRING, RESOLVED, COMMAND = "firing", "resolved", "command"
LATENESS = "10 minutes"
REMEMBER = timedelta(days=7)
UNKNOWN, EARLY, OVER, TAKEN = "no_such_alert", "too_early", "resolved", "acknowledged"

_DECISION = "alert_id string, seq long, at_micros long, user string, comment string, accepted boolean, reason string"
_ROW = ["kind", "at_micros", "seq", "user", "comment"]


def decide(remember: timedelta):
    """Judge of one alert: its span, whether it is acknowledged, and commands the watermark has not passed."""
    keep_ms = int(remember.total_seconds() * 1000)

    def run(_: tuple, rows: list[tuple], life: list | None, watermark_ms: int) -> tuple[list | None, int | None, list[tuple]]:
        started, resolved, taken, waiting = life or (None, None, False, [])
        told, watermark = [], watermark_ms * 1000
        for kind, at, *command in rows:
            if kind == FIRING:
                started = at
            elif kind == RESOLVED:
                resolved = at
            else:
                waiting.append((at, *command))
        for at, seq, user, comment in sorted((w for w in waiting if w[0] < watermark), key=lambda w: w[:2]):
            reason = UNKNOWN if started is None else EARLY if at < started else OVER if resolved is not None and at >= resolved else TAKEN if taken else None
            taken = taken or reason is None
            told.append((seq, at, user, comment, reason is None, reason))
        waiting = [w for w in waiting if w[0] >= watermark]
        # Once it is over, an alert is remembered for a while, to say why a command came to nothing.
        over = None if resolved is None else resolved // 1000 + keep_ms
        if not waiting and (started is None or over is not None and over * 1000 < watermark):
            return None, None, told
        wakes = [w[0] // 1000 for w in waiting] + ([over] if over is not None else [])
        return [started, resolved, taken, waiting], max(min(wakes), watermark_ms + 1) if wakes else None, told

    return run


def acknowledgement_decisions(
    changes: DataFrame, commands: DataFrame, lateness: str = LATENESS, remember: timedelta = REMEMBER, buckets: int = BUCKETS
) -> DataFrame:
    """(alert_id, seq, at, user, comment, accepted, reason): what becomes of each command, once the watermark has passed it.

    ``changes`` (alert_id, kind, at) has the firings and resolutions, ``commands`` (alert_id, seq, at, user, comment) the
    acknowledgements; both are streams in any order that ``lateness`` covers. The first command, by time and seq, while
    the alert is firing is accepted; all others are refused with a reason. By then whatever happened before the
    command is known, so nothing is decided twice, and a command for an alert that never fired is refused by its timer.

    * Rows behind the watermark are late and dropped, without an answer. So are rows without an alert or a time.
    * State holds commands up to the watermark only, and an alert until ``remember`` after it is over.
    """
    happened = changes.where(F.col("kind").isin(FIRING, RESOLVED)).select("alert_id", "kind", "at")
    nothing = {"seq": F.lit(0).cast("long"), "user": F.lit(None).cast("string"), "comment": F.lit(None).cast("string")}
    asked = commands.select("alert_id", F.lit(COMMAND).alias("kind"), "at", F.col("seq").cast("long").alias("seq"), "user", "comment")
    rows = happened.withColumns(nothing).unionByName(asked).where(F.col("alert_id").isNotNull() & F.col("at").isNotNull())
    timed = rows.withColumn("at_micros", F.unix_micros("at")).withWatermark("at", lateness)
    told = by_bucket(timed, ["alert_id"], _ROW, decide(remember), _DECISION, "at", buckets)
    user = F.when(F.col("accepted"), actor(F.col("user"))).otherwise(F.col("user"))
    return told.select("alert_id", "seq", F.timestamp_micros("at_micros").alias("at"), user.alias("user"), "comment", "accepted", "reason")
