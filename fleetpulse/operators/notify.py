"""Notification ledger: plan deliveries, build requests, attempt, fold attempts, retry."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetpulse import model
from fleetpulse.functions.clock import instant
from fleetpulse.functions.documents import TIME_FIELDS
from fleetpulse.functions.text import hmac_pads, rfc3339_text, signature, stable_id
from fleetpulse.operators.joins import fan_out
from fleetpulse.sources.tables import materialized

# The mark each event type is shown with in chat.
EVENT_EMOJI = {
    model.ALERT_FIRING: "🚨",
    model.ALERT_RESOLVED: "✅",
    model.ALERT_ACKNOWLEDGED: "👀",
}
CHAT_TYPE = "slack_webhook"


def alert_events(alerts: DataFrame) -> DataFrame:
    """One row per firing and per resolution, with the alert as it was then."""
    firing = F.struct(
        F.lit(model.ALERT_FIRING).alias("event_type"),
        F.col("started_at").alias("at"),
        F.lit("firing").alias("status"),
        F.col("started_value").alias("last_value"),
        F.lit(None).cast("timestamp").alias("resolved_at"),
        F.col("started_at").alias("updated_at"),
    )
    resolved = F.struct(
        F.lit(model.ALERT_RESOLVED).alias("event_type"),
        F.col("resolved_at").alias("at"),
        F.lit("resolved").alias("status"),
        "last_value",
        "resolved_at",
        F.col("resolved_at").alias("updated_at"),
    )
    both = F.array_compact(F.array(firing, F.when(F.col("resolved_at").isNotNull(), resolved)))
    return alerts.withColumn("_event", F.explode(both)).select(
        F.col("id").alias("alert_id"), "rule_id", "agent_id", "rule_name", "severity", "started_at", "message", "created_at", "_event.*"
    )


ALERT_PARTS = [
    "rule_id", "agent_id", "rule_name", "severity", "status", "started_at", "resolved_at", "last_value", "message",
    "created_at", "updated_at",
]


def enabled_channels(channels: DataFrame) -> DataFrame:
    """Channels to notify, the signing blocks of each secret prepared once."""
    pads = F.when(F.col("secret") != "", hmac_pads(F.col("secret")))
    return channels.where("enabled").select("id", "type", "url", pads.alias("pads"))


def plan_deliveries(events: DataFrame, channels: DataFrame) -> DataFrame:
    """A pending delivery for each event and enabled channel."""
    return fan_out(events, enabled_channels(channels), "channel").select(
        stable_id("del", F.col("alert_id"), F.col("event_type"), F.col("channel.id")).alias("id"),
        stable_id("notif", F.col("alert_id"), F.col("event_type")).alias("notification_id"),
        F.col("channel.id").alias("channel_id"),
        "alert_id",
        "event_type",
        F.lit("pending").alias("status"),
        F.lit(0).alias("attempts"),
        F.lit(0).alias("response_status"),
        F.lit("").alias("error_message"),
        F.col("at").alias("created_at"),
        F.lit(None).cast("timestamp").alias("sent_at"),
        "channel",
        F.struct(*ALERT_PARTS).alias("alert"),
    )


def notification_body() -> Column:
    part = lambda name: F.col(f"alert.{name}")
    shown = [(rfc3339_text(part(n)) if n in TIME_FIELDS else part(n)).alias(n) for n in ALERT_PARTS]
    alert = F.struct(F.col("alert_id").alias("id"), *shown)
    return F.to_json(
        F.struct(
            F.col("notification_id").alias("id"),
            F.col("event_type").alias("event"),
            rfc3339_text(F.col("created_at")).alias("timestamp"),
            alert.alias("alert"),
        )
    )


def chat_text() -> Column:
    emoji = F.lit(EVENT_EMOJI[model.ALERT_FIRING])
    for event, mark in EVENT_EMOJI.items():
        emoji = F.when(F.col("event_type") == event, mark).otherwise(emoji)
    seconds = F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return F.concat(
        emoji, F.lit(" *Notification: "), F.col("event_type"), F.lit("*\nEvent: `"),
        F.col("event_type"), F.lit("` | Time: `"), seconds, F.lit("`"),
    )


def build_requests(planned: DataFrame) -> DataFrame:
    """Outgoing request of each delivery: chat text or signed notification, by channel type."""
    chat = F.col("channel.type") == CHAT_TYPE
    return (
        planned.withColumn("body", F.when(chat, F.to_json(F.struct(chat_text().alias("text")))).otherwise(notification_body()))
        .withColumn("signature", F.when(~chat, signature(F.col("body"), F.col("channel.pads"))))
        .select(
            F.col("id").alias("delivery_id"), "channel_id", "alert_id", "event_type", "attempts",
            F.col("channel.type").alias("channel_type"), F.col("channel.url").alias("url"), "body", "signature",
        )
    )


Sender = Callable[[str, str, str | None, str], int]


REQUEST = ["channel_type", "url", "body", "signature"]


def attempt(requests: DataFrame, sender: Sender, at, keep_below: int = 0) -> DataFrame:
    """Attempt rows of calling ``sender(url, body, signature, delivery_id) -> status``, sent and stored.

    The calls are made once, here: what is returned is the stored table, which later actions only
    read. A lost executor repeats its calls, and the delivery id lets the receiver tell. An attempt that failed
    and has a number less than ``keep_below`` keeps its request in the table, for the next one.
    """
    names = ["delivery_id", "attempt", "response_status", "error_message", *(REQUEST if keep_below else [])]

    def call(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            results = []
            for row in batch.itertuples(index=False):
                try:
                    status = int(sender(row.url, row.body, row.signature, row.delivery_id))
                    error = "" if 200 <= status <= 299 else failure(status, row.channel_type)
                except Exception as problem:
                    status, error = 0, str(problem)
                again = not 200 <= status <= 299 and row.attempts + 1 < keep_below
                request = [getattr(row, c) if again else None for c in names[4:]]
                results.append((row.delivery_id, row.attempts + 1, status, error, *request))
            yield pd.DataFrame(results, columns=names)

    kinds = ["string", "int", "int", "string", *["string"] * len(REQUEST)]
    sent = requests.select("delivery_id", "attempts", *REQUEST).mapInPandas(call, ", ".join(f"{n} {k}" for n, k in zip(names, kinds)))
    return materialized(sent.withColumn("at", instant(at)), "attempts")


def deliver(planned: DataFrame, sender: Sender, times: list, max_attempts: int = model.MAX_ATTEMPTS) -> tuple[DataFrame, DataFrame]:
    """Deliveries and all attempts after a round of sending at each of ``times``.

    A round sends what is pending and due by then. Requests are built once. A request that has to be sent again is stored
    with the attempt that failed, so a round reads what waits and nothing is shuffled to find it. In the end only
    attempts that none followed are folded.
    """
    most = max_attempts if max_attempts > 0 else model.MAX_ATTEMPTS
    deliveries = materialized(planned, "deliveries")
    rounds, ends, waiting = [], [], None
    again = F.timestamp_add("SECOND", F.col("attempt") * F.col("attempt"), "at")
    for n, at in enumerate(times, 1):
        if waiting is None:
            asked = build_requests(deliveries).where(F.col("delivery_id").isNotNull())
        else:
            ready = again <= instant(at)
            asked, waiting = waiting.where(ready).withColumnRenamed("attempt", "attempts"), waiting.where(~ready)
        sent = attempt(asked, sender, at, most if n < len(times) else 0)
        rounds.append(sent.drop(*REQUEST))
        if n < len(times):
            pending = ~succeeded(F.col("response_status")) & (F.col("attempt") < most)
            failed = sent.where(pending).select("delivery_id", "attempt", *REQUEST, "at")
            waiting = failed if waiting is None else waiting.unionByName(failed)
            followed = reduce(Column.__or__, [again <= instant(later) for later in times[n:]])
            ends.append(rounds[-1].where(~(pending & followed)))
        else:
            ends.append(rounds[-1])
    union = lambda frames: reduce(DataFrame.unionByName, frames)
    return fold_attempts(deliveries, union(ends), max_attempts), union(rounds)


def succeeded(status: Column) -> Column:
    return status.between(200, 299)


# How a refused attempt is told.
CHAT_SENDER, HOOK_SENDER, REFUSED = "slack webhook", "webhook", " responded with HTTP "


def failure(status: int, channel_type: str) -> str:
    return f"{CHAT_SENDER if channel_type == CHAT_TYPE else HOOK_SENDER}{REFUSED}{status}"


def failure_text(status: Column, channel_type: Column) -> Column:
    """``failure`` as a column."""
    sender = F.when(channel_type == CHAT_TYPE, CHAT_SENDER).otherwise(HOOK_SENDER)
    return F.concat(sender, F.lit(REFUSED), status.cast("string"))


def fold_attempts(deliveries: DataFrame, attempts: DataFrame, max_attempts: int = model.MAX_ATTEMPTS) -> DataFrame:
    """Deliveries with the state their attempts led to, and when the next one is due.

    The first success decides; without one the last attempt does. Attempts are folded
    before the shuffle, so a delivery with many repeats stays one row per task.
    """
    row = F.struct("attempt", "response_status", "error_message", "at")
    folded = attempts.groupBy(F.col("delivery_id").alias("id")).agg(
        F.min(F.when(succeeded(F.col("response_status")), row)).alias("success"),
        F.max(row).alias("last"),
    )
    won, last = F.col("success").isNotNull(), F.col("last")
    final = F.coalesce("success", "last")
    spent = F.col("_final.attempt") >= (max_attempts if max_attempts > 0 else model.MAX_ATTEMPTS)
    status = F.when(won, "delivered").when(spent, "failed").otherwise("pending")
    wait = F.col("attempts") * F.col("attempts")
    return (
        deliveries.drop("status", "attempts", "response_status", "error_message", "sent_at")
        .join(folded, "id", "left")
        .withColumn("_final", final)
        .withColumns(
            {
                "status": status,
                "attempts": F.coalesce("_final.attempt", F.lit(0)),
                "response_status": F.coalesce("_final.response_status", F.lit(0)),
                "error_message": F.when(won | last.isNull(), "").otherwise(F.col("_final.error_message")),
                "sent_at": F.when(won, F.col("_final.at")),
            }
        )
        .withColumn(
            "next_attempt_at",
            F.when(
                F.col("status") == "pending",
                F.timestamp_add("SECOND", wait, F.coalesce("_final.at", "created_at")),
            ),
        )
        .drop("success", "last", "_final")
    )


def due(deliveries: DataFrame, now) -> DataFrame:
    return deliveries.where((F.col("status") == "pending") & (F.col("next_attempt_at") <= instant(now)))


def list_deliveries(deliveries: DataFrame, limit: int = model.HISTORY_DEFAULT) -> DataFrame:
    n = limit if limit > 0 else model.HISTORY_DEFAULT
    return deliveries.orderBy(F.desc("created_at"), "id").limit(n)
