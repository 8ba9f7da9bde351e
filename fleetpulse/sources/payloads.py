"""Telemetry payloads as text: one JSON document per row, from files or a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetpulse.functions.text import blank, rfc3339

# The payload fields, and the timestamp that stands for "not set".
FIELDS = ["agent_id", "timestamp", "metrics"]
ZERO_TIME = "0001-01-01T00:00:00Z"


def read_payloads(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines, kept as text so that a bad line is judged and not lost."""
    return spark.read.text(path).withColumnRenamed("value", "payload")


def stream_payloads(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    reader = spark.readStream.format("text")
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.load(path).withColumnRenamed("value", "payload")


MEMBERS = "map<string,variant>"


def decode(payloads: DataFrame, target: str | None = None) -> DataFrame:
    """Payload fields plus ``reject_reason``, the first check a payload fails or NULL.

    A payload is decoded as a whole before its fields are looked at. ``target`` names
    the column with the agent the payload was sent for, when there is one. Objects are
    recognised by their members; naming a whole document's type would walk all of it.
    """
    members = (
        payloads.withColumn("_body", F.try_parse_json("payload"))
        .withColumn("_members", F.try_variant_get("_body", "$", MEMBERS))
        .withColumns({f"_{name}": F.col("_members")[name] for name in FIELDS})
    )
    is_text = lambda c: F.schema_of_variant(c) == "STRING"
    present = lambda c: c.isNotNull() & ~F.is_variant_null(c)
    agent, time, metrics = (F.col(f"_{name}") for name in FIELDS)
    typed = members.select(
        *payloads.columns,
        "_body",
        F.col("_members").isNotNull().alias("_is_object"),
        (F.size(F.array_except(F.map_keys("_members"), F.array(*map(F.lit, FIELDS)))) > 0).alias("_extra"),
        present(agent).alias("_has_agent"),
        F.when(is_text(agent), F.try_variant_get(agent, "$", "string")).alias("agent_id"),
        present(time).alias("_has_time"),
        F.when(is_text(time), F.try_variant_get(time, "$", "string")).alias("_time_text"),
        present(metrics).alias("_has_metrics"),
        F.try_variant_get(metrics, "$", MEMBERS).isNotNull().alias("_metrics_object"),
        metrics.alias("metrics"),
    ).withColumn("timestamp", rfc3339(F.col("_time_text")))

    yes = lambda name: F.coalesce(F.col(name), F.lit(False))
    unset = F.col("timestamp").isNull() | (F.col("timestamp") == F.lit(ZERO_TIME).cast("timestamp"))
    reason = (
        F.when(F.col("_body").isNull(), "malformed_json")
        .when(~F.col("_is_object") & ~F.is_variant_null("_body"), "not_an_object")
        .when(yes("_extra"), "unknown_field")
        .when(yes("_has_agent") & F.col("agent_id").isNull(), "bad_agent_id")
        .when(yes("_has_time") & F.col("timestamp").isNull(), "bad_timestamp")
        .when(yes("_has_metrics") & ~F.col("_metrics_object"), "bad_metrics")
        .when(blank(F.col("agent_id")), "missing_agent_id")
        .when(unset, "missing_timestamp")
        .when(~yes("_has_metrics"), "missing_metrics")
    )
    if target:
        reason = reason.when(F.col("agent_id") != F.col(target), "agent_mismatch")
    return typed.withColumn("reject_reason", reason).select(
        *payloads.columns, "agent_id", "timestamp", "reject_reason", "metrics"
    )
