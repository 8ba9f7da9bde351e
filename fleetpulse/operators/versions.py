"""Rules that change over time: every sample is judged by the version that held when it was taken."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fleetpulse.functions.conditions import compare
from fleetpulse.operators.alerting import EVALUATION
from fleetpulse.operators.joins import is_small

# Versions are listed by the days they hold on, so that a sample meets those of its day only.
SLICE_SECONDS = 86_400
JUDGED_BY = ["rule_id", "metric", "operator", "threshold", "hold_seconds"]


def rule_versions(rules: DataFrame, removed: DataFrame | None = None) -> DataFrame:
    """Rule rows as versions, each from its ``updated_at`` until the rule's next one.

    ``rules`` has a row per version. Of several with one id and time the greatest row holds. ``removed`` (id, at) ends
    a rule; one that is stored again later holds again. A version that is not enabled is a gap: nothing is judged
    in it, and a run of breaches goes on after it, as the state of a rule that is switched off stays.
    """
    body = [c for c in rules.columns if c not in ("id", "updated_at")]
    whole = F.max(F.struct(F.lit(True).alias("stored"), *body)).alias("rule")
    versions = rules.groupBy("id", "updated_at").agg(whole)
    if removed is not None:
        gone = rules.select("id", "updated_at", F.struct(F.lit(False).alias("stored"), *body).alias("rule")).limit(0)
        ends = removed.select("id", F.col("at").alias("updated_at")).distinct()
        versions = versions.unionByName(gone.unionByName(ends, allowMissingColumns=True))
        versions = versions.groupBy("id", "updated_at").agg(F.max("rule").alias("rule"))
    in_time = Window.partitionBy("id").orderBy("updated_at")
    return (
        versions.where(F.col("id").isNotNull() & F.col("updated_at").isNotNull())
        .withColumn("valid_to", F.lead("updated_at").over(in_time))
        .where("rule.stored")
        .select("id", F.col("updated_at").alias("valid_from"), "valid_to", *[F.col("rule").getField(c).alias(c) for c in body])
    )


def as_of(rows: DataFrame, versions: DataFrame, on: list[str], at: str, slice_seconds: int = SLICE_SECONDS, small: bool | None = None) -> DataFrame:
    """Each row with the versions (``valid_from`` <= at < ``valid_to``, NULL for no end) of its key, inner.

    Versions are listed once per slice of time they hold in, between the first and the last row,
    so this is an equality join on key and slice: no history is ranked or sorted, and a row meets what
    held on its day. The list is broadcast if it is measured small; else both sides are shuffled
    and adaptive execution splits hot slices. Rows without a time or before the first version have no partner.
    """
    slice_of = lambda c: F.floor(F.unix_seconds(c) / slice_seconds).cast("bigint")
    span = rows.agg(slice_of(F.min(at)).alias("low"), slice_of(F.max(at)).alias("high")).first()
    if span["low"] is None:
        return rows.withColumn("_slice", F.lit(None).cast("bigint")).join(versions.withColumn("_slice", F.lit(None).cast("bigint")), [*on, "_slice"]).drop("_slice")
    low = F.greatest(slice_of(F.col("valid_from")), F.lit(span["low"]))
    high = F.least(F.coalesce(slice_of(F.col("valid_to")), F.lit(span["high"])), F.lit(span["high"]))
    listed = versions.where(low <= high).withColumn("_slice", F.explode(F.sequence(low, high)))
    if is_small(listed) if small is None else small:
        listed = F.broadcast(listed)
    held = (F.col(at) >= F.col("valid_from")) & (F.col("valid_to").isNull() | (F.col(at) < F.col("valid_to")))
    return rows.withColumn("_slice", slice_of(F.col(at))).join(listed, [*on, "_slice"]).where(held).drop("_slice", "valid_from", "valid_to")


def evaluate_versions(samples: DataFrame, versions: DataFrame, slice_seconds: int = SLICE_SECONDS) -> DataFrame:
    """``alerting.evaluate`` with the version of each rule that held at the sample's time."""
    judged_by = versions.where("enabled").select(
        F.col("id").alias("rule_id"), "metric", "operator", "threshold", F.col("for_duration_seconds").alias("hold_seconds"), "valid_from", "valid_to"
    )
    breaching = compare(F.col("value"), F.col("operator"), F.col("threshold"))
    return as_of(samples, judged_by, ["metric"], "clock", slice_seconds).withColumn("breaching", breaching).select(*EVALUATION)


def named_at_start(episodes: DataFrame, versions: DataFrame, slice_seconds: int = SLICE_SECONDS) -> DataFrame:
    """Episodes with the name, severity, operator and threshold that the rule had when they began."""
    told = versions.select(F.col("id").alias("rule_id"), F.col("name").alias("rule_name"), "severity", "operator", "threshold", "valid_from", "valid_to")
    return as_of(episodes, told, ["rule_id"], "started_at", slice_seconds)
