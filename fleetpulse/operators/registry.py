"""Agents, alert rules and notification channels: request checks, upserts, lists, lookups."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetpulse import model
from fleetpulse.functions.clock import instant
from fleetpulse.functions.text import blank, empty_to_null, stable_id, stripped

REGISTRATION_FIELDS = ["id", "name", "hostname", "os", "arch", "version"]
RULE_FIELDS = [
    "name", "metric", "operator", "threshold", "duration_seconds",
    "for_duration_seconds", "cooldown_seconds", "severity", "enabled",
]


def incomplete(c: Column) -> Column:
    return F.coalesce(c == "", F.lit(True))


def split_registrations(requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Registrations with all required fields, and the others."""
    missing = F.lit(False)
    for name in REGISTRATION_FIELDS:
        missing = missing | incomplete(F.col(name))
    return requests.where(~missing), requests.where(missing)


def upsert_agents(stored: DataFrame, registrations: DataFrame) -> DataFrame:
    """Agents after a batch of registrations (REGISTRATION_FIELDS, event_time, seq).

    The newest request per id wins, the first one sets ``created_at`` of a new agent,
    and registering puts an agent online. Repeats of one id are folded before the shuffle.
    """
    latest = F.struct(*[F.col(c) for c in REGISTRATION_FIELDS[1:]], F.col("event_time").alias("last_seen"))
    fresh = registrations.groupBy("id").agg(
        F.max_by(latest, F.struct("event_time", "seq")).alias("new"),
        F.min("event_time").alias("first_time"),
    )
    old = stored.select("id", F.struct(*[c for c in stored.columns if c != "id"]).alias("old"))

    def newest(c: str) -> Column:
        return F.coalesce(F.col(f"new.{c}"), F.col(f"old.{c}")).alias(c)

    return old.join(fresh, "id", "full").select(
        "id",
        *[newest(c) for c in REGISTRATION_FIELDS[1:]],
        F.when(F.col("new").isNotNull(), "online").otherwise(F.col("old.status")).alias("status"),
        newest("last_seen"),
        F.coalesce("old.created_at", "first_time").alias("created_at"),
    )


def oldest_first(df: DataFrame) -> DataFrame:
    """List order of agents, rules and channels."""
    return df.orderBy("created_at", "id")


def by_id(df: DataFrame, row_id: str, key: str = "id") -> DataFrame:
    return df.where(F.col(key) == row_id)


def by_ids(df: DataFrame, ids: DataFrame, key: str = "id") -> tuple[DataFrame, DataFrame]:
    """Rows of the ids asked for, and the ids that have no row; an id asked for twice counts once."""
    wanted = ids.select(F.col("id").alias(key)).where(F.col(key).isNotNull()).distinct()
    return df.join(wanted, key, "left_semi"), wanted.join(df.select(key), key, "left_anti")


def literal_rows(spark: SparkSession, rows: list[tuple], columns: list[str]) -> DataFrame:
    """A small fixed table. Through Arrow it becomes a local relation, whose size is known."""
    return spark.createDataFrame(pa.table({name: list(values) for name, values in zip(columns, zip(*rows))}))


def default_rules(spark: SparkSession, as_of) -> DataFrame:
    columns = ["id", "name", "metric", "operator", "threshold", "duration_seconds"]
    return (
        literal_rows(spark, model.DEFAULT_RULES, columns)
        .withColumns(
            {
                "duration_seconds": F.col("duration_seconds").cast("int"),
                "for_duration_seconds": F.lit(0),
                "cooldown_seconds": F.lit(0),
                "severity": F.lit(model.DEFAULT_SEVERITY),
                "enabled": F.lit(True),
                "created_at": instant(as_of),
                "updated_at": instant(as_of),
            }
        )
        .select(*model.RULE.names)
    )


def seed_rules(rules: DataFrame, as_of) -> DataFrame:
    """Rules with the defaults added; an id that exists keeps its definition."""
    defaults = default_rules(rules.sparkSession, as_of)
    return defaults.join(rules.select("id"), "id", "left_anti").unionByName(rules)


def once(df: DataFrame, key: str = "id") -> DataFrame:
    """One row per id: of several the least, by all columns in order."""
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.min(F.struct(*rest)).alias("row")).select(key, "row.*").select(df.columns)


def _with_severity(requests: DataFrame) -> DataFrame:
    return requests.withColumn("severity", F.coalesce(empty_to_null(F.col("severity")), F.lit(model.DEFAULT_SEVERITY)))


def new_rules(requests: DataFrame, as_of) -> tuple[DataFrame, DataFrame]:
    """Rules to create, and the requests refused for a blank name, metric or operator.

    Requests that lead to one id make one rule.
    """
    refused = blank(F.col("name")) | blank(F.col("metric")) | blank(F.col("operator"))
    made_id = stable_id(F.concat(F.lit("rule-"), F.col("metric")), *[F.col(c) for c in RULE_FIELDS])
    accepted = (
        _with_severity(requests.where(~refused))
        .withColumn("id", F.coalesce(empty_to_null(F.col("id")), made_id))
        .withColumn("created_at", instant(as_of))
        .withColumn("updated_at", instant(as_of))
        .select(*model.RULE.names)
    )
    return once(accepted), requests.where(refused)


def update_rules(rules: DataFrame, requests: DataFrame, as_of) -> DataFrame:
    """Rules with the fields of matching requests taken over, without checks; the last ``seq`` per id."""
    changes = _with_severity(requests).groupBy("id").agg(F.max_by(F.struct(*RULE_FIELDS), "seq").alias("new"))
    changed = F.col("new").isNotNull()

    def field(c: str) -> Column:
        return F.when(changed, F.col(f"new.{c}")).otherwise(F.col(c)).alias(c)

    return rules.join(changes, "id", "left").select(
        "id",
        *[field(c) for c in RULE_FIELDS],
        "created_at",
        F.when(changed, instant(as_of)).otherwise(F.col("updated_at")).alias("updated_at"),
    ).select(*model.RULE.names)


def normalize_channels(requests: DataFrame, as_of) -> DataFrame:
    """Channel requests trimmed and defaulted, with ``reject_reason`` for the unusable ones.

    Requests with equal name, address and type are one channel.
    """
    url = stripped(F.col("url"))
    scheme = F.lower(F.try_parse_url(url, F.lit("PROTOCOL")))
    kind = F.coalesce(empty_to_null(stripped(F.col("type"))), F.lit("webhook"))
    no_address = F.coalesce(scheme == "", F.lit(True)) | F.coalesce(F.try_parse_url(url, F.lit("HOST")) == "", F.lit(True))
    reason = (
        F.when(blank(F.col("name")), "missing_name")
        .when(blank(F.col("url")), "missing_url")
        .when(no_address, "bad_url")
        .when(~scheme.isin("http", "https"), "bad_scheme")
        .when(~kind.isin(*model.CHANNEL_TYPES), "bad_type")
    )
    channels = requests.select(
        stable_id("chan", F.col("name"), F.col("url"), F.col("type")).alias("id"),
        stripped(F.col("name")).alias("name"),
        kind.alias("type"),
        F.concat(scheme, F.substr(url, F.length(scheme) + 1)).alias("url"),
        F.coalesce(stripped(F.col("secret")), F.lit("")).alias("secret"),
        F.coalesce("enabled", F.lit(True)).alias("enabled"),
        instant(as_of).alias("created_at"),
        instant(as_of).alias("updated_at"),
        reason.alias("reject_reason"),
    )
    return once(channels)
