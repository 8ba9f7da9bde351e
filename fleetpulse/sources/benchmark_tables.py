"""The given Parquet tables seen as fleet data: events are snapshots, customers are agents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetpulse import model
from fleetpulse.functions.clock import instant
from fleetpulse.operators.registry import literal_rows

AS_OF = "2024-01-31T00:30:00"
DENSE_AGENTS = 5

EVENTS = T.StructType(
    [
        T.StructField("event_id", T.LongType()),
        T.StructField("ts", T.TimestampNTZType()),
        T.StructField("user_id", T.LongType()),
        T.StructField("event_type", T.StringType()),
        T.StructField("value", T.DoubleType()),
        T.StructField("props", T.StringType()),
    ]
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def as_utc(c: Column) -> Column:
    return c.cast("timestamp")


def metrics_text(event_id: Column, value: Column, props: Column) -> Column:
    """Metrics JSON of an event; every 50 events hold one of each malformed kind."""
    kind = event_id % 50
    number = F.least(value, F.lit(100.0)).cast("string")
    cpu = (
        F.when(kind == 0, '{"usage_percent":null}')
        .when(kind == 1, '{"usage_percent":"12.5"}')
        .when(kind == 2, '{"usage_percent":"abc"}')
        .when(kind == 3, "{}")
        .when(kind == 4, '{"usage_percent":true}')
        .otherwise(F.concat(F.lit('{"usage_percent":'), number, F.lit("}")))
    )
    interfaces = F.when(kind == 5, "{}").otherwise(
        F.concat(
            F.lit('[{"name":"eth0","bytes_recv":'), (event_id * 10).cast("string"),
            F.lit(',"bytes_sent":'), event_id.cast("string"),
            F.lit('},{"name":"lo","bytes_recv":3}]'),
        )
    )
    return F.concat(
        F.lit('{"system":{"cpu":'), cpu,
        F.lit(',"memory":{"used_percent":'), F.get_json_object(props, "$.k"),
        F.lit('},"disk":{"used_percent":'), (event_id % 90).cast("string"),
        F.lit(',"partitions":[{"mountpoint":"/boot","used_percent":1},{"mountpoint":"/","used_percent":'),
        (event_id % 100).cast("string"),
        F.lit('}]},"network":{"interfaces":'), interfaces,
        F.lit('},"processes":{"running_count":'), (event_id % 300).cast("string"), F.lit("}}}"),
    )


def events_as_telemetry(events: DataFrame, dense: bool = False) -> DataFrame:
    """Telemetry rows of an events frame, batch or streaming."""
    agent = F.col("user_id") % DENSE_AGENTS if dense else F.col("user_id")
    return events.select(
        F.col("event_id").alias("id"),
        F.concat(F.lit("agent-"), agent.cast("string")).alias("agent_id"),
        as_utc(F.col("ts")).alias("timestamp"),
        F.try_parse_json(metrics_text(F.col("event_id"), F.col("value"), F.col("props"))).alias("metrics"),
        as_utc(F.col("ts")).alias("created_at"),
    )


def telemetry(spark: SparkSession, sf_dir: str, dense: bool = False) -> DataFrame:
    return events_as_telemetry(table(spark, sf_dir, "events"), dense)


def agents(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    nation = F.col("c_nationkey")
    created = F.timestamp_add("MINUTE", key.cast("int"), instant("2023-12-01T00:00:00"))
    return table(spark, sf_dir, "customer").select(
        F.concat(F.lit("agent-"), key.cast("string")).alias("id"),
        F.col("c_name").alias("name"),
        F.concat(F.lit("host-"), key.cast("string")).alias("hostname"),
        F.when(nation % 3 == 0, "linux").when(nation % 3 == 1, "darwin").otherwise("windows").alias("os"),
        F.when(nation % 2 == 0, "amd64").otherwise("arm64").alias("arch"),
        F.concat(F.lit("1."), nation.cast("string"), F.lit(".0")).alias("version"),
        F.lit("online").alias("status"),
        created.alias("last_seen"),
        created.alias("created_at"),
    )


RULE_COLUMNS = [
    "id", "name", "metric", "operator", "threshold",
    "duration_seconds", "for_duration_seconds", "severity", "enabled",
]


def rules(spark: SparkSession, sustained_seconds: int = 21600) -> DataFrame:
    """The default rules plus one with a hold time and one that is switched off."""
    at = F.lit("2023-12-01T00:00:00Z").cast("timestamp")
    extra = [
        ("rule-cpu-sustained", "Sustained CPU", "cpu_usage", ">", 20.0, 0, sustained_seconds, "critical", True),
        ("rule-disk-muted", "Muted Disk", "disk_usage", ">=", 1.0, 0, 0, "info", False),
    ]
    rows = [(*r, 0, model.DEFAULT_SEVERITY, True) for r in model.DEFAULT_RULES] + extra
    return (
        literal_rows(spark, rows, RULE_COLUMNS)
        .withColumn("duration_seconds", F.col("duration_seconds").cast("int"))
        .withColumn("for_duration_seconds", F.col("for_duration_seconds").cast("int"))
        .withColumn("cooldown_seconds", F.lit(0))
        .withColumn("created_at", at)
        .withColumn("updated_at", at)
        .select(*model.RULE.names)
    )


def comparator_rules(spark: SparkSession) -> DataFrame:
    """A disk rule for every comparator, and for one that there is not."""
    operators = [">", ">=", "<", "<=", "==", "!="]
    rows = [(f"rule-{o}", "Disk", "disk_usage", o, 45.0, 0, 0, "info", True) for o in operators]
    return literal_rows(spark, rows, RULE_COLUMNS)


def channels(spark: SparkSession) -> DataFrame:
    at = F.lit("2023-12-01T00:00:00Z").cast("timestamp")
    rows = [
        ("chan-signed", "Signed hook", "webhook", "https://hooks.example.com/a", "super-secret-key", True),
        ("chan-plain", "Plain hook", "webhook", "https://hooks.example.com/b", "", True),
        ("chan-chat", "Chat room", "slack_webhook", "https://chat.example.com/c", "", True),
        ("chan-muted", "Muted hook", "webhook", "https://hooks.example.com/d", "", False),
    ]
    return (
        literal_rows(spark, rows, ["id", "name", "type", "url", "secret", "enabled"])
        .withColumn("created_at", at)
        .withColumn("updated_at", at)
        .select(*model.CHANNEL.names)
    )
