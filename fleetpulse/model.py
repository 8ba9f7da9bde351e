"""Table schemas and the fixed values of the data model."""

from __future__ import annotations

from pyspark.sql import types as T

TELEMETRY = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("agent_id", T.StringType()),
        T.StructField("timestamp", T.TimestampType()),
        T.StructField("metrics", T.VariantType()),
        T.StructField("created_at", T.TimestampType()),
    ]
)

AGENT = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField("hostname", T.StringType()),
        T.StructField("os", T.StringType()),
        T.StructField("arch", T.StringType()),
        T.StructField("version", T.StringType()),
        T.StructField("status", T.StringType()),
        T.StructField("last_seen", T.TimestampType()),
        T.StructField("created_at", T.TimestampType()),
    ]
)

RULE = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField("metric", T.StringType()),
        T.StructField("operator", T.StringType()),
        T.StructField("threshold", T.DoubleType()),
        T.StructField("duration_seconds", T.IntegerType()),
        T.StructField("for_duration_seconds", T.IntegerType()),
        T.StructField("cooldown_seconds", T.IntegerType()),
        T.StructField("severity", T.StringType()),
        T.StructField("enabled", T.BooleanType()),
        T.StructField("created_at", T.TimestampType()),
        T.StructField("updated_at", T.TimestampType()),
    ]
)

CHANNEL = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField("type", T.StringType()),
        T.StructField("url", T.StringType()),
        T.StructField("secret", T.StringType()),
        T.StructField("enabled", T.BooleanType()),
        T.StructField("created_at", T.TimestampType()),
        T.StructField("updated_at", T.TimestampType()),
    ]
)

# JSON paths of the metrics contract.
CPU_PATH = "$.system.cpu.usage_percent"
MEMORY_PATH = "$.system.memory.used_percent"
DISK_PATH = "$.system.disk.used_percent"
PARTITIONS_PATH = "$.system.disk.partitions"
INTERFACES_PATH = "$.system.network.interfaces"
PROCESSES_PATH = "$.system.processes.running_count"

# Rule metric names and the path each one reads.
RULE_METRICS = {
    "cpu_usage": CPU_PATH,
    "memory_usage": MEMORY_PATH,
    "disk_usage": DISK_PATH,
}
OFFLINE_METRIC = "agent_offline"

# The default rules (id, name, metric, operator, threshold, duration_seconds).
DEFAULT_RULES = [
    ("rule-cpu-high", "High CPU Usage", "cpu_usage", ">", 80.0, 300),
    ("rule-mem-high", "High Memory Usage", "memory_usage", ">", 85.0, 300),
    ("rule-disk-high", "High Disk Usage", "disk_usage", ">", 90.0, 0),
    ("rule-agent-offline", "Agent Offline", "agent_offline", "==", 1.0, 0),
]

# Defaults and limits.
DEFAULT_SEVERITY = "warning"
DEFAULT_ACTOR = "operator"
HEALTHY_SECONDS = 30
STALE_SECONDS = 120
RETENTION_DAYS = 30
HISTORY_DEFAULT = 50
HISTORY_MAX = 500
SERIES_POINTS = 500
MAX_ATTEMPTS = 3
CHANNEL_TYPES = ["webhook", "slack_webhook"]
TIME_RANGES = {"15m": 900, "1h": 3600, "6h": 21600, "24h": 86400, "7d": 604800}

# Event type names of the change log.
TELEMETRY_UPDATED = "telemetry.updated"
AGENT_REGISTERED = "agent.registered"
ALERT_FIRING = "alert.firing"
ALERT_ACKNOWLEDGED = "alert.acknowledged"
ALERT_RESOLVED = "alert.resolved"
ALERT_COMMENT_ADDED = "alert.comment_added"
