"""Fleet telemetry analytics as Spark jobs: ingest, rollups, health, alerts, notifications."""

__version__ = "0.1.0"
