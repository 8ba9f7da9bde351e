"""Session for local work, and the shared folder that multi-step jobs write to."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

CHECKPOINT_DIR = "spark.checkpoint.dir"


def local_session(cores: int | str = "*", app: str = "fleetpulse") -> SparkSession:
    """Session for tests and bench; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.files.openCostInBytes", "256k")
        .config("spark.ui.enabled", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )


# Settings the jobs rely on: hours and days are cut in UTC, and stored timestamps keep the
# minimum and maximum per row group that scans skip by, which the default INT96 does not.
JOB_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.parquet.outputTimestampType": "TIMESTAMP_MICROS",
}


def prepare(spark: SparkSession) -> None:
    for key, value in JOB_SETTINGS.items():
        if spark.conf.get(key) != value:
            spark.conf.set(key, value)


def scratch_dir(spark: SparkSession, label: str) -> str:
    """A new folder below the cluster's shared checkpoint folder.

    Only a local master may fall back to a temporary folder; elsewhere another
    executor would not see it.
    """
    context = spark.sparkContext
    root = spark.conf.get(CHECKPOINT_DIR, None) or context.getCheckpointDir()
    if not root:
        if not context.master.startswith("local"):
            raise ValueError(f"{CHECKPOINT_DIR} must name a folder shared by the cluster")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="fleetpulse-"))
        root = context.getCheckpointDir()
    return f"{root.rstrip('/')}/{label}-{uuid.uuid4().hex}"
