"""The change log as a stream: several sources, one log, each micro-batch written once under its number."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from fleetpulse.functions.clock import instant
from fleetpulse.session import prepare

BATCH = "batch="


def merged(changes: list[DataFrame]) -> DataFrame:
    """Streams of ``eventlog.change`` rows as one stream; each source keeps its own place in the checkpoint."""
    return reduce(DataFrame.unionByName, changes)


def write_batch(log: DataFrame, root: str, batch_id: int, as_of=None) -> None:
    """One micro-batch as ``root/batch=N``; a batch that comes again replaces what it wrote.

    Rows are in order of type within a file, so a reader of one kind skips most row groups of the others. A
    change without a time of its own happened at ``as_of``; without that it has none, since a clock would
    tell a repeated batch from the first.
    """
    prepare(log.sparkSession)
    if as_of is not None:
        log = log.withColumn("timestamp", F.coalesce("timestamp", instant(as_of)))
    log.sortWithinPartitions("type", "timestamp").write.mode("overwrite").parquet(f"{root}/{BATCH}{batch_id}")


def start_log(changes: list[DataFrame], root: str, checkpoint: str, as_of=None, **trigger) -> StreamingQuery:
    """Appends the changes of all sources to ``root``, in batches that hold some of each.

    Nothing is kept between batches: a change is a row in, a row out. The batch number is the key
    of what is written, so a batch that failed half way and one that was written but not yet
    committed both end as one copy.
    """
    return (
        merged(changes).writeStream.foreachBatch(lambda batch, batch_id: write_batch(batch, root, batch_id, as_of))
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def read_log(spark: SparkSession, root: str, like: DataFrame) -> DataFrame:
    """The log so far, with the schema of ``like``: also batches without rows."""
    return spark.read.schema(like.schema).parquet(f"{root}/{BATCH}*")


def since(spark: SparkSession, root: str, like: DataFrame, batch_id: int) -> DataFrame:
    """What came after a batch, with its ``batch`` number: a subscriber that was away goes on from the last one it saw."""
    log = spark.read.schema(like.schema.add("batch", "long")).option("basePath", root).parquet(root)
    return log.where(F.col("batch") > batch_id)
