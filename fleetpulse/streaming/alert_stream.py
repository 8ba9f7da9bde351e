"""Alert lifecycle over a telemetry stream.

Every micro-batch runs the batch operator on its samples, preceded per (rule, agent) by one
row that sums up all earlier ones. That state is a table written whole per batch, so a
batch that is repeated after a failure starts from the same state and writes the same
result, and a hot agent is cut into chunks as it is in a batch job.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from fleetpulse.operators import alerting as A
from fleetpulse.operators.joins import lookup
from fleetpulse.sources.tables import _filesystem, current, expire, publish

BEFORE = -(2**62)
MEMORY = [*A.PAIR, "open_first", "open_reach", "last_clock", "last_id"]
ACTIVE = ["started_at", "started_id", "started_value"]


def mark_late(evaluations: DataFrame, state: DataFrame | None) -> DataFrame:
    """Flags samples not newer than the last one their pair was judged on."""
    if state is None:
        return evaluations.withColumn("late", F.lit(False))
    seen = state.select(*A.PAIR, "last_clock", "last_id")
    newer = F.struct("clock", "id") > F.struct(F.col("last_clock").alias("clock"), F.col("last_id").alias("id"))
    return (
        lookup(evaluations, seen, A.PAIR, "left")
        .withColumn("late", F.col("last_clock").isNotNull() & ~newer)
        .drop("last_clock", "last_id")
    )


def remembered(state: DataFrame) -> DataFrame:
    """State rows in the shape of a chunk summary that lies before all chunks."""
    return state.select(
        *A.PAIR,
        F.lit(BEFORE).cast("bigint").alias("chunk"),
        F.lit(None).cast("struct<clock:timestamp,id:bigint,value:double>").alias("first_clear"),
        *[c for c in MEMORY if c not in A.PAIR],
    )


def advance(on_time: DataFrame, state: DataFrame | None, chunk_seconds: int) -> tuple[DataFrame, DataFrame]:
    """Episodes touched by a batch, and per pair what the next batch has to know.

    Touched are the episodes that start in the batch and the active ones it resolves; an active one
    that nothing happened to stays in the state and gives no row.
    """
    before = remembered(state) if state is not None else None
    started, carried = A.episodes_and_chunks(on_time, chunk_seconds, before)
    columns = [*A.PAIR, *ACTIVE, "resolved_at", "resolved_id", "resolved_value"]
    touched = started.select(*columns).withColumn("carried_over", F.lit(False))
    if state is not None:
        cleared = carried.where(F.col("chunk") == BEFORE).select(*A.PAIR, "next_clear")
        active = state.where(F.col("started_at").isNotNull()).join(cleared, A.PAIR)
        older = active.select(
            *A.PAIR,
            *ACTIVE,
            F.col("next_clear.clock").alias("resolved_at"),
            F.col("next_clear.id").alias("resolved_id"),
            F.col("next_clear.value").alias("resolved_value"),
        )
        ended = older.where(F.col("resolved_at").isNotNull())
        touched = touched.unionByName(ended.withColumn("carried_over", F.lit(True)))
    latest = F.max_by(F.struct(F.col("open_out").alias("open_first"), F.col("reach_out").alias("open_reach"), "last_clock", "last_id"), "chunk")
    memory = carried.groupBy(*A.PAIR).agg(latest.alias("m")).select(*A.PAIR, "m.*")
    return touched, memory


def next_state(touched: DataFrame, memory: DataFrame, state: DataFrame | None = None) -> DataFrame:
    """A pair has at most one unresolved episode, the one to resolve later."""
    active = touched.where(F.col("resolved_at").isNull()).select(*A.PAIR, *ACTIVE)
    if state is not None:
        ended = touched.where("carried_over").select(*A.PAIR)
        active = active.unionByName(state.where(F.col("started_at").isNotNull()).select(*A.PAIR, *ACTIVE).join(ended, A.PAIR, "left_anti"))
    return memory.join(active, A.PAIR, "left").select(*MEMORY, *ACTIVE)


def start_alerts(
    telemetry: DataFrame,
    load_rules: Callable[[], DataFrame],
    root: str,
    checkpoint: str,
    clock: str = "timestamp",
    chunk_seconds: int = A.CHUNK_SECONDS,
    **trigger,
) -> StreamingQuery:
    """Writes ``root/samples``, ``root/touched`` (both by batch) and ``root/state`` (by version).

    Samples that come late for their pair stay in ``root/samples`` under ``late=true``
    and change no alert. Rules are loaded anew for each batch.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        version = batch_id + 1
        state = current(spark, f"{root}/state", below=version)
        judged = mark_late(A.evaluate(A.metric_samples(batch, clock), load_rules()), state)
        judged.write.mode("overwrite").partitionBy("late").parquet(f"{root}/samples/batch={batch_id}")
        samples = stored(spark, f"{root}/samples/batch={batch_id}", judged)
        on_time = samples.where(~F.col("late")).select(*A.EVALUATION)
        touched, memory = advance(on_time, state, chunk_seconds)
        touched.write.mode("overwrite").parquet(f"{root}/touched/batch={batch_id}")
        written = spark.read.parquet(f"{root}/touched/batch={batch_id}")
        publish(next_state(written, memory, state), f"{root}/state", version)
        # The version before serves a batch that is repeated; older ones, and their samples in time, are done with.
        expire(spark, f"{root}/state")
        expire_samples(spark, f"{root}/samples", batch_id - 1)

    return (
        telemetry.writeStream.foreachBatch(run)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def expire_samples(spark: SparkSession, path: str, batch_id: int) -> None:
    """Remove the judged samples of an earlier batch; late ones stay."""
    fs, at = _filesystem(spark, path)
    fs.delete(at(f"{path}/batch={batch_id}/late=false"), True)


def stored(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    """Reads back a table with a given schema, which an empty one does not hold."""
    return spark.read.schema(like.schema).parquet(path)


def streamed_episodes(spark: SparkSession, root: str) -> DataFrame:
    """Episodes as they stand after the batches so far: started once, resolved at most once."""
    touched = spark.read.parquet(f"{root}/touched").drop("batch")
    end = F.struct("resolved_at", "resolved_id", "resolved_value")
    return (
        touched.groupBy(*A.PAIR, *ACTIVE)
        .agg(F.max(F.when(F.col("resolved_at").isNotNull(), end)).alias("end"))
        .select(*A.PAIR, *ACTIVE, "end.resolved_at", "end.resolved_id", "end.resolved_value")
    )
