"""Parts the operators share: tokens, stored intermediate tables, joins on unique keys, components."""

from __future__ import annotations

import ctypes
import gc
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetpulse.operators.joins import BROADCAST_BYTES, measured_bytes
from fleetpulse.session import prepare as prepare_jobs
from fleetpulse.session import scratch_dir

# The contract's white space: space, tab, newline, vertical tab, form feed, carriage return.
BLANK = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# Rows per Arrow batch: a batch of long documents has to fit a Python worker's memory.
BATCH_ROWS = 512


def prepare(spark: SparkSession) -> None:
    prepare_jobs(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z only."""
    return F.translate(text, UPPER, LOWER)


def words(text: Column) -> Column:
    """Array of the words of a text; empty for NULL."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"({WORD})"), 1)


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; -1 for a NULL id, which is in no fold."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds, F.lit(-1))


def text_key(text: Column) -> Column:
    """With the doc_id it tells rows apart: rows that agree in both have the same result."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def packed(rows: DataFrame, **internal: Column) -> DataFrame:
    """All columns in one struct ``row``, so that no name clashes with the operator's ``internal`` columns."""
    return rows.select(F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("row"), *[v.alias(k) for k, v in internal.items()])


def unpacked(df: DataFrame, columns: list[str], **results: Column) -> DataFrame:
    """The columns back out of ``row``; a result takes the place of an input column of its name."""
    same = [results.get(c, F.col("row").getField(c)).alias(c) for c in columns]
    return df.select(*same, *[v.alias(k) for k, v in results.items() if k not in columns])


def stored(df: DataFrame, label: str) -> DataFrame:
    """The frame, written to the cluster's shared folder and read again.

    Cuts the lineage and survives lost executors; a frame that is read several times is
    computed once.
    """
    path = scratch_dir(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of finished steps now.

    It does so when the driver's memory is next tidied up, which on a driver with little to do may be
    hours away, while a job of many steps fills the disks.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def give_back() -> None:
    """Hands memory that this Python process has freed back to the machine.

    The allocators keep it for later, which a worker or driver that lives for hours holds beside the next steps' own.
    """
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc
    if trim is not None:
        trim(0)


def join_unique(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Join to a side with at most one row per key; keys match when both are NULL.

    The side is broadcast only when its measured size allows it. Beyond that it is a plain
    shuffle join: every left row meets one row, and adaptive execution splits hot keys.
    """
    side = right.select(*[F.col(c).alias(f"_k_{c}") for c in on], *[c for c in right.columns if c not in on])
    if measured_bytes(right) <= BROADCAST_BYTES:
        side = F.broadcast(side)
    condition = None
    for c in on:
        same = F.col(c).eqNullSafe(F.col(f"_k_{c}"))
        condition = same if condition is None else condition & same
    return left.join(side, condition, how).drop(*[f"_k_{c}" for c in on])


@dataclass
class Tokens:
    """Words of a batch of texts: ``codes`` index ``vocabulary``; text i has starts[i]:starts[i + 1]."""

    codes: np.ndarray
    starts: np.ndarray
    vocabulary: pa.Array

    @cached_property
    def hashes(self) -> np.ndarray:
        """A 64-bit hash per word of the vocabulary."""
        known = self.vocabulary.cast(pa.binary()).to_pylist()
        return np.fromiter(map(xxhash.xxh64_intdigest, known), np.uint64, len(known))

    def ids(self) -> np.ndarray:
        """The hash of each word occurrence."""
        return self.hashes[self.codes]


def tokenize(texts: pa.Array | pa.ChunkedArray, lower: bool) -> Tokens:
    """Splits at the contract's white space; NULL has no words. Bytes that are no UTF-8 stay as they are."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.offset:  # a slice is copied: the cast keeps its offset, which ascii_lower reads wrongly
        texts = texts.take(pa.array(np.arange(len(texts))))
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    parts = pc.ascii_split_whitespace(pc.ascii_lower(texts) if lower else texts)
    flat, bounds = parts.flatten(), np.asarray(parts.offsets)
    bounds = bounds - bounds[0]
    real = np.asarray(pc.greater(pc.binary_length(flat), 0))
    before = np.concatenate([[0], np.cumsum(real)])
    encoded = flat.filter(pa.array(real)).dictionary_encode()
    return Tokens(np.asarray(encoded.indices), before[bounds], encoded.dictionary)


def components(edges: DataFrame, label: str, limit: int = 60) -> DataFrame:
    """Connected components of undirected edges (a, b) of longs: (node, component), the smallest node.

    Alternating large and small stars: every round hangs the neighbours of a node on its
    smallest one, so the rounds grow with the logarithm of the longest chain. A round is written to
    the shared folder; only its row count and checksum reach the driver. No round gathers a node's
    neighbours: minima are partial aggregates, the join meets one row per node.
    """

    def hang(links: DataFrame, upward: bool) -> DataFrame:
        """Links (u, v) of every u; v on the upper side of u, or all on the lower, go to u's minimum."""
        least = links.groupBy("u").agg(F.min("v").alias("_m")).select(
            F.col("u").alias("_u"), F.least("u", "_m").alias("m")
        )
        met = links.join(least, links["u"] == least["_u"])
        if upward:
            return met.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        below = met.where("v < u")
        return (
            below.select(F.explode(F.array("u", "v")).alias("a"), F.col("m").alias("b"))
            .where("a <> b")
            .distinct()
        )

    pairs = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), label)
    before = None
    for _ in range(limit):
        both = pairs.select(F.explode(F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v")), F.struct(F.col("b").alias("u"), F.col("a").alias("v")))).alias("e")).select("e.*")
        large = hang(both, True)
        small = hang(large.select(F.col("a").alias("u"), F.col("b").alias("v")), False)
        pairs = stored(small, label)
        now = pairs.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            roots = pairs.select("b").distinct().select(F.col("b").alias("node"), F.col("b").alias("component"))
            return pairs.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
        before = now
    raise RuntimeError(f"{label}: no fixed point after {limit} rounds")
