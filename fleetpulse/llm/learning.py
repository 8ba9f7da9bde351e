"""Parts of the text classifiers: labelled samples of bounded size, hashed words, gradient steps."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetpulse.llm.common import fold

# A classifier learns from at most so many labelled documents, taken in the order of a hash of
# their ids, and from none beyond so many bytes: what reaches the driver is bounded by both.
SAMPLE_DOCUMENTS = 10_000
SAMPLE_BYTES = 16_000
FOLDS = 5
BUCKETS = 1 << 20


def labelled_sample(
    docs: DataFrame, labels: DataFrame, label: Column, folds: int = FOLDS, size: int = SAMPLE_DOCUMENTS, most_bytes: int = SAMPLE_BYTES
) -> DataFrame:
    """(text, label) of labelled documents outside the held-out fold, at most ``size`` of them.

    Rows of one doc_id in ``labels`` count as one, with the greatest label; without id or label
    they count for nothing. The ids are few enough by ``size`` to be broadcast.
    """
    known = labels.select("doc_id", label.cast("int").alias("label")).where("doc_id IS NOT NULL AND label IS NOT NULL")
    known = known.where(fold(F.col("doc_id"), folds) != 0).groupBy("doc_id").agg(F.max("label").alias("label"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(size)
    texts = docs.select("doc_id", F.col("text").cast("binary").alias("text")).where(F.octet_length("text") <= most_bytes)
    once = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text"))
    return once.orderBy("doc_id").select("label", "text")


def adam(start: np.ndarray, gradient: Callable[[np.ndarray], np.ndarray], steps: int, rate: float) -> np.ndarray:
    """Full-batch descent with Adam's step sizes; the rate falls linearly to a tenth."""
    x, first, second = start.copy(), np.zeros_like(start), np.zeros_like(start)
    for t in range(1, steps + 1):
        g = gradient(x)
        first += 0.1 * (g - first)
        second += 0.001 * (g * g - second)
        pace = rate * (1 - 0.9 * t / steps)
        x -= pace * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.999**t)) + 1e-8)
    return x


# Texts that a fit takes apart at a time: it keeps numbers of them, not words.
PART = 256


@dataclass
class Vocabulary:
    """Distinct words by their hashes, with the buckets of each word's features; -1 where it has fewer."""

    hashes: np.ndarray
    buckets: np.ndarray

    @classmethod
    def of(cls, parts: list[tuple[np.ndarray, np.ndarray]]) -> Vocabulary:
        if not parts:
            return cls(np.empty(0, np.uint64), np.empty((0, 1), np.int32))
        hashes, first = np.unique(np.concatenate([h for h, _ in parts]), return_index=True)
        return cls(hashes, np.concatenate([b for _, b in parts])[first])

    def used(self, spread: np.ndarray, least: int) -> np.ndarray:
        """Buckets of words that ``least`` documents or more have, given the documents of each word."""
        there = self.buckets >= 0
        times = np.bincount(self.buckets[there], np.broadcast_to(spread[:, None], there.shape)[there], BUCKETS)
        return np.flatnonzero(times >= least)


def pooled(values: np.ndarray, columns: np.ndarray) -> np.ndarray:
    """Sum of the features' values of each word; a column of -1 stands for none."""
    return np.append(values, 0)[columns].sum(axis=1)


def spread_back(gradient: np.ndarray, columns: np.ndarray, n: int) -> np.ndarray:
    """The gradient of ``pooled``: each feature gets that of all its words."""
    out = np.zeros(n + 1)
    for k in range(columns.shape[1]):
        out += np.bincount(np.where(columns[:, k] < 0, n, columns[:, k]), gradient, n + 1)
    return out[:-1]


def taken(sample: DataFrame) -> tuple[np.ndarray, list[bytes]]:
    """Labels and texts of a sample, on the driver."""
    rows = sample.select("label", "text").toArrow()
    labels, texts = np.asarray(rows["label"].combine_chunks()).astype(np.int64), rows["text"].to_pylist()
    del rows
    pa.default_memory_pool().release_unused()
    return labels, texts


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * z))


def softplus(z: np.ndarray) -> np.ndarray:
    return np.logaddexp(0, z)
