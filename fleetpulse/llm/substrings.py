"""Substring dedup: winnowed anchors are the seeds, matches around them grow both ways."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetpulse.llm.common import join_unique, packed, stored, text_key, tokenize, unpacked

WINDOW = 50
SEED_WORDS = 16
# Odd multipliers of the two polynomial hashes; with word hashes of 64 bits they make 128 bits.
MULTIPLIERS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_U64 = np.uint64


def _powers(base: int, n: int) -> np.ndarray:
    steps = np.full(n, base, _U64)
    steps[:1] = 1
    return np.cumprod(steps, dtype=_U64)


def _mixed(x: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit hashes (the finalizer of splitmix64)."""
    x = (x ^ (x >> _U64(30))) * _U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U64(27))) * _U64(0x94D049BB133111EB)
    return x ^ (x >> _U64(31))


class SpanHash:
    """Hash of any run of words of a text in constant time, from prefix sums of a polynomial."""

    def __init__(self, ids: np.ndarray, multiplier: int):
        n = len(ids) + 1
        self.back = _powers(pow(multiplier, -1, 1 << 64), n)
        self.sums = np.concatenate([np.zeros(1, _U64), np.cumsum(ids * _powers(multiplier, n)[:-1], dtype=_U64)])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mixed((self.sums[end] - self.sums[start]) * self.back[start] + (end - start).astype(_U64))


def anchored_runs(ids: np.ndarray, window: int, seed_words: int):
    """Winnowing of one text: (anchor position, first window, last window) of every run of windows.

    Each window's anchor is the leftmost of its seeds with the least hash, so equal windows have
    their anchor at the same place whatever surrounds them.
    """
    n = len(ids) - window + 1
    if n <= 0:
        return (np.empty(0, np.int64),) * 3
    seeds = SpanHash(ids, MULTIPLIERS[0])
    at = np.arange(len(ids) - seed_words + 1)
    hashes = seeds.of(at, at + seed_words)
    width = window - seed_words + 1
    views = np.lib.stride_tricks.sliding_window_view(hashes, width)
    step = 1 << 14
    chosen = np.concatenate([views[k : k + step].argmin(axis=1) for k in range(0, n, step)]) + np.arange(n)
    first = np.flatnonzero(np.concatenate([[True], chosen[1:] != chosen[:-1]]))
    last = np.concatenate([first[1:], [n]]) - 1
    return chosen[first], first, last


def _texts(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
    """(row, word hashes) of every text of a batch."""
    tokens = tokenize(batch.column("text"), lower=False)
    ids = tokens.ids()
    for row, (a, b) in enumerate(zip(tokens.starts[:-1], tokens.starts[1:])):
        yield row, ids[a:b]


def _longs(hashes: list[np.ndarray]) -> pa.Array:
    return pa.array(np.concatenate([np.empty(0, _U64), *hashes]).view(np.int64))


def _ints(positions: list[np.ndarray]) -> pa.Array:
    return pa.array(np.concatenate([np.empty(0, np.int32), *positions]).astype(np.int32))


def _identity(batch: pa.RecordBatch, owner: list[np.ndarray]) -> list[pa.Array]:
    """The id and key columns of a batch, repeated for the rows that ``owner`` numbers."""
    at = pa.array(np.concatenate([np.empty(0, np.int64), *owner]))
    return [batch.column("id").take(at), batch.column("key").take(at)]


def _narrow(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("id"), text_key(F.col("text")).alias("key"), "text")


def seeds(docs: DataFrame, window: int = WINDOW, seed_words: int = SEED_WORDS) -> DataFrame:
    """(id, key, anchor, span, first, last): every anchor with the words its windows reach over.

    ``span`` hashes the whole stretch from the first window of the anchor to the last with
    the anchor's place in it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["id", "key", "anchor", "span", "first", "last"]
        for batch in batches:
            owner, anchors, spans, firsts, lasts = [], [], [], [], []
            for row, ids in _texts(batch):
                at, first, last = anchored_runs(ids, window, seed_words)
                if not len(at):
                    continue
                whole, inner = SpanHash(ids, MULTIPLIERS[1]), SpanHash(ids, MULTIPLIERS[0])
                owner.append(np.full(len(at), row))
                anchors.append(inner.of(at, at + seed_words))
                spans.append(_mixed(whole.of(first, last + window) + (at - first).astype(_U64)))
                firsts.append(first)
                lasts.append(last)
            columns = [*_identity(batch, owner), _longs(anchors), _longs(spans), _ints(firsts), _ints(lasts)]
            yield pa.RecordBatch.from_arrays(columns, names)

    return _narrow(docs).mapInArrow(run, "id long, key long, anchor long, span long, first int, last int")


def window_hashes(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(id, key, at, h1, h2) of the windows whose first words the column ``runs`` names, as (first, last)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            runs = batch.column("runs").to_pylist()
            owner, starts, h1, h2 = [], [], [], []
            for row, ids in _texts(batch):
                at = np.concatenate([np.arange(r["first"], r["last"] + 1) for r in runs[row]])
                owner.append(np.full(len(at), row))
                starts.append(at)
                h1.append(SpanHash(ids, MULTIPLIERS[0]).of(at, at + window))
                h2.append(SpanHash(ids, MULTIPLIERS[1]).of(at, at + window))
            columns = [*_identity(batch, owner), _ints(starts), _longs(h1), _longs(h2)]
            yield pa.RecordBatch.from_arrays(columns, ["id", "key", "at", "h1", "h2"])

    return docs.select("id", "key", "text", "runs").mapInArrow(run, "id long, key long, at int, h1 long, h2 long")


def repeats(docs: DataFrame, window: int = WINDOW, seed_words: int = SEED_WORDS) -> DataFrame:
    """(id, key, spans) of the texts with repeated windows: word ranges [start, end), merged and in order.

    1. Seeds: every 50-word window has one winnowed anchor. Equal windows of two documents share it.
    2. Extension: the windows of an anchor reach over one stretch of words to both sides.
       Where the whole stretch, as grown as can be, is in a smaller document too, all its windows are repeats.
    3. Anchors with different stretches are edges of repeats. One stretch of each kind, that of its
       smallest document, is taken apart into windows, and those found in a smaller
       document are repeats.
    4. What overlaps is merged: each range is a maximal repeat of ``window`` words or more.

    Minima are partial sums, so a passage that a third of all documents share is no large group, and
    no pairs of documents are formed. Windows are compared by 128 bits of hash.
    """
    low = F.coalesce("id", F.lit(-(1 << 63)))
    found = stored(seeds(docs, window, seed_words).withColumn("low", low), "substring-seeds")
    kinds = found.groupBy("anchor", "span").agg(F.min("low").alias("least"))
    several = F.count("*").alias("kinds")
    edges = kinds.groupBy("anchor").agg(several, F.min("least").alias("m")).where("kinds > 1").select(F.col("anchor").alias("_edge"))
    kinds_edges = kinds.join(edges, kinds["anchor"] == edges["_edge"], "left")
    kinds_edges = kinds_edges.select(F.col("anchor").alias("_a"), F.col("span").alias("_s"), "least", F.col("_edge").isNotNull().alias("edge"))
    met = found.join(kinds_edges, (F.col("anchor") == F.col("_a")) & (F.col("span") == F.col("_s")))
    met = met.where((F.col("low") > F.col("least")) | F.col("edge"))
    judged = stored(met.select("id", "key", "low", "first", "last", (F.col("low") > F.col("least")).alias("whole")), "substring-matches")
    whole = judged.where("whole").select("id", "key", F.col("first").alias("a"), (F.col("last") + window).alias("b"))
    partial = judged.where("not whole").groupBy("id", "key").agg(F.collect_set(F.struct("first", "last")).alias("runs"))
    texts = join_unique(_narrow(docs), stored(partial, "substring-edges"), ["id", "key"])
    windows = stored(window_hashes(texts, window).withColumn("low", low), "substring-windows")
    least = windows.groupBy("h1", "h2").agg(F.min("low").alias("least"), F.max("low").alias("most")).where("least < most")
    least = least.select(F.col("h1").alias("_h1"), F.col("h2").alias("_h2"), "least")
    again = windows.join(least, (F.col("h1") == F.col("_h1")) & (F.col("h2") == F.col("_h2"))).where("low > least")
    single = again.select("id", "key", F.col("at").alias("a"), (F.col("at") + window).alias("b"))
    return whole.unionByName(single).groupBy("id", "key").agg(F.collect_set(F.struct("a", "b")).alias("spans"))


def _union(spans: list[dict], n: int) -> tuple[np.ndarray, list[dict]]:
    """Which of ``n`` words the ranges cover, and the ranges with overlapping and touching ones joined."""
    depth = np.zeros(n + 1, np.int64)
    np.add.at(depth, [s["a"] for s in spans], 1)
    np.add.at(depth, [s["b"] for s in spans], -1)
    covered = np.cumsum(depth)[:n] > 0
    turns = np.flatnonzero(np.diff(np.concatenate([[False], covered, [False]]).astype(np.int8)))
    return covered, [{"start": a, "end": b} for a, b in turns.reshape(-1, 2).tolist()]


def drop_substrings(docs: DataFrame, window: int = WINDOW, seed_words: int = SEED_WORDS) -> DataFrame:
    """All rows and columns; ``text`` is the kept words joined by one space.

    ``_n_words`` and ``_n_removed`` count words, ``_spans`` lists the removed ranges [start, end)
    of words: each a maximal run of words that repeated windows cover.

    * A window repeats if its words also start somewhere in a document with a smaller doc_id.
      Repeats within one document stay. Texts under ``window`` words lose nothing.
    * NULL, empty and blank texts have no words and become ''.
    * A NULL doc_id is smaller than all others. Rows that share a doc_id are one document and lose
      nothing to each other; repeated rows lose the same words.
    * An empty table gives no rows.
    """
    found = stored(repeats(docs, window, seed_words), "substring-spans")
    own = packed(docs, id=F.col("doc_id").cast("long"), key=text_key(F.col("text")), text=F.col("text"))
    met = join_unique(own, found, ["id", "key"], "left").select("row", "text", "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens, spans = tokenize(batch.column("text"), lower=False), batch.column("spans").to_pylist()
            vocabulary = tokens.vocabulary.cast(pa.binary()).to_pylist()
            kept, sizes, removed, ranges = [], [], [], []
            for row, (a, b) in enumerate(zip(tokens.starts[:-1], tokens.starts[1:])):
                codes, joined = tokens.codes[a:b], []
                if spans[row]:
                    covered, joined = _union(spans[row], b - a)
                    codes = codes[~covered]
                kept.append(b" ".join([vocabulary[c] for c in codes.tolist()]))
                sizes.append(b - a)
                removed.append(b - a - len(codes))
                ranges.append(joined)
            columns = [
                batch.column("row"), pa.array(kept, pa.binary()), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()),
                pa.array(ranges, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["row", "kept", "n_words", "n_removed", "ranges"])

    ranges = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
    schema = T.StructType([met.schema["row"], T.StructField("kept", T.BinaryType()), *[T.StructField(n, T.LongType()) for n in ("n_words", "n_removed")], T.StructField("ranges", ranges)])
    rebuilt = met.mapInArrow(run, schema)
    counts = {"_n_words": F.col("n_words"), "_n_removed": F.col("n_removed"), "_spans": F.col("ranges")}
    return unpacked(rebuilt, docs.columns, text=F.col("kept").cast("string"), **counts)
