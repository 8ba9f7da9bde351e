"""SimHash near-duplicates: pigeonhole blocks, a join on blocks, Hamming distance verified."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetpulse.llm.common import components, join_unique, packed, stored, text_key, unpacked

# Fixed values of the fingerprint.
SEED = 42
BITS = 64
SHINGLE_WORDS = 3
MAX_DISTANCE = 2

BLOCKS = 5
# A bucket with more fingerprints than this is linked by common neighbours instead of pairs.
PAIRED_BUCKET = 32
_CHUNK = 65_536


def fingerprint(text: bytes | None, shingle_words: int = SHINGLE_WORDS) -> int:
    """Majority of the bits of all shingle hashes of one text; 0 without words."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    n = max(1, len(words) - shingle_words + 1)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate([[0], ends[:-1]])
    joined, last = memoryview(b" ".join(words)), ends[min(shingle_words, len(words)) - 1 :] - 1
    ones = np.zeros(BITS, np.int64)
    for k in range(0, n, _CHUNK):
        spans = zip(starts[k : min(n, k + _CHUNK)].tolist(), last[k : k + _CHUNK].tolist())
        hashes = np.fromiter((xxhash.xxh64_intdigest(joined[a:b], SEED) for a, b in spans), np.uint64)
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def with_fingerprint(docs: DataFrame, shingle_words: int = SHINGLE_WORDS) -> DataFrame:
    """(doc_id, key, fp) of every row; ``fp`` is the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = [fingerprint(t, shingle_words) for t in batch.column("text").to_pylist()]
            fps = np.array(prints, np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(fps)], ["doc_id", "key", "fp"])

    narrow = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), text_key(F.col("text")).alias("key"), F.col("text").cast("binary").alias("text")
    )
    return narrow.mapInArrow(run, "doc_id long, key long, fp long")


def block_masks(max_distance: int, blocks: int) -> list[int]:
    """Masks of every choice of ``blocks - max_distance`` blocks: close fingerprints agree under one."""
    if not 0 <= max_distance < blocks <= BITS:
        raise ValueError("0 <= max_distance < blocks <= 64")
    cuts = [round(i * BITS / blocks) for i in range(blocks + 1)]
    parts = [(1 << b) - (1 << a) for a, b in zip(cuts, cuts[1:])]
    return [sum(chosen) for chosen in combinations(parts, blocks - max_distance)]


def _signed(value: int) -> int:
    return value - (1 << BITS) if value >> (BITS - 1) else value


def links(prints: DataFrame, max_distance: int = MAX_DISTANCE, blocks: int = BLOCKS, paired: int = PAIRED_BUCKET) -> DataFrame:
    """Edges (a, b) that connect distinct fingerprints ``fp`` as all pairs within the distance do.

    Every choice of blocks makes one bucket key. Buckets of at most ``paired`` fingerprints are
    joined with themselves and each pair's distance is verified. Larger ones, made by groups
    of near copies, would give all pairs of a group; with a distance of 2 their members instead meet
    at common neighbours: two fingerprints differ in at most 2 bits exactly if some value differs
    from both in at most one, so each names its 65 such values and hangs on the least of those that
    share one. Nothing is dropped, and the rows stay in proportion to the fingerprints.
    """
    masks = [F.lit(_signed(m)) for m in block_masks(max_distance, blocks)]
    keys = F.array(*[F.struct(F.lit(i).alias("block"), F.col("fp").bitwiseAND(m).alias("value")) for i, m in enumerate(masks)])
    placed = prints.select("fp", F.explode(keys).alias("key")).select("fp", "key.block", "key.value")
    sizes = placed.groupBy("block", "value").agg(F.count("*").alias("n")).where("n > 1")
    shared = stored(placed.join(sizes, ["block", "value"]), "simhash-buckets")
    cold = shared if max_distance != 2 else shared.where(F.col("n") <= paired)
    left, right = cold.select("block", "value", F.col("fp").alias("a")), cold.select("block", "value", F.col("fp").alias("b"))
    distance = F.bit_count(F.col("a").bitwiseXOR(F.col("b")))
    pairs = left.join(right, ["block", "value"]).where(F.col("a") < F.col("b")).where(distance <= max_distance).select("a", "b")
    if max_distance != 2:
        return pairs.distinct()
    flips = F.array(F.lit(0).cast("long"), *[F.lit(_signed(1 << b)) for b in range(BITS)])
    hot = shared.where(F.col("n") > paired).select("fp").distinct()
    near = hot.select("fp", F.explode(flips).alias("flip")).select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("at"))
    least = near.groupBy("at").agg(F.min("fp").alias("b"), F.count("*").alias("n")).where("n > 1").drop("n")
    hung = near.join(least, "at").where("fp <> b").select(F.col("fp").alias("a"), "b")
    return pairs.unionByName(hung).distinct()


def grouped(docs: DataFrame, max_distance: int = MAX_DISTANCE, shingle_words: int = SHINGLE_WORDS) -> DataFrame:
    """(doc_id, key, fp, component, component_id) of every row; ``component`` is the group's least fingerprint."""
    rows = stored(with_fingerprint(docs, shingle_words), "simhash-prints")
    prints = rows.groupBy("fp").agg(F.min("doc_id").alias("first"))
    linked = components(links(prints.select("fp"), max_distance), "simhash-links")
    member = prints.join(linked.withColumnRenamed("node", "fp"), "fp", "left")
    member = stored(member.select("fp", "first", F.coalesce("component", "fp").alias("component")), "simhash-groups")
    least = member.groupBy("component").agg(F.min("first").alias("component_id"))
    return join_unique(rows, member.join(least, "component").select("fp", "component", "component_id"), ["fp"])


def near_duplicates(docs: DataFrame, max_distance: int = MAX_DISTANCE, shingle_words: int = SHINGLE_WORDS) -> DataFrame:
    """(doc_id, fp, component_id) of every row: groups reachable over links of close fingerprints.

    Input needs ``doc_id`` and ``text``; other columns are ignored, whatever their names.

    * A text without words (NULL, empty, blank) has fingerprint 0 and is linked like any other.
    * Equal fingerprints are one node, so a group of copies costs one fingerprint.
    * component_id is the smallest doc_id of the group; NULL only where all its ids are NULL.
    * Repeated rows and rows that share a doc_id each give a row.
    * An empty table gives no rows.
    """
    return grouped(docs, max_distance, shingle_words).select("doc_id", "fp", "component_id")


def drop_near_duplicates(docs: DataFrame, max_distance: int = MAX_DISTANCE, shingle_words: int = SHINGLE_WORDS) -> DataFrame:
    """The documents without the near copies, all columns kept: one row of each group stays, as ``keep_one`` says."""
    return keep_one(docs, grouped(docs, max_distance, shingle_words))


def keep_one(docs: DataFrame, found: DataFrame) -> DataFrame:
    """One row of each ``component`` of ``found`` (doc_id, key, component), all columns kept.

    It is the row with the smallest doc_id; among rows that share that id the one whose text hashes
    lowest, and of rows equal in both any one. A group without any id keeps a row likewise.
    """
    rank = F.struct(F.col("doc_id").isNull().alias("anonymous"), "doc_id", "key")
    best = found.groupBy("component").agg(F.min(rank).alias("best"))
    same = found.groupBy("component", "doc_id", "key").agg(F.count("*").alias("n"))
    met = same.join(best, "component").where(F.col("doc_id").eqNullSafe(F.col("best.doc_id")) & (F.col("key") == F.col("best.key")))
    winners = stored(met.select(F.col("doc_id").alias("id"), "key", "n"), "simhash-winners")
    own = packed(docs, id=F.col("doc_id").cast("long"), key=text_key(F.col("text")))
    kept = join_unique(own, winners, ["id", "key"])
    if not winners.where("n > 1").isEmpty():
        kept = kept.where("n = 1").unionByName(kept.where("n > 1").dropDuplicates(["id", "key"]))
    return unpacked(kept, docs.columns)
