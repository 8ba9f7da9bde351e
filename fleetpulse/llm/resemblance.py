"""Near copies by shingle similarity: shared shingles of a prefix propose pairs, the exact similarity decides."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetpulse.llm.common import components, join_unique, release, stored, text_key, tokenize
from fleetpulse.llm.embeddings import _least_reachable
from fleetpulse.llm.lm import _mixed
from fleetpulse.llm.simhash import keep_one
from fleetpulse.operators.joins import BROADCAST_BYTES, measured_bytes

SHINGLE_WORDS = 5
SIMILARITY = 0.8
# A shingle that more texts than this share is common: it stands last in the order of the prefixes, the
# commonest at the end, and the texts that still meet at one are linked through one of them first.
PAIRED_BUCKET = 32
# Common shingles that are broadcast, at most.
MOST_COMMON = 1 << 20
# A prefix has one shingle more for every so many of the text, and texts must meet at as many more.
PER_MEETING = 10
# Texts of a batch whose shingles are sorted at once.
_PART = 64
# Texts and shingles of a tile, on average; shingles whose products are summed at once.
TILE, TILE_SHINGLES, _COLUMNS = 1024, 1 << 19, 2048
_U64 = np.uint64


def shingle_sets(texts: pa.Array, k: int = SHINGLE_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the k-word shingles of each text in order, and the bounds of each text's.

    Fewer words make one shingle, none none. A repeat has a hash of its own, by its number, so the
    similarity of two such sets is the weighted similarity of the texts.
    """
    tokens = tokenize(texts, lower=True)
    sizes = np.diff(tokens.starts)
    bounds = np.concatenate([[0], np.cumsum(np.where(sizes > 0, np.maximum(sizes - k + 1, 1), 0))])
    row = np.repeat(np.arange(len(sizes)), np.diff(bounds))
    at = np.arange(len(row))
    first, width, ids = tokens.starts[:-1][row] + at - bounds[row], np.minimum(sizes, k)[row], tokens.ids()
    h = np.full(len(row), k, _U64)
    for j in range(k):
        h = np.where(j < width, _mixed(h * _U64(3) + ids[np.minimum(first + j, len(ids) - 1)]), h)
    h = h[np.lexsort((h, row))]
    same = np.concatenate([[False], (h[1:] == h[:-1]) & (row[1:] == row[:-1])])[: len(h)]
    if same.any():
        nth = (at - np.maximum.accumulate(np.where(same, 0, at))).astype(_U64)
        h = np.where(same, _mixed(h + nth * _U64(0x9E3779B97F4A7C15)), h)
        h = h[np.lexsort((h, row))]
    return h, bounds


def _lists(values: np.ndarray, bounds: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(values.view(np.int64)))


def _chosen(h: np.ndarray, bounds: np.ndarray, share: float, common: tuple[np.ndarray, np.ndarray], meetings: bool) -> pa.ListArray:
    """Of each text the first 1 + floor(share * n) shingles, for ``meetings`` n // PER_MEETING more: common ones last, else by hash."""
    sizes = np.diff(bounds)
    row = np.repeat(np.arange(len(sizes)), sizes)
    known, orders = common
    if len(known):
        at = np.minimum(np.searchsorted(known, h), len(known) - 1)
        h = h[np.argsort(1024 * row + np.where(known[at] == h, orders[at], 0), kind="stable")]
    most = np.minimum(sizes, np.floor(share * sizes + 1e-9).astype(np.int64) + 1 + meetings * (sizes // PER_MEETING))
    return _lists(h[np.arange(len(h)) - bounds[row] < most[row]], np.concatenate([[0], np.cumsum(most)]))


def _nodes(h: np.ndarray, bounds: np.ndarray) -> pa.Array:
    nodes = [xxhash.xxh64_intdigest(h[a:b].tobytes()) for a, b in zip(bounds[:-1], bounds[1:])]
    return pa.array(np.array(nodes, _U64).view(np.int64))


def _part(batch: pa.RecordBatch, i: int) -> pa.RecordBatch:
    """Some rows as a copy: ``tokenize`` misreads the offsets of a slice."""
    return batch.take(pa.array(np.arange(i, min(i + _PART, batch.num_rows))))


def _narrow(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key(F.col("text")).alias("key"), F.col("text").cast("string").alias("text"))


def _prefixes(docs: DataFrame, k: int, share: float, common: tuple[np.ndarray, np.ndarray], meetings: bool) -> DataFrame:
    """(doc_id, key, node, n, prefix) of every row; texts with the same shingles are one ``node``."""
    shared = docs.sparkSession.sparkContext.broadcast(common)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, _PART):
                part = _part(batch, i)
                h, bounds = shingle_sets(part.column("text"), k)
                columns = [*part.columns[:2], _nodes(h, bounds), pa.array(np.diff(bounds)), _chosen(h, bounds, share, shared.value, meetings)]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "key", "node", "n", "prefix"])

    return _narrow(docs).mapInArrow(run, "doc_id long, key long, node long, n long, prefix array<long>")


def _all_shingles(docs: DataFrame, k: int) -> DataFrame:
    """(h) of every shingle of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, _PART):
                h, _ = shingle_sets(_part(batch, i).column("text"), k)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64))], ["h"])

    return docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "h long")


def _common(often: DataFrame, most: int = MOST_COMMON) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of (h, n) with the greatest counts, at most ``most`` of them, sorted; and their counts' orders of magnitude.

    A histogram over these orders says from which on all of them are few enough.
    """
    size = F.floor(F.log2("n") * 8).cast("int")
    seen = often.groupBy(size.alias("size")).agg(F.count("*").alias("hashes")).collect()
    least, total = None, 0
    for row in sorted(seen, reverse=True):
        total += row["hashes"]
        if total > most:
            break
        least = row["size"]
    if least is None:
        return np.empty(0, _U64), np.empty(0, np.int64)
    found = often.where(size >= least).select("h", size.alias("size")).toArrow()
    hashes = found["h"].to_numpy().view(_U64)
    order = np.argsort(hashes)
    return hashes[order], found["size"].to_numpy()[order].astype(np.int64)


def _most_common(often: DataFrame, most: int = MOST_COMMON) -> np.ndarray:
    return _common(often, most)[0]


def _sets(texts: DataFrame, k: int) -> DataFrame:
    """(node, n, shingles) of (node, text) rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, _PART):
                part = _part(batch, i)
                h, bounds = shingle_sets(part.column("text"), k)
                yield pa.RecordBatch.from_arrays([part.column("node"), pa.array(np.diff(bounds)), _lists(h, bounds)], ["node", "n", "shingles"])

    return texts.select("node", "text").mapInArrow(run, "node long, n long, shingles array<long>")


def grouped(docs: DataFrame, similarity: float = SIMILARITY, shingle_words: int = SHINGLE_WORDS, paired: int = PAIRED_BUCKET) -> DataFrame:
    """(doc_id, key, component) of every row: groups reachable over pairs of at least ``similarity``.

    The similarity is the sum of least weights over the sum of greatest of the texts' shingles.

    1. In any one order of all shingles, two similar texts share k of the first n - ceil(similarity * n) + k
       of each, for the lesser k of the two. Here k is 1 + n // PER_MEETING, so texts that only have a
       passage in common seldom meet often enough. The order puts common shingles last; which count as
       common changes the work, not the result.
    2. Texts that meet at shingles of at most ``paired`` texts each are compared with each other, if they meet
       often enough; at how many others they may meet besides is known from how many each has.
    3. At one of more texts, which groups of near copies make, all are compared with the least. Where
       texts of different groups are left after that, they are compared in tiles; see ``tiled``.
    """
    if not 0 < similarity <= 1:
        raise ValueError("0 < similarity <= 1")
    share, label = 1 - similarity, "similar"
    counted = _all_shingles(docs, shingle_words).groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") > paired)
    common = _common(stored(counted, f"{label}-common"))
    release(docs.sparkSession)
    whole = stored(_prefixes(docs, shingle_words, share, common, True), f"{label}-prefixes")
    rows = whole.select("doc_id", "key", "node")
    placed = whole.select("node", "n", F.explode("prefix").alias("h"))
    # Most shingles are of one text only and go before anything else is shuffled.
    met = placed.groupBy("h").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low < high")
    meeting = join_unique(placed, stored(met.select("h"), f"{label}-met"), ["h"])
    spread = stored(meeting.groupBy("h", "node").agg(F.min("n").alias("n")), f"{label}-spread")
    sizes = spread.groupBy("h").agg(F.count("*").alias("met"), F.min("node").alias("least"))
    shared = stored(spread.join(sizes, "h"), f"{label}-shared")
    crowded = stored(shared.where(F.col("met") > paired).groupBy("node").agg(F.count("*").alias("others")), f"{label}-crowded")

    def often_enough(cold: DataFrame) -> DataFrame:
        ends = join_unique(cold, crowded, ["node"], "left").withColumn("others", F.coalesce("others", F.lit(0)))
        left = ends.select("h", F.col("node").alias("a"), "n", "others")
        right = ends.select("h", F.col("node").alias("b"), F.col("n").alias("m"), F.col("others").alias("_others"))
        fits = F.least("n", "m") >= F.lit(similarity) * F.greatest("n", "m") - F.lit(1e-9)
        met = left.join(right, "h").where((F.col("a") < F.col("b")) & fits).groupBy("a", "b")
        seen = met.agg(F.count("*").alias("c"), F.min(F.least("n", "m")).alias("n"), F.min(F.least("others", "_others")).alias("more"))
        return seen.where(F.col("c") + F.col("more") >= 1 + F.floor(F.col("n") / PER_MEETING)).select("a", "b")

    cold, hot = shared.where(F.col("met") <= paired), shared.where(F.col("met") > paired)
    hung = hot.where("node <> least").select(F.col("least").alias("a"), F.col("node").alias("b")).distinct()
    tried = stored(often_enough(cold).unionByName(hung).distinct(), f"{label}-pairs")
    release(docs.sparkSession)
    edges = stored(similar(docs, rows, tried, similarity, shingle_words), f"{label}-edges")
    linked = components(edges, f"{label}-links")
    if not hot.isEmpty():
        owned = join_unique(hot, linked, ["node"], "left").withColumn("group", F.coalesce("component", "node"))
        mixed = owned.groupBy("h").agg(F.min("group").alias("low"), F.max("group").alias("high")).where("low <> high").select("h")
        left = stored(owned.join(mixed, "h", "left_semi").select("h", "node", "n", "least"), f"{label}-left")
        if not left.isEmpty():
            found = tiled(docs, rows, left, similarity, shingle_words)
            linked = components(edges.unionByName(found), f"{label}-links")
    member = join_unique(rows, linked, ["node"], "left")
    return stored(member.select("doc_id", "key", F.coalesce("component", "node").alias("component")), f"{label}-groups")


def tiled(docs: DataFrame, rows: DataFrame, met: DataFrame, similarity: float, shingle_words: int, tile: int = TILE) -> DataFrame:
    """Links (a, b) that connect the texts of (h, node, n, least), which meet at common shingles, as their similar pairs do.

    Texts that common shingles connect make a family, whose texts are compared once, however many of these
    they share; if its shingles have fewer pairs in all, each of them is compared for itself. A family is
    dealt to tiles by hash. Each pair of tiles is one task, and gives one row per linked text: the least that
    it reaches there. So a group costs its texts times its tiles in rows, not its pairs.
    """
    families = components(met.select(F.col("node").alias("a"), F.col("least").alias("b")), "similar-families")
    placed = stored(join_unique(met, families, ["node"]).withColumnRenamed("component", "family"), "similar-placed")
    alone = placed.groupBy("family", "h").agg(F.count("*").alias("k")).groupBy("family").agg(F.sum(F.col("k").cast("double") * F.col("k")).alias("alone"))
    sizes = placed.groupBy("family").agg(F.countDistinct("node").cast("double").alias("k"))
    whole = sizes.join(alone, "family").select("family", (F.col("k") * F.col("k") <= F.col("alone")).alias("whole"))
    unit = F.when(F.col("whole"), F.struct(F.lit(True).alias("family"), F.col("family").alias("of"))).otherwise(F.struct(F.lit(False).alias("family"), F.col("h").alias("of")))
    units = stored(join_unique(placed, whole, ["family"]).select(unit.alias("unit"), "node", "n").distinct(), "similar-units")
    tiles = F.ceil(F.greatest(F.count("*") / F.lit(tile), F.sum("n") / F.lit(TILE_SHINGLES))).cast("int")
    many = units.groupBy("unit").agg(tiles.alias("tiles"))
    dealt = join_unique(units, many, ["unit"]).withColumn("tile", F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int"))
    turns = F.transform(
        F.sequence(F.lit(0), F.col("tiles") - 1),
        lambda t: F.struct(F.least(t, F.col("tile")).alias("i"), F.greatest(t, F.col("tile")).alias("j")),
    )
    sets = _sets_of(docs, rows, units.select("node").distinct(), shingle_words)
    known = dealt.select("unit", "node", "tile", F.explode(turns).alias("turn")).join(stored(sets.select("node", "shingles"), "similar-tiled"), "node")
    sent = known.select("unit.*", "turn.i", "turn.j", "tile", "node", "shingles")
    return stored(sent.groupBy("family", "of", "i", "j").applyInPandas(_tile_pair(similarity), "a long, b long"), "similar-found")


def _shared(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """How many shingles each of some texts shares with each of others; a text's are distinct."""
    out = np.zeros((len(left), len(right)), np.int64)
    both = np.intersect1d(np.concatenate(left), np.concatenate(right))
    places = []
    for sets in (left, right):
        h, row = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        at = np.searchsorted(both, h)
        at[at == len(both)] = 0
        real = both[at] == h if len(both) else np.zeros(len(h), bool)
        order = np.argsort(at[real], kind="stable")
        places.append((at[real][order], row[real][order], len(sets)))
    for first in range(0, len(both), _COLUMNS):
        dense = []
        for at, row, n in places:
            a, b = np.searchsorted(at, [first, first + _COLUMNS])
            block = np.zeros((n, min(_COLUMNS, len(both) - first)), np.float32)
            block[row[a:b], at[a:b] - first] = 1
            dense.append(block)
        out += (dense[0] @ dense[1].T).astype(np.int64)
    return out


def _tile_pair(similarity: float):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        i, j = rows["i"].iloc[0], rows["j"].iloc[0]
        left, right = rows[rows["tile"] == i], rows[rows["tile"] == j]
        if left.empty or right.empty:
            return pd.DataFrame({"a": pd.Series(dtype="int64"), "b": pd.Series(dtype="int64")})
        n, m = (t["shingles"].map(len).to_numpy() for t in (left, right))
        common = _shared(left["shingles"].to_list(), right["shingles"].to_list())
        every = n[:, None] + m[None, :] - common
        a, b = np.nonzero((common > 0) & (common / np.maximum(every, 1) >= similarity))
        nodes, back = np.unique(np.concatenate([left["node"].to_numpy(), right["node"].to_numpy()]), return_inverse=True)
        least = _least_reachable(len(nodes), back[a], back[len(left) + b])
        hung = np.flatnonzero(least != np.arange(len(nodes)))
        return pd.DataFrame({"a": nodes[hung], "b": nodes[least[hung]]})

    return run


def _sets_of(docs: DataFrame, rows: DataFrame, nodes: DataFrame, shingle_words: int) -> DataFrame:
    """(node, n, shingles) of some nodes, from one row of each."""
    one = rows.join(nodes, "node", "left_semi").groupBy("node").agg(F.min(F.struct("doc_id", "key")).alias("row"))
    keys = stored(one.select("node", "row.*"), "similar-wanted")
    sets = _sets(join_unique(_narrow(docs), keys, ["doc_id", "key"]), shingle_words)
    if join_unique(rows.select("doc_id", "key"), keys, ["doc_id", "key"]).count() > keys.count():
        return stored(sets.dropDuplicates(["node"]), "similar-sets")  # rows that are repeated whole
    return sets


def similar(docs: DataFrame, rows: DataFrame, pairs: DataFrame, similarity: float, shingle_words: int) -> DataFrame:
    """The pairs (a, b) of nodes whose texts are similar enough.

    A node's shingles come from one of its rows. They are shuffled to the pairs' ``a`` from both ends and are
    not stored: computing them for each end costs less than a table of all.
    """
    sets = _sets_of(docs, rows, pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), shingle_words)
    few = F.broadcast(pairs) if measured_bytes(pairs) <= BROADCAST_BYTES else pairs
    ended = sets.select(F.col("node").alias("b"), F.col("shingles").alias("t"), F.col("n").alias("m")).join(few, "b")
    both = ended.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("s"), "n"), "a")
    common = both.select("a", "b", "n", "m", F.size(F.array_intersect("s", "t")).alias("c"))
    return common.where(F.col("c") / (F.col("n") + F.col("m") - F.col("c")) >= similarity).select("a", "b")


def drop_similar(docs: DataFrame, similarity: float = SIMILARITY, shingle_words: int = SHINGLE_WORDS, paired: int = PAIRED_BUCKET) -> DataFrame:
    """The documents without the near copies, all columns kept: one row of each group stays, as ``keep_one`` says.

    * Texts without words (NULL, empty, blank) are copies of each other. Fewer words than a shingle are one.
    * Only the text is compared, words without white space, A-Z lower-cased. An empty table gives no rows.
    """
    return keep_one(docs, grouped(docs, similarity, shingle_words, paired))
