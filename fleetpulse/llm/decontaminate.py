"""Benchmark decontamination: SimHash of item-sized windows, Hamming blocks, exact similarity.

Built-in functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fleetpulse.llm.common import ascii_lower, join_unique, packed, stored, text_key, unpacked, words
from fleetpulse.operators.joins import BROADCAST_BYTES, measured_bytes

SHINGLE_WORDS = 5
SIMILARITY = 0.8
# Texts with a weighted similarity of 0.8 have a cosine of 0.89 or so: their fingerprints differ in 9.7
# of 64 bits on average, with a deviation of 2.9. The radius lies 3.9 deviations above.
RADIUS = 21
BITS = 64
# Counters of 16 bits, four to a long, hold the shingles of items of so many words; with a longer item
# they have 32 bits, two to a long. The fingerprints are the same.
LANES, WIDE_LANES = 16, 32
NARROW_WORDS = 32_000


def _hash(c: Column) -> Column:
    return F.xxhash64(c)


def shingles(tokens: Column, k: int = SHINGLE_WORDS) -> Column:
    """Array of the k-word shingles of an array of words, repeats included; fewer words make one, none none."""
    n = F.size(tokens)
    many = F.transform(F.sequence(F.lit(1), n - (k - 1)), lambda i: F.array_join(F.slice(tokens, i, k), " "))
    return F.when(n >= k, many).when(n > 0, F.array(F.array_join(tokens, " "))).otherwise(F.array().cast("array<string>"))


def _grams(tokens: Column, k: int) -> Column:
    """Array of (pos, h): where each run of k words starts, and its hash."""
    places = F.sequence(F.lit(0), F.size(tokens) - k)
    hashed = lambda i: F.struct(i.alias("pos"), _hash(F.array_join(F.slice(tokens, i + 1, k), " ")).alias("h"))
    return F.when(F.size(tokens) >= k, F.transform(places, hashed)).otherwise(F.array().cast("array<struct<pos:int,h:bigint>>"))


def normal_words(text: Column) -> Column:
    return words(ascii_lower(text))


def lane_counts(h: Column, weight: Column, lanes: int = LANES) -> list[Column]:
    """Sums of the bits of hashes ``h`` by their weights, every ``lanes``-th bit in one long."""
    mask = F.lit(sum(1 << i for i in range(0, BITS, lanes)))
    return [F.sum(F.shiftrightunsigned(h, i).bitwiseAND(mask) * weight).alias(f"lane{i}") for i in range(lanes)]


def majority(n: Column, lanes: int = LANES) -> Column:
    """The fingerprint: bits that over half of ``n`` hashes have, from their lane counts."""
    bits = []
    for i in range(lanes):
        for part in range(BITS // lanes):
            count = F.shiftrightunsigned(F.col(f"lane{i}"), lanes * part).bitwiseAND(F.lit((1 << lanes) - 1))
            value = 1 << (i + lanes * part)
            value -= (value >> (BITS - 1)) << BITS
            bits.append(F.when(count * 2 > n, F.lit(value).cast("long")).otherwise(F.lit(0).cast("long")))
    while len(bits) > 1:
        bits = [a.bitwiseOR(b) for a, b in zip(bits[::2], bits[1::2])]
    return bits[0]


def blocks(fp: Column, radius: int) -> Column:
    """Array of (block, value): fingerprints within the radius agree in one of radius + 1 blocks."""
    cuts = [round(i * BITS / (radius + 1)) for i in range(radius + 2)]
    parts = [F.shiftrightunsigned(fp, a).bitwiseAND(F.lit((1 << (b - a)) - 1)) for a, b in zip(cuts, cuts[1:])]
    return F.array(*[F.struct(F.lit(i).alias("block"), p.alias("value")) for i, p in enumerate(parts)])


def _met(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """Equi-join whose right side is broadcast when measured small enough."""
    return left.join(F.broadcast(right) if measured_bytes(right) <= BROADCAST_BYTES else right, on)


def benchmark_items(benchmark: DataFrame, k: int = SHINGLE_WORDS) -> DataFrame:
    """(item, n_words, n, shingle, weight, h) of every distinct shingle of every distinct item text.

    Items without words are left out; items with the same words are one, under the least id.
    """
    tokens = normal_words(F.col("text"))
    texts = benchmark.select("item_id", tokens.alias("tokens")).where(F.size("tokens") > 0)
    texts = texts.groupBy("tokens").agg(F.min("item_id").alias("item_id"))
    own = texts.select(F.xxhash64("tokens").alias("item"), F.size("tokens").alias("n_words"), shingles(F.col("tokens"), k).alias("s"))
    each = own.select("item", "n_words", F.size("s").alias("n"), F.explode("s").alias("shingle"))
    weighed = each.groupBy("item", "n_words", "n", "shingle").agg(F.count("*").alias("weight"))
    return weighed.withColumn("h", _hash(F.col("shingle")))


def contaminated(
    docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, radius: int = RADIUS, k: int = SHINGLE_WORDS
) -> DataFrame:
    """(key, items, similarity) of the texts that hold a window similar to a benchmark item.

    ``key`` is the text's hash, ``items`` the item_ids (equal items under the least), in order.

    1. A window is as many words as the item has, or the whole text if that is shorter. One that
       shares no shingle with the item has similarity 0. If a window is similar enough, so
       is one that starts at a shared shingle or ends with the text, as moving it right past a
       foreign shingle loses nothing; so only those are built.
    2. A similar window has at least similarity / (1 + similarity) of both's shingles in common:
       the shared shingle that many places on has to lie in the window too.
    3. Windows and items of one size meet if their fingerprints agree in one of radius + 1
       blocks, which all fingerprints within the radius do.
    4. The weighted similarity of the shingles, sum of least weights over sum of greatest, decides.

    Copies of a text are one from step 1 on.
    """
    items = stored(benchmark_items(benchmark, k), "bench-items")
    least = similarity / (1 + similarity)
    # Grams of five words, and of the sizes of shorter items: those are one shingle.
    sizes = [k, *sorted(r[0] for r in items.where(F.col("n_words") < k).select("n_words").distinct().collect())]
    narrow = docs.select(text_key(F.col("text")).alias("key"), normal_words(F.col("text")).alias("tokens"))
    grams = F.concat(*[_grams(F.col("tokens"), size) for size in sizes])
    placed = narrow.select("key", F.size("tokens").alias("size"), F.explode(grams).alias("g")).select("key", "size", "g.pos", "g.h")
    sought = items.select("h", "item", "n_words", "n")
    hits = stored(_met(placed, sought, ["h"]).select("key", "size", "pos", "item", "n_words", "n").distinct(), "bench-hits")

    # 1 and 2: the places of an item's shingles in a text, numbered, to look some places ahead.
    span = F.least("n_words", "size")
    within = F.greatest(span - (k - 1), F.lit(1))
    needed = F.greatest(F.ceil(F.lit(least) * (F.col("n") + within) - F.lit(1e-9)), F.lit(1))
    order = F.row_number().over(Window.partitionBy("key", "item").orderBy("pos"))
    ranked = stored(hits.select("*", order.alias("rank"), within.alias("within"), needed.cast("int").alias("needed")), "bench-ranked")
    ahead = ranked.select("key", "item", (F.col("rank")).alias("rank"), F.col("pos").alias("until"))
    here = ranked.withColumn("rank", F.col("rank") + F.col("needed") - 1)
    dense = here.join(ahead, ["key", "item", "rank"])
    start = F.greatest(F.lit(0), F.least(F.col("pos"), F.col("size") - F.least("n_words", "size")))
    dense = dense.where(F.col("until") < start + F.col("within"))
    windows = stored(dense.select("key", start.alias("start"), "n_words").distinct(), "bench-windows")

    # The shingles of the windows: the texts that have any meet them once.
    wanted = stored(windows.groupBy("key").agg(F.collect_set(F.struct("start", "n_words")).alias("windows")), "bench-wanted")
    found = join_unique(docs.select(text_key(F.col("text")).alias("key"), "text"), wanted, ["key"])
    cut = found.select("key", normal_words(F.col("text")).alias("tokens"), "windows")
    piece = lambda w: F.struct(w["start"].alias("start"), w["n_words"].alias("n_words"), F.slice(F.col("tokens"), w["start"] + 1, w["n_words"]).alias("words"))
    pieces = cut.select("key", F.explode(F.transform("windows", piece)).alias("w")).select("key", "w.*")
    texts = pieces.select(F.xxhash64("words").alias("window"), "n_words", "words", "key")
    of_text = stored(texts.select("key", "window", "n_words", "words").distinct(), "bench-pieces")
    distinct = of_text.groupBy("window", "n_words").agg(F.first("words").alias("words"))
    each = distinct.select("window", "n_words", F.explode(shingles(F.col("words"), k)).alias("shingle"))
    weighed = stored(each.groupBy("window", "n_words", "shingle").agg(F.count("*").alias("weight")), "bench-shingles")

    # 3: blocks.
    longest = items.agg(F.max("n_words")).first()[0] or 0
    lanes = LANES if longest <= NARROW_WORDS else WIDE_LANES
    window_prints = _prints(weighed.withColumn("h", _hash(F.col("shingle"))), "window", "fp", lanes)
    item_prints = _prints(items, "item", "ifp", lanes)
    blocked = window_prints.select("window", "n_words", "fp", F.explode(blocks(F.col("fp"), radius)).alias("b")).select("*", "b.*").drop("b")
    item_blocked = item_prints.select("item", "n_words", "ifp", F.explode(blocks(F.col("ifp"), radius)).alias("b")).select("*", "b.*").drop("b")
    close = F.bit_count(F.col("fp").bitwiseXOR(F.col("ifp"))) <= radius
    pairs = stored(_met(blocked, item_blocked, ["n_words", "block", "value"]).where(close).select("window", "n_words", "item").distinct(), "bench-pairs")

    # 4: exact similarity.
    totals = lambda df, name, total: df.groupBy(name, "n_words").agg(F.sum("weight").alias(total))
    side = weighed.select("window", "n_words", "shingle", F.col("weight").alias("w1"))
    both = _met(pairs.join(side, ["window", "n_words"]), items.select("item", "n_words", "shingle", F.col("weight").alias("w2")), ["item", "n_words", "shingle"])
    common = both.groupBy("window", "n_words", "item").agg(F.sum(F.least("w1", "w2")).alias("common"))
    sized = _met(common.join(totals(weighed, "window", "n1"), ["window", "n_words"]), totals(items, "item", "n2"), ["item", "n_words"])
    score = F.col("common") / (F.col("n1") + F.col("n2") - F.col("common"))
    similar = sized.withColumn("similarity", score).where(F.col("similarity") >= similarity)
    listed = benchmark.select("item_id", normal_words(F.col("text")).alias("tokens")).where(F.size("tokens") > 0)
    named = listed.groupBy(F.xxhash64("tokens").alias("item")).agg(F.min("item_id").alias("item_id"))
    told = _met(similar, named, ["item"]).select("window", "n_words", "item_id", "similarity")
    hit = _met(of_text.select("key", "window", "n_words").distinct(), told, ["window", "n_words"])
    return hit.groupBy("key").agg(F.array_sort(F.collect_set("item_id")).alias("items"), F.max("similarity").alias("similarity"))


def _prints(weighed: DataFrame, name: str, fp: str, lanes: int = LANES) -> DataFrame:
    """(name, n_words, fp): the fingerprint of every window or item from its shingles, weights counted."""
    summed = weighed.groupBy(name, "n_words").agg(*lane_counts(F.col("h"), F.col("weight"), lanes), F.sum("weight").alias("n"))
    return summed.select(name, "n_words", majority(F.col("n"), lanes).alias(fp))


def judge(docs: DataFrame, benchmark: DataFrame, **settings) -> DataFrame:
    """All rows and columns, plus ``_contaminated``, ``_items`` and ``_similarity`` (the highest found).

    Words are runs without white space, A-Z lower-cased. ``docs`` needs ``text``, ``benchmark``
    ``item_id`` and ``text``; other columns are kept or ignored.

    * NULL, empty and blank texts and items have no words and match nothing.
    * An item under five words is one shingle; a text under five words too.
    * Equal items count as one, under the least item_id. Repeated rows are judged alike.
    * An empty benchmark contaminates nothing; an empty table gives no rows.
    """
    found = stored(contaminated(docs, benchmark, **settings), "bench-found")
    met = join_unique(packed(docs, key=text_key(F.col("text"))), found, ["key"], "left")
    flag = F.col("items").isNotNull()
    none = F.array().cast(found.schema["items"].dataType)
    results = {"_contaminated": flag, "_items": F.coalesce("items", none), "_similarity": F.col("similarity")}
    return unpacked(met, docs.columns, **results)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, **settings) -> DataFrame:
    """The documents that hold no benchmark item, all columns kept."""
    found = stored(contaminated(docs, benchmark, **settings).select("key"), "bench-found")
    met = join_unique(packed(docs, key=text_key(F.col("text"))), found.withColumn("leak", F.lit(True)), ["key"], "left")
    return unpacked(met.where("leak IS NULL"), docs.columns)
