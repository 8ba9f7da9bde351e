"""Join helpers that stay correct and balanced when one key holds a large share of the rows.

A side is broadcast only after its size was measured. Beyond the limit it is a plain shuffle
join on the key, with one row per key on that side: adaptive execution splits the tasks of a
hot key, and nothing is repeated where no key is hot.
"""

from __future__ import annotations

from math import ceil

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetpulse.sources.tables import materialized

BROADCAST_BYTES = 64 * 1024 * 1024
# An item list up to this size travels along as an array in every row.
LIST_BYTES = 64 * 1024
SHARDS = 32
# Words of 64 bits in a filter of keys that is broadcast: two longs each, 32 MB.
FILTER_WORDS = 1 << 21


def measured_bytes(df: DataFrame) -> int:
    """Size of a frame's rows as JSON text; one distributed aggregate."""
    size = df.select(F.octet_length(F.to_json(F.struct(*df.columns))).alias("bytes"))
    return size.agg(F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes")).first()["bytes"]


def known_bytes(df: DataFrame) -> int | None:
    """Size of a frame that is nothing but rows given in the program; None for any other."""
    plan = df._jdf.queryExecution().optimizedPlan()
    return int(plan.stats().sizeInBytes()) if plan.nodeName() == "LocalRelation" else None


def is_small(df: DataFrame, limit: int = BROADCAST_BYTES) -> bool:
    known = known_bytes(df)
    return (measured_bytes(df) if known is None else known) <= limit


def lookup(
    left: DataFrame,
    dim: DataFrame,
    on: list[str],
    how: str = "inner",
    limit: int = BROADCAST_BYTES,
    small: bool | None = None,
) -> DataFrame:
    """Join to a side with one row per key: broadcast when measured small, else shuffled.

    A caller that joins one side several times measures it once and passes ``small``.
    """
    if is_small(dim, limit) if small is None else small:
        return left.join(F.broadcast(dim), on, how)
    return left.join(dim, on, how)


def key_filter(rows: DataFrame, keys: DataFrame, on: list[str], words: int) -> DataFrame:
    """Rows whose key may be among ``keys``: a Bloom filter in blocks of 64 bits, tested where the rows are scanned.

    A key sets three bits of one word. The words are one hash aggregate of the keys and are
    broadcast, at most ``words`` pairs of longs. A word is found by its number, so a row costs one probe. Few
    bits per key let more rows through, never fewer; who needs certainty joins the rows left.
    """
    at = F.pmod(F.xxhash64(*on), F.lit(words))
    spread = F.xxhash64(F.lit("bits"), *on)
    bit = lambda k: F.expr(f"shiftleft(1L, cast(shiftrightunsigned(_spread, {6 * k}) & 63 AS INT))")
    mask = bit(0).bitwiseOR(bit(1)).bitwiseOR(bit(2))
    set_ = keys.select(at.alias("_word"), spread.alias("_spread")).groupBy("_word").agg(F.bit_or(mask).alias("_set"))
    probed = rows.withColumns({"_word": at, "_spread": spread}).join(F.broadcast(set_), "_word")
    return probed.where(F.col("_set").bitwiseAND(mask) == mask).drop("_word", "_spread", "_set")


def pick(rows: DataFrame, narrow: DataFrame, on: list[str], most_bytes: int = BROADCAST_BYTES, most_words: int = FILTER_WORDS) -> DataFrame:
    """Rows that meet a narrow table with one row per key; the rows are scanned once, however many keys there are.

    The table is stored and measured. A small one is broadcast to the scan. Else the scan drops what a
    filter of the keys excludes (16 bits a key, while ``most_words`` allow), and only the rows left are
    shuffled to meet the table.
    """
    table = materialized(narrow, "picked")
    if measured_bytes(table) <= most_bytes:
        return rows.join(F.broadcast(table), on)
    words = max(1, min(ceil(table.count() / 4), most_words))
    return key_filter(rows, table.select(*on), on, words).join(table, on)


def fan_out(rows: DataFrame, items: DataFrame, name: str, limit: int = LIST_BYTES) -> DataFrame:
    """One output row per (row, item), the item as struct column ``name``.

    A small item list travels with each row as an array and is exploded, so nothing
    is shuffled. A large one is cut into shards; each row visits all of them, under a salt
    whose width follows the cluster, so that shards times salts keep all tasks busy.
    """
    packed = items.select(F.struct(*items.columns).alias(name))
    if is_small(items, limit):
        listed = packed.agg(F.collect_list(name)).scalar()
        return rows.withColumn("_items", listed).withColumn(name, F.explode("_items")).drop("_items")
    salts = max(1, 4 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")) // SHARDS)
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    shard = F.pmod(F.xxhash64(*items.columns), F.lit(SHARDS)).cast("int")
    sharded = items.select(shard.alias("_shard"), F.struct(*items.columns).alias(name)).withColumn("_salt", every(salts))
    salt = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(salts)).cast("int")
    visits = rows.withColumn("_salt", salt).withColumn("_shard", every(SHARDS))
    return visits.join(sharded, ["_shard", "_salt"]).drop("_shard", "_salt")
