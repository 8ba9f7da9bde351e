"""Mixing sources to target weights: each document is repeated at its source's rate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fleetpulse.llm.common import WORD, join_unique, packed, stored, unpacked

# What the registered query asks for.
CYCLE = (3, 1, 2)
TOTAL_SHARE = 1.5
MAX_REPEATS = 2
SEED = "mix-1"
_HEX_DIGITS = 13


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def draw(doc_id: Column, text: Column, seed: str = SEED) -> Column:
    """A number in [0, 1) that depends on the seed and the doc_id alone; on the text where there is none."""
    name = F.coalesce(doc_id.cast("string"), F.concat(F.lit("text:"), F.md5(F.coalesce(text, F.lit("")).cast("binary"))))
    digest = F.md5(F.concat(F.lit(f"{seed}:"), name).cast("binary"))
    return F.conv(F.substring(digest, 1, _HEX_DIGITS), 16, 10).cast("double") / F.lit(float(16**_HEX_DIGITS))


def source_sizes(docs: DataFrame) -> DataFrame:
    """(source, source_size): words of each source; NULL is a source of its own."""
    return docs.groupBy("source").agg(F.sum(n_words(F.col("text"))).alias("source_size"))


def cyclic_weights(sizes: DataFrame, cycle: tuple[float, ...] = CYCLE) -> DataFrame:
    """Adds ``weight``: sources in code point order, NULL last, take the cycle's weights in turn.

    The table is sorted by ranges; a source's rank is its place in its range plus the rows of the
    ranges before, so no task holds more than one range of sources.
    """
    in_order = sizes.orderBy(F.col("source").asc_nulls_last()).withColumn("_at", F.monotonically_increasing_id())
    placed = stored(in_order, "mixing-sources")
    part, index = F.shiftright("_at", 33), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    # One row per range, of which there are at most as many as shuffle partitions.
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    ranges = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("n"))
    offsets = ranges.select("_part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_before"))
    ranked = join_unique(placed.withColumn("_part", part).withColumn("_index", index), offsets, ["_part"])
    turn = F.pmod(F.col("_before") + F.col("_index"), F.lit(len(cycle))).cast("int")
    weights = F.array(*[F.lit(float(w)) for w in cycle])
    return ranked.select("source", "source_size", F.get(weights, turn).alias("weight"))


def targets(weighted: DataFrame, share: float = TOTAL_SHARE, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """(source, source_size, target): shares by ``weight`` of ``share`` times all words.

    No target is over ``max_repeats`` times its source's size; what is cut off goes to the others by
    weight. All others then stand at one level times their weight; every round raises the level by
    what the sources under it can't take, until it stands. Only the level reaches the driver.
    """
    table = stored(weighted.withColumn("cap", F.col("source_size") * F.lit(max_repeats)), "mixing-weights")
    level = 0.0
    while True:
        full = F.col("cap") < F.lit(level) * F.col("weight")
        row = table.agg(
            F.coalesce(F.sum("source_size"), F.lit(0)).alias("total"),
            F.coalesce(F.sum(F.when(full, F.col("cap"))), F.lit(0)).alias("capped"),
            F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0.0)).alias("weight"),
        ).first()
        if not row["weight"]:
            break
        raised = (row["total"] * share - row["capped"]) / row["weight"]
        if raised <= level:
            break
        level = raised
    level_share = F.lit(level) * F.col("weight")
    target = F.when(F.col("cap") < level_share, F.col("cap").cast("double")).otherwise(level_share)
    return table.select("source", "source_size", target.alias("target"))


def assign(
    docs: DataFrame,
    cycle: tuple[float, ...] = CYCLE,
    share: float = TOTAL_SHARE,
    max_repeats: int = MAX_REPEATS,
    seed: str = SEED,
) -> DataFrame:
    """All rows and columns, plus ``_size``, ``_source_size``, ``_target`` and ``_copies``.

    A source's rate is its target over its size. Each of its documents is taken floor(rate) times,
    and once more if its draw is under the fraction.

    * Built-in functions only; the documents are read twice and not shuffled unless there are so
      many sources that their table is over the broadcast limit.
    * A NULL source is a source of its own. A NULL or empty text has size 0.
    * A source without words has target 0 and is not taken.
    * The draw hangs on seed and doc_id, so reruns agree; rows that share an id are taken alike.
      Without an id the text decides.
    * An empty table gives no rows.
    """
    goal = stored(targets(cyclic_weights(source_sizes(docs), cycle), share, max_repeats), "mixing-targets")
    met = join_unique(packed(docs, source=F.col("source"), doc_id=F.col("doc_id"), text=F.col("text")), goal, ["source"], "left")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    whole = F.floor(rate)
    extra = (draw(F.col("doc_id"), F.col("text"), seed) < rate - whole).cast("int")
    found = {"_size": n_words(F.col("text")), "_source_size": F.col("source_size"), "_target": F.col("target")}
    return unpacked(met, docs.columns, **found, _copies=(whole + extra).cast("int"))


def mix(docs: DataFrame, **settings) -> DataFrame:
    """The mixed documents: each as often as ``assign`` takes it, numbered by ``_copy`` from 1."""
    taken = assign(docs, **settings).where("_copies > 0")
    return unpacked(packed(taken, copy=F.explode(F.sequence(F.lit(1), F.col("_copies")))), docs.columns, _copy=F.col("copy"))


# ``{docs}`` stands for the table that is mixed.
TARGETS_SQL = r"""
sized AS (
  SELECT *, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM {docs}),
sizes AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
weighted AS (
  SELECT *, 2 * source_size AS cap,
    CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS weight
  FROM sizes),
levels(level) AS (
  SELECT 0.0::DOUBLE
  UNION
  SELECT (sum(source_size)::DOUBLE * 1.5::DOUBLE - coalesce(sum(cap) FILTER (WHERE cap < level * weight), 0)::DOUBLE)
    / sum(weight) FILTER (WHERE cap >= level * weight)
  FROM levels, weighted GROUP BY level),
goal AS (
  SELECT source, source_size, least(cap::DOUBLE, weight * (SELECT max(level) FROM levels)) AS target FROM weighted),
taken AS (
  SELECT d.*, g.source_size, g.target, CASE WHEN g.source_size > 0 THEN g.target / g.source_size ELSE 0 END AS rate,
    ('0x' || substr(md5('mix-1:' || coalesce(d.doc_id::VARCHAR, 'text:' || md5(coalesce(d.text, '')))), 1, 13))::UBIGINT::DOUBLE
      / 4503599627370496.0::DOUBLE AS draw
  FROM sized d JOIN goal g ON d.source IS NOT DISTINCT FROM g.source),
mixed AS (
  SELECT *, (floor(rate) + CASE WHEN draw < rate - floor(rate) THEN 1 ELSE 0 END)::BIGINT AS copies FROM taken)
"""

ORACLE_SQL = (
    "WITH RECURSIVE " + TARGETS_SQL.replace("{docs}", "documents")
    + "SELECT doc_id, size::BIGINT AS size, source_size, target, size * copies AS taken FROM mixed"
)
