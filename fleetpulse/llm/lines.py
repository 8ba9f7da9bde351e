"""Line dedup: lines that many documents share stay in one of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetpulse.llm.common import BLANK, ascii_lower, join_unique, packed, stored, text_key, unpacked

MIN_CHARS = 20
MIN_DOCUMENTS = 3


def line_key(line: Column) -> Column:
    """A line without white space at both ends, A-Z lower-cased."""
    return ascii_lower(F.btrim(line, F.lit(BLANK)))


def _digest(key: Column) -> list[Column]:
    """128 bits of a key as two longs."""
    return [F.xxhash64(key).alias("h1"), F.xxhash64(F.lit("line"), key).alias("h2")]


def split_lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_positions(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(id, key, pos, h1, h2) of every line whose key has ``min_chars`` code points or more."""
    narrow = docs.select(F.col("doc_id").alias("id"), text_key(F.col("text")).alias("key"), F.posexplode(split_lines(F.col("text"))).alias("pos", "line"))
    keyed = narrow.select("id", "key", "pos", line_key(F.col("line")).alias("line"))
    return keyed.where(F.length("line") >= min_chars).select("id", "key", "pos", *_digest(F.col("line")))


def drop_lines(
    docs: DataFrame, min_chars: int = MIN_CHARS, min_documents: int = MIN_DOCUMENTS
) -> DataFrame:
    """All rows and columns, ``text`` without lines found elsewhere; plus ``_n_lines``, ``_n_dropped``.

    A key of at least ``min_chars`` code points held by at least ``min_documents`` doc_ids loses all
    its lines except in the largest doc_id that holds it.

    * Only hashes and positions are shuffled; the text meets the dropped positions of its row once.
    * A key is counted once per document, then per key, both with partial sums, so a line that a
      third of all documents hold is no large group.
    * NULL and empty texts are one empty line; such a text is returned as ''.
    * A NULL doc_id is one document, smaller than any other. Rows that share a doc_id are one document.
    * Repeated rows lose the same lines. A document may lose all its lines; it stays, with ''.
    """
    lines = stored(line_positions(docs, min_chars), "line-positions")
    held = lines.groupBy("h1", "h2", "id").agg(F.lit(1).alias("one"))
    spread = held.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.max("id").alias("last")).where(F.col("n") >= min_documents)
    common = stored(spread.select("h1", "h2", "last"), "line-common")
    lost = join_unique(lines, common, ["h1", "h2"]).where(~F.col("id").eqNullSafe(F.col("last")))
    at = stored(lost.groupBy("id", "key").agg(F.sort_array(F.collect_set("pos")).alias("lost")), "line-losses")
    own = packed(docs, id=F.col("doc_id"), key=text_key(F.col("text")), lines=split_lines(F.col("text")))
    met = join_unique(own, at, ["id", "key"], "left")
    # What stays lies between two lost positions that follow each other, with an end on both sides.
    lost_at, size = F.coalesce("lost", F.array().cast("array<int>")), F.size("lines")
    gaps = F.arrays_zip(F.concat(F.array(F.lit(-1)), lost_at).alias("a"), F.concat(lost_at, F.array(size)).alias("b"))
    kept = F.flatten(F.transform(gaps, lambda g: F.slice(F.col("lines"), g["a"] + 2, g["b"] - g["a"] - 1)))
    counts = {"_n_lines": size.cast("long"), "_n_dropped": F.size(lost_at).cast("long")}
    return unpacked(met, docs.columns, text=F.array_join(kept, "\n"), **counts)


ORACLE_SQL = r"""
WITH lines AS (
  SELECT doc_id, text, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
    generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
keyed AS (
  SELECT doc_id, pos, line, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines),
common AS (
  SELECT key, max(doc_id) AS last FROM keyed WHERE length(key) >= 20
  GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
judged AS (
  SELECT k.doc_id, k.pos, k.line, c.key IS NOT NULL AND k.doc_id <> c.last AS lost
  FROM keyed k LEFT JOIN common c ON k.key = c.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE lost) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT lost), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""
