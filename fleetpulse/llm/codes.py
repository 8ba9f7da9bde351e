"""Vector code compression: parts of vectors as indexes of codebook entries, in whole numbers throughout."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetpulse.llm.common import join_unique, packed, stored, unpacked

PARTS, ENTRIES, ROUNDS = 16, 64, 2
# A component x counts as floor(SCALE * x).
SCALE = 256
# Components times padded part length up to which all sums of squares fit 64 bits; beyond it Python's whole numbers do.
NARROW = 1 << 28
# Doubles of at least this size are whole numbers.
WHOLE = 2.0**52
# Sums leave the tasks in digits of this many bits, which decimal sums add exactly.
DIGIT_BITS = 40
LONGEST = 2**63 - 1


def usable(vector: Column) -> Column:
    """Not NULL, and all components finite numbers."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(math.inf))
    return vector.isNotNull() & F.forall(vector, finite)


def whole_numbers(vectors: pa.Array, width: int) -> np.ndarray:
    """Rows of ``width`` whole numbers, zero after the vector's end: 64-bit ones, or Python's where those are too short."""
    values, sizes = np.asarray(vectors.flatten(), np.float64), np.asarray(vectors.value_lengths(), np.int64)
    if np.abs(values).max(initial=0) < WHOLE / SCALE:
        scaled = np.floor(SCALE * values).astype(np.int64)
    else:
        exact = [SCALE * int(x) if abs(x) >= WHOLE else math.floor(SCALE * x) for x in values.tolist()]
        scaled = np.array(exact, object)
    out = np.zeros((len(vectors), width), scaled.dtype)
    if len(values):
        row = np.repeat(np.arange(len(sizes)), sizes)
        out[row, np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = scaled
    return out


def _sequency(n: int) -> np.ndarray:
    """Natural index of each Walsh function, by its number of sign changes."""
    gray = np.arange(n) ^ (np.arange(n) >> 1)
    back = np.zeros(n, np.int64)
    for bit in range(n.bit_length() - 1):
        back = (back << 1) | (gray >> bit & 1)
    return back


def walsh(rows: np.ndarray) -> np.ndarray:
    """Walsh-Hadamard transform of the rows, padded with zeros to a power of two; columns in sequency order."""
    n = 1 << max(0, rows.shape[1] - 1).bit_length()
    x = np.zeros((len(rows), n), rows.dtype)
    x[:, : rows.shape[1]] = rows
    step = 1
    while step < n:
        x = x.reshape(len(rows), n // (2 * step), 2, step)
        x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], axis=2)
        step *= 2
    return x.reshape(len(rows), n)[:, _sequency(n)]


def nearest(x: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of each row's nearest entry, ties to the lower one, and the squared distance; both sides ``walsh``-transformed.

    The transform multiplies every squared distance by its length n, so sums of squared differences over its
    columns, in sequency order, only grow towards n times the distance. An entry whose sum has passed
    a distance that some entry reaches can't be nearest and is left out of the further columns.
    """
    n = x.shape[1]
    first = (x[:, :1] - e[:, 0]) ** 2
    reached = ((x - e[first.argmin(axis=1)]) ** 2).sum(axis=1)
    rows, at = np.nonzero(first <= reached[:, None])
    so_far = first[rows, at]
    for k in range(1, n):
        so_far = so_far + (x[rows, k] - e[at, k]) ** 2
        open_ = np.flatnonzero(so_far <= reached[rows])
        rows, at, so_far = rows[open_], at[open_], so_far[open_]
    begins = np.searchsorted(rows, np.arange(len(x)))
    least = np.minimum.reduceat(so_far, begins) if len(x) else so_far
    best = np.flatnonzero(so_far == least[rows])
    first_best = best[np.searchsorted(rows[best], np.arange(len(x)))]
    return at[first_best], least // n


@dataclass(frozen=True)
class Codebooks:
    """Entries of every part: parts x entries x components, as Python's whole numbers."""

    entries: np.ndarray

    @property
    def width(self) -> int:
        return self.entries.shape[0] * self.entries.shape[2]

    @property
    def sha256(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()

    def assign(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Indexes (a column per part) and squared distances of rows of whole numbers."""
        parts, _, size = self.entries.shape
        most = max(int(np.abs(a).max(initial=0)) for a in (vectors, self.entries))
        narrow = most * 2 * max(1, size) <= NARROW
        kind = np.int64 if narrow else object
        vectors, books = vectors.astype(kind), self.entries.astype(kind)
        index, error = np.empty((len(vectors), parts), np.int64), np.empty((len(vectors), parts), kind)
        for p in range(parts):
            own = vectors[:, p * size : (p + 1) * size]
            index[:, p], error[:, p] = nearest(walsh(own), walsh(books[p]))
        return index, error


def _digits(value: int) -> list[int]:
    """A whole number as signed digits, the lowest first."""
    out, sign, rest = [], -1 if value < 0 else 1, abs(value)
    while rest or not out:
        out.append(sign * (rest & ((1 << DIGIT_BITS) - 1)))
        rest >>= DIGIT_BITS
    return out


def _sums(kept: DataFrame, books: Codebooks) -> dict[tuple[int, int, int], int]:
    """Per (part, entry, position) the sum of the components assigned there; position -1 counts them.

    A task adds up all its rows first and gives a row per entry and position, which Spark adds up.
    What reaches the driver has the size of the codebooks.
    """
    shared = kept.sparkSession.sparkContext.broadcast(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = shared.value
        parts, entries, size = books.entries.shape
        total = np.zeros((parts, entries, size + 1), object)
        for batch in batches:
            vectors = whole_numbers(batch.column("vector"), books.width)
            index, _ = books.assign(vectors)
            for p in range(parts):
                sums = np.zeros((entries, size + 1), vectors.dtype)
                np.add.at(sums[:, :size], index[:, p], vectors[:, p * size : (p + 1) * size])
                sums[:, size] = np.bincount(index[:, p], minlength=entries)
                total[p] += sums
        told = [
            (p, e, -1 if k == size else k, d, digit)
            for p, e in zip(*np.nonzero(total[:, :, size]))
            for k in range(size + 1)
            for d, digit in enumerate(_digits(int(total[p, e, k])))
        ]
        columns = [pa.array([r[i] for r in told], kind) for i, kind in enumerate([pa.int32()] * 4 + [pa.int64()])]
        yield pa.RecordBatch.from_arrays(columns, ["part", "entry", "position", "digit", "value"])

    told = kept.select("vector").mapInArrow(run, "part int, entry int, position int, digit int, value bigint")
    place = ["part", "entry", "position"]
    added = told.groupBy(*place, "digit").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value"))
    out: dict[tuple[int, int, int], int] = {}
    for r in added.collect():
        key = (r["part"], r["entry"], r["position"])
        out[key] = out.get(key, 0) + (int(r["value"]) << (DIGIT_BITS * r["digit"]))
    return out


def _kept(rows: DataFrame) -> DataFrame:
    return rows.select("vec_id", F.col("embedding").cast("array<double>").alias("vector")).where(usable(F.col("vector")))


def fit(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> Codebooks:
    """Codebooks of the usable vectors of ``rows`` (``vec_id``, ``embedding``), from all of them in every round.

    They start as the vectors of the smallest vec_ids (NULL ids last, equal ids by their vectors), of which
    there may be fewer than ``entries``. Vectors are cut after the longest one: its length, rounded
    up to a multiple of ``parts``, holds for all, and shorter vectors end in zeros.
    """
    kept = _kept(rows)
    length = kept.agg(F.max(F.size("vector"))).first()[0] or 0
    size = max(1, math.ceil(length / parts))
    first = kept.orderBy(F.col("vec_id").asc_nulls_last(), "vector").limit(entries).select("vector").collect()
    start = whole_numbers(pa.array([r["vector"] for r in first], pa.list_(pa.float64())), parts * size).astype(object)
    books = Codebooks(start.reshape(len(first), parts, size).transpose(1, 0, 2))
    for _ in range(rounds if len(first) else 0):
        sums = _sums(kept, books)
        moved = books.entries.copy()
        for (p, e, k), value in sums.items():
            if k >= 0:
                moved[p, e, k] = value // sums[p, e, -1]
        books = Codebooks(moved)
    return books


def encode(rows: DataFrame, books: Codebooks) -> DataFrame:
    """The rows with a usable ``embedding``, all columns, plus ``_code`` (an index per part) and ``_error``.

    ``_error`` is the squared distance to the coded vector, in scaled whole numbers.

    * Rows whose vector is NULL or holds NULL or non-finite components are dropped.
    * Every row is coded by itself: repeated rows and equal ids alike, an empty vector as zeros.
    * All arithmetic is in whole numbers, of Python where 64 bits are too short. An error that no long
      holds is NULL. A vector longer than those the codebooks were fitted to has no code: NULL, NULL.
    * An empty table gives no rows.
    """
    shared = rows.sparkSession.sparkContext.broadcast(books)

    def code(vectors: pa.Array) -> pa.Array:
        books = shared.value
        fits = np.asarray(vectors.value_lengths()) <= (books.width if books.entries.size else -1)
        codes: list = [None] * len(vectors)
        errors: list = [None] * len(vectors)
        if fits.any():
            index, error = books.assign(whole_numbers(vectors.filter(pa.array(fits)), books.width))
            for i, c, e in zip(np.flatnonzero(fits).tolist(), index.tolist(), error.sum(axis=1).tolist()):
                codes[i], errors[i] = c, e if e <= LONGEST else None
        return pa.StructArray.from_arrays([pa.array(codes, pa.list_(pa.int32())), pa.array(errors, pa.int64())], names=["code", "error"])

    coded = F.arrow_udf(code, "struct<code: array<int>, error: bigint>")
    own = packed(rows, vector=F.col("embedding").cast("array<double>")).where(usable(F.col("vector")))
    told = own.select("row", coded("vector").alias("told"))
    return unpacked(told, rows.columns, _code=F.col("told.code"), _error=F.col("told.error"))


def decoded(code: Column, books: Codebooks) -> Column:
    """The vector that a code stands for, in scaled whole numbers; for codebooks whose entries fit longs."""
    entries = [F.array(*[F.array(*[F.lit(int(x)) for x in entry]) for entry in part]) for part in books.entries]
    return F.flatten(F.array(*[part[code[p]] for p, part in enumerate(entries)]))


def label_errors(coded: DataFrame, by: str = "label") -> DataFrame:
    """Coded rows with ``_label_error``: the errors of equal labels, NULLs together; NULL if no long holds it."""
    rows = packed(coded, by=F.col(by), error=F.col("_error"))
    sums = rows.groupBy("by").agg(F.sum(F.col("error").cast("decimal(38,0)")).alias("total"), F.count_if(F.col("error").isNull()).alias("open"))
    total = F.when((F.col("open") == 0) & (F.col("total") <= LONGEST), F.col("total").cast("bigint"))
    met = join_unique(rows, sums.select("by", total.alias("total")), ["by"], "left")
    return unpacked(met, coded.columns, _label_error=F.col("total"))


def compress(rows: DataFrame, label: str = "vector-codes") -> tuple[DataFrame, Codebooks]:
    """``fit`` and ``encode`` of the same rows; the coded ones are a table in the shared folder."""
    books = fit(rows)
    return stored(encode(rows, books), label), books


def _round_sql(k: int) -> str:
    """Assignment to the entries ``book{k}``, and the entries after it."""
    return f"""
near{k} AS (
  SELECT r, p, arg_min(e, (d, e)) AS e, min(d) AS d
  FROM (SELECT r, p, e, list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d
    FROM parts JOIN book{k} USING (p))
  GROUP BY r, p),
sums{k} AS (
  SELECT p, e, i, sum(x[i])::BIGINT AS s, count(*) AS n
  FROM near{k} JOIN parts USING (r, p), range(1, (SELECT max(len(x)) + 1 FROM parts)) t(i) GROUP BY p, e, i),
book{k + 1} AS (
  SELECT b.p, b.e, coalesce(m.c, b.c) AS c
  FROM book{k} b LEFT JOIN (SELECT p, e, list((s - ((s % n) + n) % n) // n ORDER BY i) AS c FROM sums{k} GROUP BY p, e) m USING (p, e))"""


ORACLE_SQL = f"""
WITH kept AS MATERIALIZED (
  SELECT vec_id, label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v, row_number() OVER (ORDER BY vec_id) AS r
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS MATERIALIZED (
  SELECT r, p, list_slice(v, p * len(v) // {PARTS} + 1, (p + 1) * len(v) // {PARTS}) AS x FROM kept, range({PARTS}) t(p)),
book0 AS (SELECT p, r - 1 AS e, x AS c FROM parts WHERE r <= {ENTRIES}),{",".join(_round_sql(k) for k in range(ROUNDS + 1))},
coded AS (
  SELECT r, string_agg(printf('%02x', e), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM near{ROUNDS} GROUP BY r),
said AS (
  SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM book{ROUNDS})
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256
FROM kept JOIN coded USING (r), said
"""
