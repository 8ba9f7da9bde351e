"""Embedding near-dedup: int8 tile products with error bounds, full precision where they leave doubt."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetpulse.llm.common import components, join_unique, stored

THRESHOLD = 0.93
# Rows of a tile, on average: two tiles and their product fit a task.
TILE = 2048
LEVELS = 127
# Room for the rounding of the double-precision sums that the bounds are made of.
SLACK = 1e-9
_CHUNK = 1 << 16


def quantise(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Int8 codes of unit rows, their scales, and the length of what the codes leave out of each row."""
    scale = np.maximum(np.abs(unit).max(axis=1, initial=0), np.finfo(float).tiny) / LEVELS
    codes = np.rint(unit / scale[:, None]).astype(np.int8)
    error = np.sqrt(np.square(unit - codes * scale[:, None]).sum(axis=1))
    return codes, scale, error


def tile_links(left: pd.DataFrame, right: pd.DataFrame, threshold: float, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Positions (i, j) of the pairs of two tiles whose cosine is at least the threshold.

    With x = sq + e for the unit rows, x.y differs from the product of the codes by at most
    |e1| (|s2q2| + |e2|) + |s1q1| |e2|, and |sq| <= 1 + |e|. A pair beyond the threshold by more
    than that is decided; the others are computed again in double precision. The product of
    the codes is exact: its terms are whole numbers and its sum stays below 2^24 in up to 1,040 dimensions,
    and beyond that it is done in double precision.
    """
    units = [np.frombuffer(b"".join(t["unit"]), np.float64).reshape(len(t), -1) for t in (left, right)]
    codes, scales, errors = zip(*[quantise(u) for u in units])
    exact = np.float32 if units[0].shape[1] * LEVELS**2 < 1 << 24 else np.float64
    a, b = (c.astype(exact) for c in codes)
    found = []
    step = max(1, (1 << 22) // max(1, len(b)))
    for k in range(0, len(a), step):
        about = (a[k : k + step] @ b.T).astype(np.float64) * scales[0][k : k + step, None] * scales[1]
        e1, e2 = errors[0][k : k + step, None], errors[1]
        doubt = e1 * (1 + 2 * e2) + (1 + e1) * e2 + SLACK
        i, j = np.nonzero(about + doubt >= threshold)
        if same:
            i, j = i[k + i < j], j[k + i < j]
        sure = about[i, j] - doubt[i, j] >= threshold
        for c in range(0, len(i), _CHUNK):
            open_ = np.flatnonzero(~sure[c : c + _CHUNK]) + c
            sure[open_] = np.einsum("ij,ij->i", units[0][k + i[open_]], units[1][j[open_]]) >= threshold
        found.append((k + i[sure], j[sure]))
    return tuple(np.concatenate([np.empty(0, np.int64), *x]) for x in zip(*found)) if found else (np.empty(0, np.int64),) * 2


def _least_reachable(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each of n nodes the least node it reaches over the links of one pair of tiles."""
    least = np.arange(n)
    while True:
        before = least.copy()
        low = np.minimum(least[i], least[j])
        np.minimum.at(least, i, low)
        np.minimum.at(least, j, low)
        least = least[least]
        if (least == before).all():
            return least


def _pair(threshold: float):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        i, j = rows["i"].iloc[0], rows["j"].iloc[0]
        left = rows[rows["tile"] == i].reset_index(drop=True)
        right = left if i == j else rows[rows["tile"] == j].reset_index(drop=True)
        empty = pd.DataFrame({"node": pd.Series(dtype="int64"), "hub": pd.Series(dtype="int64"), "links": pd.Series(dtype="int64")})
        if left.empty or right.empty:
            return empty
        a, b = tile_links(left, right, threshold, i == j)
        both = left if i == j else pd.concat([left, right], ignore_index=True)
        b = b if i == j else b + len(left)
        links = np.bincount(a, both["copies"].to_numpy()[b], len(both)) + np.bincount(b, both["copies"].to_numpy()[a], len(both))
        nodes = both["node"].to_numpy()
        order = np.argsort(nodes)
        place = np.empty_like(order)
        place[order] = np.arange(len(order))
        hubs = nodes[order][_least_reachable(len(both), place[a], place[b])][place]
        linked = links > 0
        return pd.DataFrame({"node": nodes[linked], "hub": hubs[linked], "links": links[linked].astype(np.int64)})

    return run


def unit_vectors(rows: DataFrame) -> DataFrame:
    """(vec_id, label, unit): unit vectors as bytes of doubles; NULL for those that link with nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            units = []
            for label, values in zip(batch.column("label").to_pylist(), batch.column("embedding")):
                vector = None if label is None or values.as_py() is None else values.values
                if vector is None or vector.null_count or not len(vector):
                    units.append(None)
                    continue
                x = np.asarray(vector, np.float64)
                top = np.abs(x).max()
                if not np.isfinite(x).all() or not top:
                    units.append(None)
                    continue
                x = x / top  # so that squares neither overflow nor vanish
                units.append((x / math.sqrt(float(x @ x))).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array(units, pa.binary())], ["vec_id", "label", "unit"])

    kind = rows.schema["label"].dataType.simpleString()
    narrow = rows.select(F.col("vec_id").cast("long").alias("vec_id"), "label", F.col("embedding").cast("array<double>").alias("embedding"))
    return narrow.mapInArrow(run, f"vec_id long, label {kind}, unit binary")


def near_duplicates(rows: DataFrame, threshold: float = THRESHOLD, tile: int = TILE) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row, from ``vec_id``, ``embedding``, ``label``.

    Vectors are compared with those of the same label and length.

    1. Rows with the same direction (equal unit vectors) and label are one node that counts its copies.
    2. The nodes of a label are dealt to tiles by hash. Each pair of tiles is one task, whatever the
       size of the label: int8 products, bounds, and full precision for what is open.
    3. A task gives one row per linked node: how many vectors it links to there, and the least
       node it reaches there. So a group of near copies costs its nodes, not its pairs.

    * NULL labels, and vectors that are NULL, empty, zero or hold NULL, NaN or infinite components,
      link with nothing: n_links 0, component_id their own vec_id, kept.
    * A NULL vec_id is a vector like others but never the smallest: component_id is NULL, and kept is
      false, only where no linked vector has an id.
    * Repeated rows, and rows that share a vec_id, are vectors of their own that link to each other
      by cosine. Other columns are ignored. An empty table gives no rows.
    """
    vectors = stored(unit_vectors(rows), "vectors")
    node = F.xxhash64("label", "unit").alias("node")
    known = vectors.where("unit IS NOT NULL").select("vec_id", "label", "unit", node)
    nodes = known.groupBy("label", "unit", "node").agg(F.count("*").alias("copies"), F.min("vec_id").alias("first"))
    nodes = stored(nodes.withColumn("size", F.length("unit")), "vector-nodes")
    groups = nodes.groupBy("label", "size").agg(F.ceil(F.count("*") / F.lit(tile)).cast("int").alias("tiles"))
    dealt = join_unique(nodes, groups, ["label", "size"]).withColumn("tile", F.pmod(F.hash("node"), F.col("tiles")))
    turns = F.transform(
        F.sequence(F.lit(0), F.col("tiles") - 1),
        lambda t: F.struct(F.least(t, F.col("tile")).alias("i"), F.greatest(t, F.col("tile")).alias("j")),
    )
    sent = dealt.select("label", "size", "node", "copies", "unit", "tile", F.explode(turns).alias("turn")).select("*", "turn.*").drop("turn")
    told = stored(sent.groupBy("label", "size", "i", "j").applyInPandas(_pair(threshold), "node long, hub long, links long"), "vector-links")
    linked = components(told.select(F.col("node").alias("a"), F.col("hub").alias("b")), "vector-components")
    links = told.groupBy("node").agg(F.sum("links").alias("links"))
    found = join_unique(nodes.select("node", "copies", "first"), links, ["node"], "left")
    found = join_unique(found, linked, ["node"], "left").withColumn("component", F.coalesce("component", "node"))
    found = stored(found.select("node", "first", "component", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")), "vector-found")
    least = found.groupBy("component").agg(F.min("first").alias("component_id"))
    named = join_unique(found.select("node", "n_links", "component"), least, ["component"]).drop("component")
    own = vectors.select("vec_id", F.when(F.col("unit").isNotNull(), node).alias("node"))
    met = join_unique(own, named, ["node"], "left")
    component = F.when(F.col("n_links") > 0, F.col("component_id")).otherwise(F.col("vec_id"))
    kept = F.coalesce(F.col("vec_id") == component, F.col("n_links").isNull() | (F.col("n_links") == 0))
    return met.select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), kept.alias("kept")
    )
