import math
import random

import numpy as np
import pytest

from fleetpulse.llm import embeddings, queries


def usable(v):
    return v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v) and any(v)


def plain(rows, threshold=0.93):
    n = len(rows)
    links, group = [0] * n, list(range(n))

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for i in range(n):
        for j in range(i):
            (_, a, la), (_, b, lb) = rows[i], rows[j]
            if la is None or la != lb or not usable(a) or not usable(b) or len(a) != len(b):
                continue
            x, y = np.array(a, float), np.array(b, float)
            if x @ y / math.sqrt((x @ x) * (y @ y)) >= threshold:
                links[i] += 1
                links[j] += 1
                group[root(i)] = root(j)
    least = {}
    for i, (v, _, _) in enumerate(rows):
        least[root(i)] = min(v, least.get(root(i), v))
    return sorted((v, links[i], least[root(i)], v == least[root(i)]) for i, (v, _, _) in enumerate(rows))


def cases():
    r = random.Random(4)
    rows = []
    for n in range(260):
        center = random.Random(n % 9)
        v = [center.gauss(0, 1) for _ in range(24)]
        noise = r.choice([0, 0, 0.2, 0.3, 0.4, 0.6])
        rows.append([x + r.gauss(0, noise) for x in v])
    rows += [[2.5 * x for x in rows[0]], [0.0] * 24, None, [], [None] + [1.0] * 23, [float("nan")] * 24, [float("inf")] + [1.0] * 23, [1.0, 2.0], [1.0, 2.1]]
    rows += [[1e-40] * 24, [3e38] * 24, [1e30] * 24]
    order = r.sample(range(1000), len(rows))
    rows = [(order[n], [None if x is None else float(np.float32(x)) for x in v] if v is not None else None, None if n % 50 == 49 else n % 3) for n, v in enumerate(rows)]
    return rows


@pytest.mark.parametrize("tile", [7, 60])
def test_against_brute_force(spark, tile):
    rows = cases()
    df = spark.createDataFrame([(*r, 5) for r in rows], "vec_id long, embedding array<float>, label int, node int")
    found = embeddings.near_duplicates(df, tile=tile).collect()
    assert sorted(map(tuple, found)) == plain(rows)


def test_query(spark, tmp_path):
    rows = cases()
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    assert sorted(map(tuple, queries.op8_embedding_near_dedup(spark, str(tmp_path)).collect())) == plain(rows)


def test_repeated_and_nameless_rows(spark):
    rows = [(3, [1.0, 0.0], 1), (3, [1.0, 0.0], 1), (2, [1.0, 0.01], 1), (None, [1.0, 0.0], 1), (None, [0.0, 1.0], 1), (None, [1.0, 1.0], 2), (None, [1.0, 1.0], 2)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    found = sorted(map(tuple, embeddings.near_duplicates(df).collect()), key=repr)
    expected = [(3, 3, 2, False), (3, 3, 2, False), (2, 3, 2, True), (None, 3, 2, False), (None, 0, None, True), (None, 1, None, False), (None, 1, None, False)]
    assert found == sorted(expected, key=repr)


def test_bounds_hold():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 64)) * rng.choice([1, 1, 30], size=(300, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    codes, scale, error = embeddings.quantise(x)
    about = (codes.astype(float) @ codes.T.astype(float)) * scale[:, None] * scale
    doubt = error[:, None] * (1 + 2 * error) + (1 + error[:, None]) * error
    assert (np.abs(about - x @ x.T) <= doubt + embeddings.SLACK).all()


def test_empty_table(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert embeddings.near_duplicates(df).collect() == []
