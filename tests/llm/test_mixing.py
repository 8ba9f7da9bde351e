import math

import pytest

from fleetpulse.llm import mixing, queries


def plain_targets(sizes, cycle=(3, 1, 2), share=1.5, most=2):
    """Reshares what is over the caps, round by round."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: cycle[i % len(cycle)] for i, s in enumerate(order)}
    left, open_, target = share * sum(sizes.values()), set(order), {}
    while open_:
        level = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if level * weight[s] > most * sizes[s]}
        if not over:
            return target | {s: level * weight[s] for s in open_}
        target |= {s: float(most * sizes[s]) for s in over}
        left -= sum(most * sizes[s] for s in over)
        open_ -= over
    return target


SIZES = {"a": 700, "b": 20, "é": 5, "z": 0, None: 40, "Z": 3000, "0": 1}


def frame(spark, sizes, per_doc=1):
    rows = [(i * 10000 + k, " ".join(["w"] * per_doc), s, 7) for i, (s, n) in enumerate(sizes.items()) for k in range(max(1, n // per_doc)) if n]
    rows += [(-1, None, "z", None), (-1, None, "z", None), (None, "", "z", None)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, weight int")


def test_targets_and_rates(spark):
    df = frame(spark, SIZES)
    found = mixing.assign(df)
    assert found.columns == [*df.columns, "_size", "_source_size", "_target", "_copies"]
    rows = found.collect()
    assert len(rows) == df.count()
    expected = plain_targets(SIZES)
    taken = dict.fromkeys(SIZES, 0)
    for r in rows:
        assert r["_source_size"] == SIZES[r.source]
        assert math.isclose(r["_target"], expected[r.source], abs_tol=1e-9)
        assert 0 <= r["_copies"] <= 2
        taken[r.source] += r["_copies"] * r["_size"]
    for s, words in taken.items():
        assert abs(words - expected[s]) <= 4 * math.sqrt(max(1, SIZES[s]) / 4)


def test_mix_repeats_rows(spark, tmp_path):
    df = frame(spark, SIZES)
    copies = {r.doc_id: r["_copies"] for r in mixing.assign(df).where("doc_id >= 0").collect()}
    mixed = mixing.mix(df).where("doc_id >= 0").groupBy("doc_id").count().collect()
    assert {r.doc_id: r["count"] for r in mixed} == {i: n for i, n in copies.items() if n}
    df.write.parquet(f"{tmp_path}/documents.parquet")
    first = sorted(map(tuple, queries.op6_source_mixing(spark, str(tmp_path)).collect()), key=repr)
    assert first == sorted(map(tuple, queries.op6_source_mixing(spark, str(tmp_path)).collect()), key=repr)


def test_many_sources_rank_over_ranges(spark):
    rows = [(f"s{i:05d}", i % 7 + 1) for i in range(5000)]
    sizes = spark.createDataFrame(rows, "source string, source_size long").repartition(7)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        weights = dict(mixing.cyclic_weights(sizes).select("source", "weight").collect())
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert weights == {s: (3.0, 1.0, 2.0)[i % 3] for i, (s, _) in enumerate(rows)}


@pytest.mark.parametrize("rows", [[], [(1, None, None, 1), (2, "", "a", 1)]])
def test_no_words(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, weight int")
    found = mixing.assign(df).collect()
    assert [(r["_target"], r["_copies"]) for r in found] == [(0.0, 0)] * len(rows)
    assert mixing.mix(df).collect() == []


def test_native_plan(spark, documents):
    plan = mixing.mix(documents(["a b", "c"]))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
