import random
import zlib

import numpy as np
import pytest

from fleetpulse.llm import quality, queries


def text(r, grade):
    words = ["w%d" % r.randrange(400) for _ in range(r.randrange(25, 120))]
    if grade == 0:
        words = [w.upper() + "!!" if r.random() < 0.8 else w for w in words]
    if grade == 1:
        for k in r.sample(range(len(words)), 4):
            words[k] = "rude%d" % r.randrange(3)
    return " ".join(words)


@pytest.fixture(scope="module")
def rated():
    r = random.Random(7)
    grades = [r.choice([0, 1, 2, 2, 2]) for _ in range(900)]
    return [(i, text(r, g), g) for i, g in enumerate(grades)]


def test_query_on_held_out_documents(spark, tmp_path, rated):
    docs = [(i, t, "en", "s", 1) for i, t, _ in rated] + [(5000, None, None, None, None), (5001, "", "", "", 0), (None, "w1", "", "", 0), (3, rated[3][1], "", "", 1)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, row string, _tail long").write.parquet(f"{tmp_path}/documents.parquet")
    marks = [(i, int(g > 0), int(g == 1)) for i, _, g in rated] + [(None, 1, 1), (9999, None, 0), (9998, 1, None)]
    spark.createDataFrame(marks, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    found = queries.op2_quality_classifier(spark, str(tmp_path)).collect()
    assert len(found) == len(docs)
    truth = {i: g for i, _, g in rated}
    held = [r for r in found if r.held_out and r.doc_id in truth]
    assert {r.doc_id for r in held} == {i for i in truth if zlib.crc32(str(i).encode()) % 5 == 0}
    assert np.mean([r.selected == (truth[r.doc_id] > 0) for r in held]) > 0.95
    means = [np.mean([r.expected_grade for r in held if truth[r.doc_id] == g]) for g in range(3)]
    assert means[0] + 0.5 < means[1] < means[2] - 0.2
    assert all(0 <= r.tail_probability <= 1 and 0 <= r.expected_grade <= 2 for r in found)


def test_thresholds_rise_and_tails_fall(rated):
    model = quality.fit(np.array([g for *_, g in rated[:300]]), [t.encode() for _, t, _ in rated[:300]], steps=40)
    assert (np.diff(model.thresholds) > 0).all()
    tails = model.tails(model.latent([t.encode() for _, t, _ in rated[300:360]] + [None, b""]))
    assert (np.diff(tails, axis=1) <= 0).all()
    alone = [float(model.latent([t.encode()])[0]) for _, t, _ in rated[300:320]]
    assert np.allclose(model.latent([t.encode() for _, t, _ in rated[300:320]]), alone)


def test_gradient_fits_many_grades():
    r = random.Random(1)
    grades = np.array([r.randrange(5) for _ in range(400)])
    texts = [b" ".join(b"good" if r.random() < g / 5 + 0.1 else b"bad" for _ in range(60)) for g in grades]
    model = quality.fit(grades, texts)
    expected = model.tails(model.latent(texts)).sum(axis=1)
    assert np.corrcoef(expected, grades)[0, 1] > 0.85


def test_selection_keeps_columns(spark, rated):
    model = quality.fit(np.array([g for *_, g in rated[:300]]), [t.encode() for _, t, _ in rated[:300]], steps=60)
    df = spark.createDataFrame([(i, t, "k") for i, t, _ in rated[300:400]], "doc_id long, text string, keep string")
    kept = quality.select(df, model)
    assert kept.columns == df.columns
    assert 0 < kept.count() < 100
    assert quality.select(df.limit(0), model).collect() == []


@pytest.mark.parametrize("grades", [[], [0, 0, 0], [2, 2, 2, 2, 2]])
def test_one_grade_only(spark, grades):
    model = quality.train(spark.createDataFrame([(g, b"some words") for g in grades], "label int, text binary"))
    (p,) = model.tails(model.latent([b"any"]))[:, 0]
    assert (p > 0.5) == (2 in grades) or not grades


def test_shape_is_of_the_whole_word():
    assert quality._shape(b"aB9-\xc3\xa9zz..!") == b"aA9-a.!"
    assert quality._shape(b"a" * 64 + b"9+/") == b"a9+/"
    assert quality._shape(b"") == b""
