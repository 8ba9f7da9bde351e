import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from fleetpulse.llm import lm, queries
from fleetpulse.llm.common import fold


def tokens(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", low), "\n"]


def held_out(i):
    return i is not None and zlib.crc32(str(i).encode()) % 10 == 0


def plain(rows):
    """Exact base, and the model with exact levels instead of a filter."""
    learnt = [tokens(t) for i, t in rows if not held_out(i)]
    one = Counter(w for t in learnt for w in t)
    two = Counter(p for t in learnt for p in zip(["\n", *t], t))
    n, v = sum(one.values()), len(one)
    prob = lambda c: (c + 0.1) / (n + 0.1 * (v + 1))
    q = lambda c: float(lm.level_count(lm.level(np.array([c])))[0])
    out = []
    for i, t in rows:
        w = tokens(t)
        base = sum(math.log10(prob(one[x])) for x in w)
        model = 0
        for h, x in zip(["\n", *w], w):
            ch = q(one[h])
            s = 0.6 * ch / (ch + 8)
            model += math.log10((s * min(q(two[h, x]), ch) / ch if ch else 0) + (1 - s) * prob(q(one[x])))
        out.append((i, held_out(i), len(w), sum(one[x] > 0 for x in w), n, round(base, 6), round(model, 6)))
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def rows():
    r = random.Random(2)
    phrases = [" ".join("w%d" % int(r.paretovariate(0.7)) for _ in range(3)) for _ in range(60)]
    words = " ".join(r.choice(phrases) for _ in range(2000)).split()
    rows = [(i, " ".join(words[i * 25 : i * 25 + r.randrange(1, 40)])) for i in range(200)]
    rows += [(1000, None), (1001, ""), (1002, " \n"), (1003, "W1 w1\x0bÉ é"), (None, "w1 w2"), (7, "w3 another text"), (5, rows[5][1]), (1010, "x" * 200_000 + " w1"), (1011, "unseen words only")]
    return rows


def frame(documents, rows):
    return documents(rows).withColumnRenamed("lang", "word").withColumnRenamed("n_chars", "rid")


def rounded(found):
    return sorted(((*r[:5], round(r[5], 6), round(r[6], 6)) for r in found), key=repr)


@pytest.mark.parametrize("most_bytes, hot, section_tokens", [(1 << 26, 50, 1 << 19), (40_000, 3, 300), (1 << 26, 0, 500), (1 << 26, 9, 2)])
def test_against_brute_force(spark, documents, rows, most_bytes, hot, section_tokens):
    """With room enough for no false levels; the second case takes several passes."""
    df = frame(documents, rows)
    found = lm.score(df, fold(F.col("doc_id"), 10) != 0, bits=400, most_bytes=most_bytes, hot_words=hot, section_tokens=section_tokens)
    out = found.select("doc_id", (fold(F.col("doc_id"), 10) == 0).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
    assert rounded(out.collect()) == plain(rows)


def test_query(spark, tmp_path, documents, rows):
    frame(documents, rows).write.parquet(f"{tmp_path}/documents.parquet")
    found = queries.op4_lm_scoring(spark, str(tmp_path)).collect()
    expected = plain(rows)
    assert [r[:6] for r in rounded(found)] == [r[:6] for r in expected]
    close = [abs(a[6] - b[6]) < 1e-6 for a, b in zip(rounded(found), expected)]
    assert np.mean(close) > 0.9
    known = [r for r in found if r.held_out and r.n_tokens > 5]
    assert sum(r.score for r in known) > sum(r.base_score for r in known)


def test_filter_never_tells_too_little():
    rng = np.random.default_rng(0)
    grams = rng.integers(0, 1 << 63, 20_000).astype(np.uint64)
    counts = np.minimum(rng.zipf(1.5, 20_000), 10**6)
    data = lm.build_section(grams, counts, bits=16)
    made = lm.Filter(np.array([0, len(data)]), data, 0, 1)
    found = made.levels(grams)
    assert (found >= lm.level(counts)).all() and (found == lm.level(counts)).mean() > 0.99
    assert (made.levels(rng.integers(0, 1 << 63, 20_000).astype(np.uint64)) > 0).mean() < 0.01


def test_levels():
    assert lm.level(np.array([0, 1, 2, 3, 4, 7, 8])).tolist() == [0, 1, 2, 2, 3, 3, 4]
    assert lm.level_count(np.arange(5)).tolist() == [0, 1, 2.5, 5.5, 11.5]


def test_no_rows_and_nothing_learnt(spark, documents):
    assert lm.score(documents([]), F.lit(True)).collect() == []
    (row,) = lm.score(documents(["a b"]), F.lit(False)).collect()
    assert (row.n_tokens, row.n_known, row.train_tokens) == (3, 0, 0) and abs(row.base_score) < 1e-9 and abs(row.score) < 1e-9


def test_pairs_leave_a_task_in_small_batches():
    """The n-grams of a task, 8 MB here, are sorted in place and sent group by group."""
    rng = np.random.default_rng(1)
    pending = [rng.integers(0, 1 << 20, 1 << 17).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) for _ in range(8)]
    distinct, times = np.unique(np.concatenate(pending), return_counts=True)
    found, groups = {}, []
    for batch in lm._grouped(*lm._counted(pending), 100):
        assert batch.nbytes < 5 << 20
        for name, grams, counts in zip(*[column.to_pylist() for column in batch.columns]):
            groups.append(name)
            grams = np.frombuffer(grams, np.uint64)
            assert (lm.section_of(grams, 100) // lm.GROUP == name).all()
            found |= dict(zip(grams.tolist(), np.frombuffer(counts, "<i8").tolist()))
    assert found == dict(zip(distinct.tolist(), times.tolist())) and len(groups) == len(set(groups)) == 50
    assert pending == [] and list(lm._grouped(*lm._counted([np.empty(0, np.uint64)]), 3)) == []
