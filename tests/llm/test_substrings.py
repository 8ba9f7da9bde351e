import hashlib
import random
import re

import numpy as np
import pytest

from fleetpulse.llm import queries, substrings


def plain(rows, window):
    """Brute force: every window's words against all windows of documents with a smaller id."""
    texts = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows]
    rank = lambda i: -1 if i is None else i
    least = {}
    for i, w in texts:
        for s in range(len(w) - window + 1):
            k = tuple(w[s : s + window])
            least[k] = min(rank(i), least.get(k, rank(i)))
    out = []
    for i, w in texts:
        lost = set()
        for s in range(len(w) - window + 1):
            if least[tuple(w[s : s + window])] < rank(i):
                lost.update(range(s, s + window))
        kept = " ".join(x for n, x in enumerate(w) if n not in lost)
        out.append((i, len(w), len(lost), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=repr)


def cases(prose, window):
    r = random.Random(3)
    passage = prose(window * 3, 1, rare=True)
    rows = [(100 + s, " ".join(prose(150, s, rare=True))) for s in range(6)]
    for n in range(40):  # parts of one passage, cut and changed in many ways
        a = r.randrange(window * 2)
        part = passage[a : a + r.randrange(max(2, window - 5), window * 2)]
        if n % 3 == 0:
            part = list(part)
            part[r.randrange(len(part))] = "changed"
        rows.append((n * 7 % 50, " ".join([*prose(r.randrange(30), n, rare=True), *part, *prose(r.randrange(30), n + 99, rare=True)])))
    rows += [(60, " ".join(passage)), (61, "\n".join(passage)), (62, " ".join(passage + passage)), (55, " ".join(passage).upper())]
    rows += [(70, None), (71, ""), (72, " \n"), (73, " ".join(passage[:window])), (74, " ".join(passage[: window - 1])), (60, " ".join(passage))]
    rows += [(200, "a " * 400), (201, "a " * 300), (202, "b " * window + "a " * window), (203, "a b " * 200), (204, "b a " * 200)]
    rows += [(None, " ".join(passage[10 : 10 + window])), (2, " ".join(prose(40, 500, rare=True) + passage[5:70]))]
    return rows


def test_query_against_brute_force(spark, tmp_path, documents, prose):
    rows = cases(prose, 50)
    documents(rows).withColumnRenamed("n_chars", "anchor").withColumnRenamed("lang", "row").write.parquet(f"{tmp_path}/documents.parquet")
    found = queries.op10_substring_dedup(spark, str(tmp_path))
    assert sorted(map(tuple, found.collect()), key=repr) == plain(rows, 50)


@pytest.mark.parametrize("window, seed_words", [(8, 3), (5, 5)])
def test_other_windows(spark, documents, prose, window, seed_words):
    rows = [(i, " ".join(prose(120, i)[:90] + prose(30, i % 4))) for i in range(30)] + cases(prose, window)
    found = substrings.drop_substrings(documents(rows), window, seed_words).collect()
    lost = sorted(((r.doc_id, r["_n_words"], r["_n_removed"], hashlib.sha256(r.text.encode()).hexdigest()) for r in found), key=repr)
    assert lost == plain(rows, window)
    assert all(sum(s.end - s.start for s in r["_spans"]) == r["_n_removed"] for r in found)


def test_every_window_has_one_anchor():
    ids = np.random.default_rng(0).integers(0, 5, 400).astype(np.uint64)
    at, first, last = substrings.anchored_runs(ids, 20, 6)
    assert first[0] == 0 and last[-1] == 380 and (first[1:] == last[:-1] + 1).all()
    assert ((at >= last) & (at + 6 <= first + 20)).all()


def test_columns_and_empty_table(spark, documents):
    df = documents([])
    assert substrings.drop_substrings(df).columns == [*df.columns, "_n_words", "_n_removed", "_spans"]
    assert substrings.drop_substrings(df).collect() == []
