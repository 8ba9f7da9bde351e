import random
from collections import Counter

import corpus_pipeline
import numpy as np
import pytest

from fleetpulse.llm import resemblance


def weights(text, k=5):
    words = (text or "").lower().split()
    return Counter(" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))) if words else Counter()


def similarity(a, b):
    return sum((a & b).values()) / sum((a | b).values()) if a or b else 1.0


def plain(texts):
    """The least place of each group of texts that pairs of similarity 0.8 connect."""
    sets, group = [weights(t) for t in texts], list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if similarity(sets[i], sets[j]) >= 0.8:
                low, high = sorted((group[i], group[j]))
                group = [low if g == high else g for g in group]
    return group


def edited(words, r, n):
    words = list(words)
    for i in range(n):
        words[r.randrange(len(words))] = f"edit{r.randrange(10**9)}"
    return " ".join(words)


@pytest.fixture
def texts(prose):
    r = random.Random(7)
    out = [None, "", " \n", "a", "A", "b c", "yes no " * 20 + "yes", "no yes " * 19 + "no"]
    for n in range(12):
        base = prose(r.choice([30, 100, 400]), n, rare=True)
        out += [" ".join(base), *(edited(base, r, r.randrange(len(base) // 20 + 2)) for _ in range(4))]
    hot = prose(200, 99, rare=True)
    out += [edited(hot, r, r.randrange(8)) for _ in range(45)]
    passage = " ".join(prose(40, 98, rare=True))
    out += [f"{' '.join(prose(80, 200 + n, rare=True))} {passage}" for n in range(40)]
    return out


@pytest.mark.parametrize("paired", [1, 32])
def test_groups_against_all_pairs(spark, documents, texts, paired):
    expected = plain(texts)
    found = {r.doc_id: r.component for r in resemblance.grouped(documents(texts), paired=paired).collect()}
    least = {}
    for i in range(len(texts)):
        least.setdefault(found[i], i)
    assert [least[found[i]] for i in range(len(texts))] == expected
    assert 1 < len(set(expected)) < len(texts)


def test_pipeline_stage_drops_edited_copies(spark, documents, prose):
    r = random.Random(3)
    bases = [prose(n, n, rare=True) for n in (100, 250, 400, 600)]
    rows = [" ".join(b) for b in bases] + [edited(b, r, 1 + len(b) // 100) for b in bases for _ in range(5)]
    kept = corpus_pipeline.simhash_near_dedup(spark, documents(rows), "")
    assert plain(rows) == [*range(4), *(i for i in range(4) for _ in range(5))]
    assert sorted(x.doc_id for x in kept.collect()) == [0, 1, 2, 3]


def test_pipeline_stage_goes_by_simhash_first(spark, documents, prose):
    # The same three shingles twice as often: one fingerprint, but a similarity of a half.
    rows = ["a b c " * 50, "a b c " * 100, " ".join(prose(60, 1, rare=True))]
    assert plain(rows) == [0, 1, 2]
    kept = corpus_pipeline.simhash_near_dedup(spark, documents(rows), "")
    assert sorted(x.doc_id for x in kept.collect()) == [0, 2]


def test_rows_keep_their_texts_in_long_batches(spark, documents, prose):
    rows = [" ".join(prose(20, n % 150, rare=True)) for n in range(300)]
    kept = resemblance.drop_similar(documents(rows).coalesce(1))
    assert sorted((x.doc_id, x.text) for x in kept.collect()) == list(enumerate(rows[:150]))


def test_empty_table(spark, documents):
    assert resemblance.drop_similar(documents([])).collect() == []


def test_most_common_are_cut_by_their_counts(spark):
    often = spark.createDataFrame([(h, 40 + h * h) for h in range(300)], "h long, n long")
    for most in (0, 1, 50, 299, 300, 5000):
        found = resemblance._most_common(often, most)
        assert len(found) <= most and (len(found) >= 0.7 * min(most, 300) or most == 1) and (not len(found) or found.tolist() == list(range(300 - len(found), 300)))


def test_commonest_shingles_stand_last():
    h, order = np.array([1, 2, 3, 4], np.uint64), (np.array([1, 2, 3], np.uint64), np.array([30, 10, 20]))
    assert resemblance._chosen(h, np.array([0, 4]), 0.5, order, False).to_pylist() == [[4, 2, 3]]
    assert resemblance._chosen(h, np.array([0, 4]), 0.5, (order[0][:0], order[1][:0]), False).to_pylist() == [[1, 2, 3]]


def test_every_shingle_is_counted(spark, documents, prose):
    rows = [None, "", "a b", " ".join(prose(40, 1, rare=True)), " ".join(prose(40, 1, rare=True))]
    counts = resemblance._all_shingles(documents(rows), 5).groupBy("h").count().collect()
    assert sorted(r["count"] for r in counts) == [1] + 36 * [2]


@pytest.mark.parametrize("shared, whole", [(range(9), True), ([0], False)])
def test_tiles_connect_what_pairs_do(spark, documents, prose, shared, whole):
    """Edited copies of three texts, which meet at some shingles; a row per text and pair of tiles at most."""
    r = random.Random(5)
    bases = [prose(60, n, rare=True) for n in range(3)]
    texts = [edited(bases[i % 3], r, r.randrange(1, 6)) for i in range(48)]
    docs = documents(texts)
    nothing = np.empty(0, np.uint64), np.empty(0, np.int64)
    rows = resemblance._prefixes(docs, 5, 0.2, nothing, True).select("doc_id", "key", "node", "n")
    nodes = {x.doc_id: x.node for x in rows.collect()}
    met = [(h, nodes[i], 56) for h in shared for i in range(48)] if whole else [(i % 3, nodes[i], 56) for i in range(48)]
    least = {h: min(node for k, node, _ in met if k == h) for h, _, _ in met}
    frame = spark.createDataFrame([(h, node, n, least[h]) for h, node, n in met], "h long, node long, n long, least long")
    links = resemblance.tiled(docs, rows.drop("n"), frame, 0.8, 5, tile=6).collect()
    group = {node: node for node in nodes.values()}
    for a, b in links:
        low, high = sorted((group[a], group[b]))
        group = {n: low if g == high else g for n, g in group.items()}
    least_place = {}
    for i in range(48):
        least_place.setdefault(group[nodes[i]], i)
    assert [least_place[group[nodes[i]]] for i in range(48)] == plain(texts) and len(set(plain(texts))) < 48
    assert len(links) <= 48 * 9 and len(links) == len(set(links))
