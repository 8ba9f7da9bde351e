import random
import re

import pytest
import xxhash

from fleetpulse.llm import queries, simhash
from fleetpulse.llm.common import components, prepare


def plain_print(text, k=3):
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_groups(pairs):
    """Smallest id reachable over fingerprints that differ in at most two bits."""
    ids, prints = [i for i, _ in pairs], [p for _, p in pairs]
    group = list(range(len(pairs)))

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for i in range(len(pairs)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 2:
                group[root(i)] = root(j)
    least = {}
    for i, d in enumerate(ids):
        r = root(i)
        least[r] = min(d, least.get(r, d))
    return sorted((d, f"{p:016x}", least[root(i)]) for i, (d, p) in enumerate(zip(ids, prints)))


def test_fingerprint(prose):
    for text in [None, "", " \t\n", "One", "one TWO", "é\x85b c\x0bd", " ".join(prose(300))]:
        assert simhash.fingerprint(text and text.encode()) == plain_print(text)


def test_query_against_brute_force(spark, tmp_path, documents, prose):
    base = prose(400, 1, rare=True)
    r = random.Random(5)
    texts = [None, "", " \n", "a", "A", "b c"]
    for n in range(60):
        copy = list(base)
        for _ in range(n % 6):
            copy[r.randrange(len(copy))] = "changed%d" % r.randrange(99)
        texts.append(" ".join(copy))
    texts += [" ".join(prose(80, s, rare=True)) for s in range(40)]
    df = documents(texts).withColumnRenamed("n_chars", "fp")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    found = queries.op3_simhash_near_dedup(spark, str(tmp_path))
    assert sorted(map(tuple, found.collect())) == plain_groups([(i, plain_print(t)) for i, t in enumerate(texts)])


@pytest.mark.parametrize("paired", [0, 3, 1000])
def test_links_connect_like_all_pairs(spark, paired):
    r = random.Random(paired)
    centers = [r.getrandbits(64) for _ in range(6)]
    prints = {c ^ sum(1 << b for b in r.sample(range(64), r.randrange(5))) for c in centers for _ in range(80)}
    signed = {p: p - (1 << 64) if p >> 63 else p for p in prints}
    df = spark.createDataFrame([(v,) for v in signed.values()], "fp long")
    linked = dict(components(simhash.links(df, paired=paired), "t").collect())
    order = sorted(prints, key=signed.get)
    expected = plain_groups([(signed[p], p) for p in order])
    assert sorted((linked.get(v, v), v) for v in signed.values()) == sorted((c, i) for i, _, c in expected)


def test_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(300)], "a long, b long")
    assert {c for _, c in components(edges, "t").collect()} == {0}


def test_other_distances(spark):
    df = spark.createDataFrame([(0,), (7,), (15,), (-1,)], "fp long")
    assert sorted(map(tuple, simhash.links(df, max_distance=3, blocks=6).collect())) == [(0, 7), (7, 15)]


def test_drop_keeps_one_of_each_group(spark, documents, prose):
    a, b = " ".join(prose(50, 1, rare=True)), " ".join(prose(50, 2, rare=True))
    df = documents([(5, a), (3, a), (3, a), (None, a), (9, b), (9, b), (None, "x y"), (None, "x y"), (7, None), (8, "")])
    kept = simhash.drop_near_duplicates(df)
    assert kept.columns == df.columns
    assert sorted(((r.doc_id or 0, r.text) for r in kept.collect()), key=repr) == sorted([(3, a), (9, b), (0, "x y"), (7, None)], key=repr)


def test_empty_table(spark, documents):
    assert simhash.near_duplicates(documents([])).collect() == []
    assert simhash.drop_near_duplicates(documents([])).collect() == []


def test_prepare_sets_batches(spark):
    prepare(spark)
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "512"
