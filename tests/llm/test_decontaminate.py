import random
import re
from collections import Counter

import pytest

from fleetpulse.llm import decontaminate, queries


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def shingles(w, k=5):
    return Counter(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else Counter()


def plain(docs, items):
    """Brute force: every item-sized window of every text against every item."""
    least = {}
    for i, t in items:
        if w := tuple(words(t)):
            least[w] = min(i, least.get(w, i))
    out = []
    for d, t in docs:
        w, found, best = words(t), set(), None
        for item, i in least.items():
            b = shingles(list(item))
            for s in range(max(1, len(w) - len(item) + 1)) if w else ():
                a = shingles(w[s : s + len(item)])
                common = sum((a & b).values())
                score = common / (sum(a.values()) + sum(b.values()) - common)
                if score >= 0.8:
                    found.add(i)
                    best = max(best or 0, score)
        out.append((d, bool(found), sorted(found), best))
    return sorted(out, key=repr)


def passage(r, n):
    return ["w%d" % r.randrange(200) for _ in range(n)]


@pytest.fixture
def tables(documents, spark):
    r = random.Random(1)
    items = [(i, " ".join(passage(r, r.choice([30, 30, 31, 45, 60])))) for i in range(12)]
    items += [(20, items[3][1].upper()), (21, None), (22, " "), (23, "three word item"), (24, "la " * 40), (25, items[5][1] + " end")]
    docs = [" ".join(passage(r, 150)) for _ in range(10)]
    for n in range(60):
        item = words(items[n % 12][1])
        for _ in range(n // 12):  # up to four changes: more than that ends below the limit
            item[r.choice([0, 1, len(item) - 1, len(item) // 2])] = "changed%d" % n
        if n % 5 == 0:
            item.insert(r.randrange(len(item)), "inserted")
        if n % 7 == 0:
            item = item[3:] if n % 2 else item[:-4]
        docs.append(" ".join([*passage(r, r.choice([0, 3, 40])), *item, *passage(r, r.choice([0, 2, 50]))]))
    half = words(items[0][1])
    docs += [" ".join(half[15:] + half[:15]), " ".join(half + half), "\n".join(half).title(), None, "", " \t", "three word item", "three word", "x three word item"]
    docs += ["la " * 38, "la " * 100, "LA " * 33, docs[11], items[6][1][:-3] + "x " + items[7][1]]
    return [(i, t) for i, t in enumerate(docs)], items


def test_query_against_brute_force(spark, tmp_path, documents, tables):
    docs, items = tables
    documents(docs).withColumnRenamed("n_chars", "key").withColumnRenamed("lang", "row").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    found = queries.op7_benchmark_decontamination(spark, str(tmp_path)).collect()
    expected = plain(docs, items)
    assert sum(e[1] for e in expected) > 30
    assert sorted((tuple(r) for r in found), key=repr) == expected


def test_columns_stay_and_contaminated_rows_go(spark, documents, tables):
    docs, items = tables
    bench = spark.createDataFrame(items, "item_id long, text string")
    df = documents(docs).withColumnRenamed("source", "_items")
    kept = decontaminate.drop_contaminated(df, bench)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(d for d, hit, *_ in plain(docs, items) if not hit)
    assert decontaminate.judge(df, bench).columns == [*df.columns, "_contaminated", "_similarity"]


def test_empty_tables(spark, documents):
    none = spark.createDataFrame([], "item_id long, text string")
    judged = decontaminate.judge(documents(["a b c"]), none).collect()
    assert [(r["_contaminated"], r["_items"]) for r in judged] == [(False, [])]
    assert decontaminate.judge(documents([]), none).collect() == []


def test_blocks_meet_within_the_radius(spark):
    r = random.Random(2)
    pairs = []
    for _ in range(300):
        a = r.getrandbits(64)
        b = a ^ sum(1 << i for i in r.sample(range(64), decontaminate.RADIUS))
        pairs.append(tuple(x - (1 << 64) if x >> 63 else x for x in (a, b)))
    df = spark.createDataFrame(pairs, "a long, b long")
    from pyspark.sql import functions as F

    met = F.arrays_overlap(decontaminate.blocks(F.col("a"), decontaminate.RADIUS), decontaminate.blocks(F.col("b"), decontaminate.RADIUS))
    assert df.where(met).count() == 300


def test_native_plan(spark, documents):
    bench = spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")
    plan = decontaminate.judge(documents(["a b c d e f g"]), bench)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_fingerprints_of_long_items(spark):
    r = random.Random(8)
    weighed = [(r.getrandbits(64) - (1 << 63), w) for w in (70_000, 66_000, 65_536, 1, 2)]
    df = spark.createDataFrame([(1, 201_539, h, w) for h, w in weighed], "item long, n_words int, h long, weight long")
    (found,) = decontaminate._prints(df, "item", "fp", decontaminate.WIDE_LANES).collect()
    total = sum(w for _, w in weighed)
    assert found.fp % (1 << 64) == sum(1 << b for b in range(64) if 2 * sum(w * (h >> b & 1) for h, w in weighed) > total)
