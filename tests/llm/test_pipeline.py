"""The pipeline against the operators' brute-force versions, stage by stage."""

import random

import corpus_pipeline
import test_decontaminate
import test_mixing
import test_quality
import test_simhash

from fleetpulse.llm import mixing, quality
from fleetpulse.llm.common import table


def lines_kept(rows):
    strip = " \t\n\x0b\x0c\r"
    key = lambda s: "".join(c.lower() if "A" <= c <= "Z" else c for c in s.strip(strip))
    held = {}
    for i, t in rows.items():
        for line in (t or "").split("\n"):
            held.setdefault(key(line), set()).add(i)
    lost = lambda i, line: len(k := key(line)) >= 20 and len(held[k]) >= 3 and i != max(held[k])
    return {i: "\n".join(x for x in (t or "").split("\n") if not lost(i, x)) for i, t in rows.items()}


def test_pipeline_against_brute_force(spark, tmp_path):
    r = random.Random(11)
    graded = [(i, test_quality.text(r, g), g) for i, g in enumerate(r.choice([0, 1, 2, 2]) for _ in range(500))]
    items = [(n, " ".join("item%d" % r.randrange(90) for _ in range(35))) for n in range(5)]
    rows = {i: t for i, t, _ in graded}
    shared = "The line that many documents share"
    for i in range(0, 500, 9):
        rows[i] += f"\n{shared if i % 2 else shared.upper()}\nw{i} own line"
    for i in range(4, 500, 50):
        rows[i + 500] = rows[i]
    for i in range(2, 500, 60):
        rows[i] += f"\n{items[i % 5][1]}"
    rows |= {2000: None, 2001: "", 2002: " \n ", 2003: shared, 2004: "w1 w2 w3"}
    docs = [(i, t, "en", None if i % 7 == 0 else f"s{i % 4}", len(t or "")) for i, t in rows.items()]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(g > 0), int(g == 1)) for i, _, g in graded], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    found = corpus_pipeline.run(spark, str(tmp_path))
    assert found.columns == ["doc_id", "text", "lang", "source", "n_chars", "_copy"]

    read = table(spark, str(tmp_path), "documents")
    model = quality.train_on(read, table(spark, str(tmp_path), "labels"))
    tails = {i: model.tails(model.latent([(t or "").encode()]))[0, 0] for i, t in rows.items()}
    kept = lines_kept({i: t for i, t in rows.items() if tails[i] >= 0.5})
    groups = test_simhash.plain_groups([(i, test_simhash.plain_print(t)) for i, t in kept.items()])
    kept = {i: kept[i] for i, _, least in groups if i == least}
    judged = test_decontaminate.plain(list(kept.items()), items)
    assert any(hit for _, hit, *_ in judged)
    kept = {i: kept[i] for i, hit, *_ in judged if not hit}
    source = {i: s for i, _, _, s, _ in docs}
    sizes = {}
    for i, t in kept.items():
        sizes[source[i]] = sizes.get(source[i], 0) + len(t.split())
    target = test_mixing.plain_targets(sizes)
    draws = {x.doc_id: x.draw for x in read.select("doc_id", mixing.draw(read.doc_id, read.text).alias("draw")).collect()}
    expected = []
    for i, t in kept.items():
        rate = target[source[i]] / sizes[source[i]]
        for copy in range(1, int(rate) + (draws[i] < rate - int(rate)) + 1):
            expected.append((i, t, source[i], len(t) if rows[i] is not None else 0, copy))
    assert sorted(((x.doc_id, x.text, x.source, x.n_chars, x["_copy"]) for x in found.collect()), key=repr) == sorted(expected, key=repr)


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_nulls_everywhere(spark, tmp_path):
    spark.createDataFrame([(None, None, None, None, None)] * 2, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(None, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(None, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = table(spark, str(tmp_path), "documents")
    for _, stage in corpus_pipeline.STAGES[1:]:
        docs = stage(spark, docs, str(tmp_path))
    assert docs.collect() == []
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
