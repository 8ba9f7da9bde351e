"""The rule ledger against plain Python, policies and ablations against the documents themselves."""

import random

import pyarrow as pa
import pytest

from fleetpulse.llm import queries, rules

BLANK = " \t\n\x0b\x0c\r"


def words_of(text):
    out, word = [], ""
    for c in (text or "") + " ":
        if c in BLANK:
            out += [word] if word else []
            word = ""
        else:
            word += c
    return out


def plain(text):
    """Brute force: all measures of a text."""
    text, words = text or "", words_of(text)
    runs = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    covered = {i + k for i, run in enumerate(runs) if runs.count(run) > 1 for k in range(8)}
    lines = [x for x in text.split("\n") if x.strip(BLANK)]
    bare = [x.strip(BLANK) for x in lines]
    letter = lambda c: "a" <= c.lower() <= "z" or ord(c) > 127
    return {
        "n_words": len(words),
        "word_chars": sum(map(len, words)),
        "n_symbols": sum(c in "#*$%&|<>" for c in text),
        "n_repeat_words": len(covered),
        "n_lines": len(lines),
        "n_dup_lines": len(lines) - len(set(lines)),
        "n_bullet_lines": sum(x.startswith(("-", "*", "•", "‣", "▪")) for x in bare),
        "n_cut_lines": sum(x.endswith(("...", "…")) for x in bare),
        "n_letterless": sum(not any(map(letter, w)) for w in words),
    }


def failing(m):
    checks = [
        m["n_words"] < 20,
        100 * m["n_repeat_words"] > 30 * m["n_words"],
        m["n_words"] > 100_000,
        m["word_chars"] < 2 * m["n_words"],
        m["word_chars"] > 12 * m["n_words"],
        10 * m["n_symbols"] > m["n_words"],
        10 * m["n_dup_lines"] > 3 * m["n_lines"],
        10 * m["n_bullet_lines"] > 9 * m["n_lines"],
        10 * m["n_cut_lines"] > 3 * m["n_lines"],
        10 * m["n_letterless"] > 3 * m["n_words"],
    ]
    return sum(c << i for i, c in enumerate(checks))


def keeps(policy, bits):
    return not bits & policy.hard and (bits & policy.soft).bit_count() <= policy.tolerated


def texts():
    r = random.Random(5)
    out = [None, "", " \n\t\x0b\x0c\r", "a", "ä b c", "a b c d e f g h", "a b c d e f g h " * 2, "x " * 30, "- a\n* b\n• c\n - d", "a...\nb…\nc", "# $ % & | < > *"]
    for n in range(60):
        vocabulary = ["w%d" % k for k in range(r.choice([2, 5, 40]))] + ["1", "--", "Ünder", "#tag", "very" * 6, "a..."]
        glue = r.choice([" ", " ", "\n", "  \r\n", "\t"])
        body = glue.join(r.choice(vocabulary) for _ in range(r.randrange(120)))
        out.append("\n".join([body] * r.choice([1, 1, 2, 3])))
    passage = " ".join("p%d" % k for k in range(15))
    return out + [f"{passage} and then {passage}", f"- {passage}\n- {passage}\n- {passage}", *[f"{passage} {' '.join('q%d' % k for k in range(40))}"] * 2]


@pytest.fixture(scope="module")
def rows():
    return [(i if i % 17 else None, t) for i, t in enumerate(texts(), 1)] + [(3, "a"), (3, "a")]


def test_measures_and_bits_against_brute_force(spark, documents, rows):
    docs = documents(rows).withColumnsRenamed({"lang": "measures", "source": "bits", "n_chars": "text_"})
    found = rules.ledger(docs)
    assert found.columns == [*docs.columns, "_measures", "_bits"]
    expected = [(i, t, *plain(t).values(), failing(plain(t))) for i, t in rows]
    got = [(r.doc_id, r.text, *[r._measures[m] for m in plain("")], r._bits) for r in found.collect()]
    assert sorted(got, key=repr) == sorted(expected, key=repr)
    assert len({e[-1] for e in expected}) > 8


def test_long_text_and_parts(monkeypatch, rows):
    monkeypatch.setattr(rules, "PART_BYTES", 300)
    batch = pa.array([t for _, t in rows])
    assert [tuple(r.values()) for r in rules.measure(batch).to_pylist()] == [tuple(r[m] for m in rules.MEASURES) for r in (plain(t) for _, t in rows)]
    part = batch.slice(7, 30)
    assert rules.measure(part).to_pylist() == rules.measure(batch).to_pylist()[7:37]
    long = " ".join(["one two three four five six seven eight nine"] * 60_000)
    assert rules.measure(pa.array([long])).to_pylist()[0] | {"n_lines": 1} == {
        "n_words": 540_000, "word_chars": len(long) - 539_999, "n_symbols": 0, "n_repeat_words": 540_000, "n_lines": 1,
        "n_dup_lines": 0, "n_bullet_lines": 0, "n_cut_lines": 0, "n_letterless": 0,
    }


def test_policies_and_ablations(spark, documents, rows):
    entries = rules.ledger(documents(rows))
    bits = {t: failing(plain(t)) for _, t in rows}
    for policy in rules.POLICIES:
        told = {(r.doc_id, r.text): (r._kept, r._failed) for r in rules.judged(entries, policy).collect()}
        for i, t in rows:
            failed = [r.name for r in rules.RULES if bits[t] >> r.bit & 1 and (policy.hard | policy.soft) >> r.bit & 1]
            assert told[i, t] == (keeps(policy, bits[t]), failed)
    assert rules.select(documents(rows)).count() == sum(keeps(rules.CURRENT, bits[t]) for _, t in rows)
    table = {(r.policy, r.rule): r[2:] for r in rules.ablations(entries).collect()}
    expected = {}
    for p in rules.POLICIES:
        for rule in rules.RULES:
            bit = 1 << rule.bit
            if (p.hard | p.soft) & bit:
                q = rules.Policy(p.version, p.hard & ~bit, p.soft & ~bit, p.tolerated)
                kept = [t for _, t in rows if keeps(q, bits[t])]
                expected[p.version, rule.name] = (
                    len(rows),
                    sum(keeps(p, bits[t]) for _, t in rows),
                    sum(bits[t] & bit != 0 for _, t in rows),
                    sum(bits[t] & (p.hard | p.soft) == bit for _, t in rows),
                    len(kept),
                    sum(len(words_of(t)) for t in kept),
                )
    assert {k: tuple(v) for k, v in table.items()} == expected
    moved = {(r.kept_before, r.kept_after): (r.n_documents, r.any_bits, r.all_bits) for r in rules.drift(entries, *rules.POLICIES[:2]).collect()}
    for key, (n, any_bits, all_bits) in moved.items():
        group = [bits[t] for _, t in rows if (keeps(rules.POLICIES[0], bits[t]), keeps(rules.POLICIES[1], bits[t])) == key]
        low, high = -1, 0
        for b in group:
            low, high = low & b, high | b
        assert (n, any_bits, all_bits) == (len(group), high, low)


def test_stored_ledger_serves_later_policies(spark, documents, rows, tmp_path):
    rules.ledger(documents(rows)).write.parquet(f"{tmp_path}/ledger")
    entries = spark.read.parquet(f"{tmp_path}/ledger")
    later = rules.Policy("later", rules.mask("cut_lines"), rules.BASE, 1)
    assert rules.judged(entries, later).where("_kept").count() == sum(keeps(later, failing(plain(t))) for _, t in rows)
    text = rules.ablations(entries)._jdf.queryExecution().toString()
    assert "Python" not in text


def test_empty_table(spark, documents):
    entries = rules.ledger(documents([]))
    assert rules.judged(entries).collect() == [] and rules.ablations(entries).collect() == []


def test_query_against_brute_force(spark, documents, rows, tmp_path):
    documents(rows).write.parquet(f"{tmp_path}/documents.parquet")
    found = queries.op13_quality_rules(spark, str(tmp_path))
    assert found.columns == ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    expected = []
    for i, t in rows:
        m = plain(t)
        bits = failing(m)
        expected.append((i, *[m[c] for c in found.columns[1:6]], bits & 3 != 0, keeps(rules.CURRENT, bits)))
    assert sorted(map(tuple, found.collect()), key=repr) == sorted(expected, key=repr)
