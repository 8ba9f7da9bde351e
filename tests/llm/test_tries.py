"""The conversation trie against plain Python, with blocks, shards and cuts of every size."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from fleetpulse.llm import queries, tries

SCHEMA = "conv_id long, turn long, role string, text string, depth string, keys int"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def rebuilt(rows, family=20, heads=4):
    convs = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            key = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()[:32]
            convs.setdefault(conv, []).append(((turn is not None, turn or 0, key), (role, text)))
    convs = {c: [t for _, t in sorted(v)] for c, v in convs.items()}
    out = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % heads
        base = c - (c % family if c >= 0 else -(-c % family))
        out[c] = convs.get(base, [])[:h] + own[h:]
    return out


def plain(sequences):
    """Brute force: the rows of all nodes."""
    nodes = {}
    for c, s in sequences.items():
        for d in range(len(s) + 1):
            nodes.setdefault(tuple(s[:d]), []).append(c)
    below = {k: 0 for k in nodes}
    for k in nodes:
        if k:
            below[k[:-1]] += 1
    leaves, saved = dict.fromkeys(nodes, 0), dict.fromkeys(nodes, 0)
    for k, members in nodes.items():
        own = (len(members) - 1) * len(k[-1][1].split()) if k else 0
        for d in range(len(k) + 1):
            leaves[k[:d]] += below[k] == 0
            saved[k[:d]] += own
    ends = lambda k: ",".join(str(c) for c in sorted(nodes[k]) if len(sequences[c]) == len(k))
    return sorted(
        (
            (min(m), len(k), min(nodes[k[:-1]]) if k else None, len(m), below[k], leaves[k], saved[k], hashlib.sha256(ends(k).encode()).hexdigest())
            for k, m in nodes.items()
        ),
        key=repr,
    )


def found(df):
    assert df.columns == COLUMNS
    return sorted((tuple(r) for r in df.collect()), key=repr)


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA).repartition(5)


def conversations(seed=1, n=120, longest=9):
    r = random.Random(seed)
    say = lambda: (r.choice(["user", "assistant", "system", None]), r.choice(["", None, "a", "b  c", "d\te\nf g", "%d x" % r.randrange(400)]))
    convs = {c: [say() for _ in range(r.randrange(1, longest))] for c in r.sample(range(-50, 400), n)}
    for c in r.sample(sorted(convs), n // 3):
        convs[c] = list(convs[r.choice(sorted(convs))]) + [say()] * r.randrange(2)
    for c in range(1000, 1060):  # copies, and a first turn that many share
        convs[c] = [("user", "hello there you"), ("assistant", "yes"), ("user", "one two three four")] + [("assistant", "x%d" % (c // 3))] * (c % 2)
    rows = [(c, t if r.random() < 0.95 else None, role, text) for c, turns in convs.items() for t, (role, text) in enumerate(turns)]
    rows += rows[:7] + [(None, 1, "user", "no conversation"), (500, 0, "user", "tie b"), (500, 0, "user", "tie a"), (500, None, None, None)]
    r.shuffle(rows)
    return rows


SIZES = [{}, {"block": 4, "shard_turns": 10, "hot_turns": 6}, {"block": 1, "shard_turns": 1, "hot_turns": 0}, {"block": 2, "hot_turns": 1}, {"block": 16, "shard_turns": 30, "hot_turns": 3}]


@pytest.mark.parametrize("sizes", SIZES, ids=str)
def test_against_brute_force(spark, sizes):
    rows = conversations()
    assert found(tries.conversation_trie(table(spark, rows), **sizes)) == plain(rebuilt(rows))


def test_long_conversations(spark):
    r = random.Random(4)
    trunk = [("user", "t%d %s" % (i, "w " * (i % 3))) for i in range(900)]
    convs = {40 * c: trunk[: r.randrange(900)] + [("user", "own %d" % (c % 3))] * r.randrange(90) for c in range(12)} | {4000: trunk, 4040: trunk[:512], 4080: trunk[:64]}
    rows = [(c, t, role, text) for c, turns in convs.items() for t, (role, text) in enumerate(turns)]
    rows += [(5000, 3, "user", "again")] * 700
    expected = plain(rebuilt(rows))
    for sizes in ({}, {"block": 64, "shard_turns": 100, "hot_turns": 50}):
        assert found(tries.conversation_trie(table(spark, rows), **sizes)) == expected


def test_other_families(spark):
    rows = conversations(3, 60)
    assert found(tries.conversation_trie(table(spark, rows), family=7, heads=3)) == plain(rebuilt(rows, 7, 3))
    assert found(tries.conversation_trie(table(spark, rows), family=1, heads=1)) == plain(rebuilt(rows, 1, 1))


def test_query(spark, tmp_path):
    rows = conversations(8)
    table(spark, rows).write.parquet(f"{tmp_path}/conversations.parquet")
    assert found(queries.op12_prefix_trie(spark, str(tmp_path))) == plain(rebuilt(rows))


@pytest.mark.parametrize("rows", [[], [(None, None, None, None)], [(7, None, None, None)], [(c, 0, None, "a") for c in range(1, 8)]])
def test_small_tables(spark, rows):
    expected = plain(rebuilt(rows))
    assert found(tries.conversation_trie(table(spark, rows))) == expected
    assert found(tries.conversation_trie(table(spark, rows), block=1, hot_turns=0)) == expected


def test_ids_of_an_end_in_pieces(spark, monkeypatch):
    ends = [("a", i * 7 - 300) for i in range(900)] + [("b", 5), ("c", 2), ("c", -1)]
    frame = spark.createDataFrame(ends, "end string, conv_id long").repartition(6)
    told = dict(map(tuple, tries.end_hashes(frame).collect()))
    assert told == {e: hashlib.sha256(",".join(str(i) for i in sorted(i for x, i in ends if x == e)).encode()).hexdigest() for e in "abc"}


def test_double_array():
    r = np.random.default_rng(3)
    sequences = {tuple(r.integers(0, 30, r.integers(1, 6)).tolist()) for _ in range(400)} | {(5,), (5, 6)}
    trie = tries.DoubleArray.of([np.array(s) for s in sequences])
    prefixes = {s[:d] for s in sequences for d in range(1, len(s) + 1)}
    slot = {(): 0}
    for p in sorted(prefixes, key=len):
        slot[p] = int(trie.step(np.array([slot[p[:-1]]]), np.array([p[-1]]))[0])
    assert len(set(slot.values())) == len(slot) == (trie.check >= 0).sum() + 1 and -1 not in slot.values()
    for p in list(prefixes)[:200]:
        for c in range(32):
            assert (int(trie.step(np.array([slot[p]]), np.array([c]))[0]) >= 0) == ((*p, c) in prefixes)
    assert len(trie.check) < 2 * len(slot)
