"""Keyed streams whose keys share buckets: the answers of a key each, and no more groups than buckets."""

import pytest
from test_alerting import episodes_by_pair
from test_keyed_alerts import EVALUATION, HEALTHY, HEARD, REGISTERED, STALE, STEP, evaluation_rows, files, offline_rules
from test_versions import histories, walk

from fleetpulse.streaming import ack_stream as Q
from fleetpulse.streaming import keyed_alerts as K
from fleetpulse.streaming.rollup_stream import start_append


def run(spark, changes, root):
    """What a stream tells, and how many rows of state it kept at most."""
    query = start_append(changes, f"{root}/table", f"{root}/checkpoint")
    query.awaitTermination()
    kept = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    return spark.read.schema(changes.schema).parquet(f"{root}/table"), max(kept)


def test_alerts(spark, at, tmp_path):
    told = histories(4, agents=9, rows=40)
    stream = files(spark, evaluation_rows(told, at), EVALUATION, tmp_path / "in", 3)
    changes, kept = run(spark, K.alert_changes(stream, buckets=3), tmp_path)
    assert episodes_by_pair(K.episodes(changes).collect(), at) == {p: w for p, s in told.items() if (w := walk(s))}
    assert 0 < kept <= 3 < len(told)


def test_offline(spark, at, tmp_path):
    agents = [(f"agent-{n}", at(-60)) for n in range(40)]
    heard = sorted([(f"agent-{n}", at(60 * n + s)) for n in range(30) for s in (5, 900 * (n % 3))] + [("beacon", at(12_000))], key=lambda h: h[1])
    found = []
    for buckets in (2, 4096):
        root = tmp_path / str(buckets)
        known, beats = files(spark, agents, REGISTERED, root / "agents", 1), files(spark, heard, HEARD, root / "heard", 3)
        changes, kept = run(spark, K.offline_changes(known, beats, offline_rules(spark, at), at(0), STEP, HEALTHY, STALE, "1 second", buckets), root)
        assert kept <= buckets
        found.append(sorted(changes.collect()))
    assert found[0] == found[1] and len({r.agent_id for r in found[0]}) == 40


@pytest.mark.parametrize("parts", [1, 4])
def test_acknowledgements(spark, at, tmp_path, parts):
    happened = [(f"a{n}", Q.FIRING, at(10 * n)) for n in range(30)] + [(f"a{n}", Q.RESOLVED, at(10 * n + 100)) for n in range(0, 30, 2)] + [("end", Q.FIRING, at(9000))]
    asked = [(f"a{n}", s, at(10 * n + d), "u", None) for n in range(35) for s, d in enumerate((-5, 50, 60, 150))]
    inputs = [files(spark, sorted(rows, key=lambda r: r[2]), schema, tmp_path / name, parts) for name, rows, schema in (
        ("a", happened, "alert_id string, kind string, at timestamp"), ("b", asked, "alert_id string, seq int, at timestamp, user string, comment string"))]
    told, kept = run(spark, Q.acknowledgement_decisions(*inputs, "1 hour", buckets=2), tmp_path)
    late = lambda n: Q.OVER if n % 2 == 0 else Q.TAKEN
    reasons = lambda n: [Q.EARLY, None, Q.TAKEN, late(n)] if n < 30 else [Q.UNKNOWN] * 4
    assert sorted((r.alert_id, r.seq, r.reason) for r in told.collect()) == sorted((f"a{n}", s, why) for n in range(35) for s, why in enumerate(reasons(n)))
    assert kept <= 2
