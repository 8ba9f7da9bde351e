"""Acknowledgements on streams against the batch operator, in any order of arrival."""

import random

import pytest
from test_keyed_alerts import files, run

from fleetpulse.operators import incidents as I
from fleetpulse.streaming import ack_stream as Q

CHANGES = "alert_id string, kind string, at timestamp"
COMMANDS = "alert_id string, seq int, at timestamp, user string, comment string"


def given(seed):
    r = random.Random(seed)
    spans = {f"alert-{k}": (s := r.randrange(0, 5000), r.choice([None, s, s + 10, s + r.randrange(1, 2000)])) for k in range(25)}
    commands = [(f"alert-{r.randrange(32)}", n, r.randrange(0, 7000), r.choice(["", "ann", None]), f"c{n}") for n in range(120)]
    some = [(a, 900 + 2 * k + n, t, "edge", None) for k, (a, ends) in enumerate(spans.items()) for n, t in enumerate(ends) if t is not None]
    return spans, commands + some


def decisions(df):
    return sorted((r.alert_id, r.seq, r.accepted) for r in df.collect())


@pytest.mark.parametrize(("seed", "parts"), [(1, 1), (2, 5)])
def test_stream_equals_batch(spark, at, tmp_path, seed, parts):
    spans, commands = given(seed)
    happened = sorted([(a, Q.FIRING, at(s)) for a, (s, _) in spans.items()] + [(a, Q.RESOLVED, at(e)) for a, (_, e) in spans.items() if e is not None], key=lambda r: r[2])
    happened += [("end", Q.FIRING, at(20_000))]
    asked = sorted([(a, n, at(t), u, c) for a, n, t, u, c in commands], key=lambda r: r[2])
    told = run(spark, Q.acknowledgement_decisions(files(spark, happened, CHANGES, tmp_path / "a", parts), files(spark, asked, COMMANDS, tmp_path / "b", parts), "3 hours"), tmp_path)
    alerts = spark.createDataFrame([(a, at(s), None if e is None else at(e)) for a, (s, e) in spans.items()], "id string, started_at timestamp, resolved_at timestamp")
    frame = spark.createDataFrame(asked, COMMANDS)
    refused = {(r.alert_id, r.seq) for r in I.refused_acknowledgements(alerts, frame).collect()}
    assert decisions(told) == sorted((a, n, (a, n) not in refused) for a, n, *_ in commands)
    named = {r.id: r.acknowledged_by for r in I.acknowledge(alerts.selectExpr("*", "'r' AS rule_id"), frame).collect() if r.acknowledged_by}
    assert {r.alert_id: r.user for r in told.where("accepted").collect()} == named
    assert {r.reason for r in told.where("NOT accepted").collect()} == {Q.UNKNOWN, Q.EARLY, Q.OVER, Q.TAKEN}


def test_unfinished_commands(spark, at, tmp_path):
    happened = [("a", Q.FIRING, at(100)), ("a", "other", at(120)), (None, Q.FIRING, at(100)), ("z", Q.FIRING, at(9000))]
    asked = [("a", 1, at(9500), "x", None), ("a", 3, None, "z", None), ("a", 2, at(300), "y", None), (None, 4, at(300), "z", None)]
    told = Q.acknowledgement_decisions(files(spark, happened, CHANGES, tmp_path / "a", 1), files(spark, asked, COMMANDS, tmp_path / "b", 1), "1 second")
    # The watermark ends at 9,499 s, so the command at 9,500 s is still open.
    assert [(r.seq, r.accepted, r.reason) for r in run(spark, told, tmp_path).collect()] == [(2, True, None)]
