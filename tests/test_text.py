import hashlib
import hmac
import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from fleetpulse.functions import conditions as C
from fleetpulse.functions import text as X

TIMES = {
    "2026-08-08T18:00:00Z": datetime(2026, 8, 8, 18),
    "2026-08-08T18:00:00.25Z": datetime(2026, 8, 8, 18, 0, 0, 250000),
    "2026-08-08T18:00:00.123456789Z": datetime(2026, 8, 8, 18, 0, 0, 123456),
    "2026-08-08T18:00:00+02:30": datetime(2026, 8, 8, 15, 30),
    "2026-08-08T18:00:00-23:59": datetime(2026, 8, 9, 17, 59),
    "2026-08-08T18:00:00.5-00:01": datetime(2026, 8, 8, 18, 1, 0, 500000),
    "2026-08-08": None,
    "2026-08-08T18:00:00": None,
    "2026-08-08 18:00:00Z": None,
    "2026-08-08T18:00Z": None,
    "2026-13-08T18:00:00Z": None,
    "2026-08-08T25:00:00Z": None,
    "2026-08-08T18:00:00+24:00": None,
    "2026-08-08T18:00:00z": None,
    "abc": None,
    "": None,
}


def test_rfc3339(spark):
    df = spark.createDataFrame([(t,) for t in TIMES], "t string")
    found = dict(map(tuple, df.select("t", X.rfc3339(F.col("t")).cast("timestamp_ntz")).collect()))
    assert found == TIMES


def test_range_bound():
    moment = datetime(2026, 8, 8, 18, tzinfo=timezone.utc)
    assert C.range_bound("from", "2026-08-08T18:00:00Z") == moment
    assert C.range_bound("from", "2026-08-08T20:30:00+02:30") == moment
    assert C.range_bound("from", "") is None
    for bad in ("2026-08-08", "2026-13-08T18:00:00Z", "x"):
        with pytest.raises(ValueError, match="invalid from"):
            C.range_bound("from", bad)


def test_one_decimal_rounds_the_binary_value(spark):
    rng = random.Random(7)
    values = [80.25, 80.35, 0.05, 0.15, 0.25, -0.04, 1234567.85, 0.0, 99.95, 1e6, -80.25, 2.5, 0.45]
    values += [rng.uniform(-200, 200) for _ in range(500)] + [round(rng.uniform(0, 100), 2) for _ in range(500)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for v, text in df.select("v", X.one_decimal(F.col("v"))).collect():
        assert text == "%.1f" % v


@pytest.mark.parametrize("secret", ["k", "super-secret-key", "x" * 64, "y" * 65, "schlüssel-" * 20])
def test_signature(spark, secret):
    bodies = ["", '{"a":1}', "ünïcode " * 50]
    df = spark.createDataFrame([(secret, b) for b in bodies], "s string, b string")
    pads = df.withColumn("pads", X.hmac_pads(F.col("s")))
    for b, signed in pads.select("b", X.signature(F.col("b"), F.col("pads"))).collect():
        assert signed == "sha256=" + hmac.new(secret.encode(), b.encode(), hashlib.sha256).hexdigest()


def test_no_signature_without_pads(spark):
    df = spark.sql("SELECT 'b' AS b, CAST(NULL AS STRUCT<inner: BINARY, outer: BINARY>) AS pads")
    assert df.select(X.signature(F.col("b"), F.col("pads"))).first()[0] is None


COMPARISONS = [
    (90.0, ">", 80.0, True), (80.0, ">", 80.0, False), (80.0, ">=", 80.0, True), (79.0, ">=", 80.0, False),
    (70.0, "<", 80.0, True), (80.0, "<", 80.0, False), (80.0, "<=", 80.0, True), (81.0, "<=", 80.0, False),
    (80.0, "==", 80.0, True), (80.1, "==", 80.0, False), (80.0, "!=", 70.0, False), (80.0, "", 70.0, False),
]


def test_compare(spark):
    df = spark.createDataFrame(COMPARISONS, "v double, op string, t double, want boolean")
    rows = df.select("want", C.compare(F.col("v"), F.col("op"), F.col("t")).alias("got")).collect()
    assert all(r.want == r.got for r in rows)


def test_health_boundaries(spark, at):
    ages = {0: "healthy", 30: "healthy", 30.9: "healthy", 31: "stale", 119.9: "stale", 120: "offline", -5: "healthy"}
    df = spark.createDataFrame([(float(a), at(-a)) for a in ages], "age double, ts timestamp")
    age = C.age_seconds(F.col("ts"), F.lit(at(0)))
    rows = df.select("age", age.alias("whole"), C.health_class(age).alias("status")).collect()
    assert {r.age: r.status for r in rows} == ages
    assert {r.age: r.whole for r in rows}[-5] == 0
    assert {r.age: r.whole for r in rows}[30.9] == 30


def test_health_thresholds():
    assert C.health_thresholds(0, 0) == (30, 120)
    assert C.health_thresholds(-1, 10) == (30, 120)
    assert C.health_thresholds(300, 200) == (300, 120)
    assert C.health_thresholds(60, 61) == (60, 61)


def test_ranges_and_limits():
    assert C.range_length("15m") == ("15m", timedelta(minutes=15))
    assert C.range_length("") == ("1h", timedelta(hours=1))
    assert C.range_length("2w") == ("2w", timedelta(hours=1))
    assert C.history_limit(None) == 50 and C.history_limit("") == 50
    assert C.history_limit("500") == 500 and C.history_limit(1) == 1
    for bad in ("abc", "0", "-1", "501", "1.5"):
        with pytest.raises(ValueError):
            C.history_limit(bad)


def test_different_keys_have_different_ids(spark):
    rows = [("a|b", "c"), ("a", "b|c"), (None, "x"), ("x", None), ("-", "x"), ("", "x")]
    df = spark.createDataFrame(rows, "a string, b string")
    assert df.select(X.stable_id("k", F.col("a"), F.col("b")).alias("id")).distinct().count() == len(rows)


def test_blank_is_any_white_space(spark):
    df = spark.createDataFrame([("\t",), ("\n \x85",), ("\u3000\xa0",), (None,), ("\u200b",), ("x ",)], "c string")
    assert [r[0] for r in df.select(X.blank(F.col("c"))).collect()] == [True, True, True, True, False, False]
