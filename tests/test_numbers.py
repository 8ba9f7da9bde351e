"""The number readings and JSON array reductions, on golden documents."""

import pytest
from pyspark.sql import functions as F

from fleetpulse import model
from fleetpulse.functions import numbers as N

# value, sql, strict, present_or_zero, number_or_zero
GOLDEN = [
    ('{"system":{"cpu":{"usage_percent":10}}}', 10.0, 10.0, 10.0, 10.0),
    ('{"system":{"cpu":{"usage_percent":1e2}}}', 100.0, 100.0, 100.0, 100.0),
    ('{"system":{"cpu":{"usage_percent":1.5}}}', 1.5, 1.5, 1.5, 1.5),
    ('{"system":{"cpu":{"usage_percent":-3}}}', -3.0, -3.0, -3.0, -3.0),
    ('{"system":{"cpu":{"usage_percent":"12.5"}}}', 12.5, None, 0.0, 0.0),
    ('{"system":{"cpu":{"usage_percent":"abc"}}}', None, None, 0.0, 0.0),
    ('{"system":{"cpu":{"usage_percent":true}}}', None, None, 0.0, 0.0),
    ('{"system":{"cpu":{"usage_percent":{"a":1}}}}', None, None, 0.0, 0.0),
    ('{"system":{"cpu":{"usage_percent":[1]}}}', None, None, 0.0, 0.0),
    ('{"system":{"cpu":{"usage_percent":null}}}', None, None, 0.0, 0.0),
    ('{"system":{"cpu":{}}}', None, None, None, 0.0),
    ('{"system":{"cpu":7}}', None, None, None, 0.0),
    ('{"system":[]}', None, None, None, 0.0),
    ('{"cpu":15.4}', None, None, None, 0.0),
    ("{}", None, None, None, 0.0),
]


def parsed(spark, texts):
    return spark.createDataFrame([(t,) for t in texts], "t string").select("t", F.parse_json("t").alias("m"))


def test_readings(spark):
    m = F.col("m")
    rows = parsed(spark, [g[0] for g in GOLDEN]).select(
        "t",
        N.sql_number(m, model.CPU_PATH),
        N.strict_number(m, model.CPU_PATH),
        N.present_or_zero(m, model.CPU_PATH),
        N.number_or_zero(m, model.CPU_PATH),
    )
    assert sorted(map(tuple, rows.collect())) == sorted(GOLDEN)


@pytest.mark.parametrize("value", ['"abc"', "true"])
def test_strict_cast_raises(spark, value):
    df = parsed(spark, ['{"system":{"cpu":{"usage_percent":%s}}}' % value])
    with pytest.raises(Exception):
        df.select(N.sql_number(F.col("m"), model.CPU_PATH, strict_cast=True)).collect()


def interfaces(items):
    return '{"system":{"network":{"interfaces":%s}}}' % items


@pytest.mark.parametrize(
    ("items", "whole", "unsigned"),
    [
        ('[{"bytes_recv":100},{"bytes_recv":"7"},{"bytes_recv":true},{"x":1},5,null]', 107, 100),
        ('[{"bytes_recv":100.7},{"bytes_recv":-4},{"bytes_recv":1e3}]', 996, 1100),
        ('[{"bytes_recv":9007199254740993},{"bytes_recv":9223372036854775807}]', 9232379236109516800, 9232379236109516800),
        ("{}", 0, 0),
        ("[]", 0, 0),
        ("null", 0, 0),
    ],
)
def test_array_sums(spark, items, whole, unsigned):
    m = F.col("m")
    row = parsed(spark, [interfaces(items)]).select(
        N.sum_whole(m, model.INTERFACES_PATH, "bytes_recv").cast("string").alias("whole"),
        N.sum_bytes(m, model.INTERFACES_PATH, "bytes_recv").cast("string").alias("unsigned"),
    )
    assert row.first() == (str(whole), str(unsigned))


def test_root_partition_is_the_first_mounted_at_root(spark):
    doc = '{"system":{"disk":{"partitions":%s}}}'
    cases = {
        '[{"mountpoint":"/boot","used_percent":1},{"mountpoint":"/","used_percent":"40"},{"mountpoint":"/","used_percent":9}]': 40.0,
        '[{"mountpoint":"/","used_percent":null},{"mountpoint":"/","used_percent":9}]': None,
        '[{"mountpoint":"/home","used_percent":9}]': None,
        '{"mountpoint":"/"}': None,
        "[]": None,
    }
    rows = parsed(spark, [doc % c for c in cases]).select(
        "t", N.root_partition_percent(F.col("m"), model.PARTITIONS_PATH)
    )
    assert dict(map(tuple, rows.collect())) == {doc % c: v for c, v in cases.items()}


def test_disk_values_keep_their_order(spark):
    docs = {
        '{"system":{"disk":{"used_percent":5,"partitions":[{"used_percent":7},{"used_percent":"8"},{"used_percent":9}]}}}': [5.0, 7.0, 9.0],
        '{"system":{"disk":{"used_percent":"x","partitions":[{"used_percent":7}]}}}': [0.0, 7.0],
        '{"system":{"disk":{"partitions":[{"used_percent":7},3]}}}': [7.0],
        '{"system":{"disk":3}}': [],
    }
    rows = parsed(spark, docs).select("t", N.disk_values(F.col("m"), model.DISK_PATH, model.PARTITIONS_PATH))
    assert dict(map(tuple, rows.collect())) == docs


def test_huge_counts_do_not_fail_a_query(spark):
    df = spark.createDataFrame([("3000000000",), ("1e300",), ("-1e300",), ("2.9",)], "t string").select(F.parse_json("t").alias("v"))
    found = [r[0] for r in df.select(N.clamped_whole(N.number_or_zero(F.col("v"), "$"))).collect()]
    assert found == [3_000_000_000, 2**63 - 1, -(2**63), 2]


def test_sums_of_huge_values(spark):
    text = '{"a":[{"b":90000000000000000000},{"b":90000000000000000000}]}'
    df = spark.createDataFrame([(text,)], "t string").select(F.parse_json("t").alias("v"))
    assert int(df.select(N.sum_bytes(F.col("v"), "$.a", "b")).first()[0]) == 180000000000000000000


@pytest.mark.parametrize("value", ['"x"', "1.5", "true"])
def test_strict_sums_raise(spark, value):
    df = spark.createDataFrame([('{"a":[{"b":%s}]}' % value,)], "t string").select(F.parse_json("t").alias("v"))
    assert df.select(N.sum_whole(F.col("v"), "$.a", "b")).first()[0] == 0
    with pytest.raises(Exception, match="no whole number"):
        df.select(N.sum_whole(F.col("v"), "$.a", "b", True)).collect()
