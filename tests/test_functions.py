"""Scalar functions on hand-written edge rows."""

import datetime
import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from txnflow.functions.geo import haversine
from txnflow.functions.hashing import key_fraction
from txnflow.functions.messages import encode_json, flatten_json, parse_transactions
from txnflow.functions.times import age_in_years, date_prefix, normalize_time

POINTS = "a double, b double, c double, d double"


def km(spark, *points, variant="radians"):
    rows = spark.createDataFrame(list(points), POINTS)
    return [r[0] for r in rows.select(haversine("a", "b", "c", "d", variant)).collect()]


def test_distance_of_known_points(spark):
    quarter = math.pi * 6371 / 2
    found = km(spark, (0.0, 0.0, 0.0, 90.0), (0.0, 0.0, 90.0, 0.0), (0.0, 0.0, 0.0, 180.0), (10.0, 20.0, 10.0, 20.0))
    assert found == pytest.approx([quarter, quarter, 2 * quarter, 0.0], abs=1e-6)


def test_distance_of_null_is_null(spark):
    assert km(spark, (None, 0.0, 1.0, 1.0), (0.0, 0.0, None, 1.0)) == [None, None]
    assert km(spark, (None, 0.0, 1.0, 1.0), variant="degrees") == [None]


def test_degrees_variant_is_null_where_its_term_is_negative(spark):
    found = km(spark, (45.5, 0.0, 45.6, 30.0), (40.0, -100.0, 41.0, -101.0), variant="degrees")
    assert found[0] is None and found[1] > 0
    with pytest.raises(ValueError):
        haversine("a", "b", "c", "d", "gradians")


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(*[st.floats(-90, 90), st.floats(-180, 180)] * 2), min_size=1, max_size=50))
def test_distance_stays_within_half_the_globe(spark, points):
    for value in km(spark, *points):
        assert 0 <= value <= math.pi * 6371 + 1e-6


def test_times(spark):
    rows = spark.createDataFrame(
        [("2019-01-01T00:00:00.000Z", "12:34:56"), (None, "12:34:56"), ("bad", "12:00:00"), ("", "12:00:00"),
         ("2019-01-02", None), ("2019-01-03T", "25:00:00")],
        "trans_date string, trans_time string")
    found = [(r["trans_date"], r["trans_time"]) for r in normalize_time(rows).collect()]
    assert found == [
        ("2019-01-01", datetime.datetime(2019, 1, 1, 12, 34, 56)), (None, None), ("bad", None), ("", None),
        ("2019-01-02", datetime.datetime(2019, 1, 2)), ("2019-01-03", None),
    ]
    assert dict(normalize_time(rows, "timestamp_ntz").dtypes)["trans_time"] == "timestamp_ntz"
    assert [r[0] for r in rows.select(date_prefix("trans_date")).collect()][0] == "2019-01-01"


def test_age(spark, as_of):
    days = [datetime.date(2000, 1, 1), datetime.date(2024, 6, 1), None, datetime.date(2022, 12, 27)]
    rows = spark.createDataFrame([(d,) for d in days], "dob date")
    # The first has its birthday ahead but leap days make up for it; the second is born after the date.
    assert [r[0] for r in rows.select(age_in_years("dob", as_of)).collect()] == [24, 0, None, 1]
    assert rows.select(age_in_years("dob")).first()[0] >= 24


def test_messages(spark):
    good = '{"cc_num":"1","first":"A","last":"B","trans_num":"t","trans_time":"2023-01-05 12:34:56.123456",' \
           '"category":"food","merchant":"m","amt":"10.5","merch_lat":"41","merch_long":"-101"}'
    bad_amount = good.replace('"10.5"', '"q"').replace("2023-01-05 12", "yesterday")
    number = good.replace('"10.5"', "10.5")
    rows = spark.createDataFrame([(bytearray(v.encode()), i) for i, v in enumerate([good, bad_amount, "not json", number])],
                                 "value binary, offset bigint")
    found = parse_transactions(rows, keep=["offset"]).orderBy("offset").collect()
    assert "first" not in found[0] and "last" not in found[0]
    assert found[0]["amt"] == 10.5 and found[0]["trans_time"] == datetime.datetime(2023, 1, 5, 12, 34, 56, 123456)
    assert found[1]["amt"] is None and found[1]["trans_time"] is None and found[1]["cc_num"] == "1"
    assert all(v is None for k, v in found[2].asDict().items() if k != "offset")
    assert found[3]["amt"] == 10.5


def test_flatten_and_encode(spark):
    rows = spark.createDataFrame([(1, 2.5, None)], "x int, y double, z string").select(encode_json("x", "y", "z").alias("value"))
    assert rows.first()[0] == '{"x":"1","y":"2.5"}'
    point = flatten_json(spark.createDataFrame([('{"x":1,"y":2.5,"z":"3"}',), ('{"x":"no","y":1}',)], "value string"),
                         "x double, y double, z string").collect()
    assert tuple(point[0]) == (1.0, 2.5, "3") and tuple(point[1]) == (None, 1.0, None)


def test_key_fraction(spark):
    rows = spark.range(2000).select(F.col("id").cast("string").alias("k")).select(key_fraction("k").alias("f"))
    values = [r["f"] for r in rows.collect()]
    assert all(0 <= v < 1 for v in values) and 0.45 < sum(values) / len(values) < 0.55
    assert spark.createDataFrame([(None,)], "k string").select(key_fraction("k")).first()[0] is not None


def test_a_time_without_a_date_is_no_time(spark):
    from txnflow.functions.times import parse_time

    rows = spark.createDataFrame([("12:34:56",), ("2023-01-05 01:02:03",), ("2023-01-05",), ("bad",), ("",), (None,), (" 2023-01-05T01:02:03 ",)], "t string")
    assert [r[0] is not None for r in rows.select(parse_time(F.col("t"))).collect()] == [False, True, True, False, False, False, True]
