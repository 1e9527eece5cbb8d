from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tests.conftest import at
from tripweave.functions import codes, regions, temporal, text


def one(spark, values, expr, dtype="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {dtype}")
    return [r[0] for r in df.orderBy("i").select(expr(F.col("v"))).collect()]


def test_duration_wraps_at_a_day_and_below_zero(spark):
    spans = [
        (at("2020-01-01 00:00:00"), at("2020-01-01 00:04:20.900000")),
        (at("2020-01-01 00:00:00"), at("2020-01-02 01:00:00")),
        (at("2020-01-01 00:00:10"), at("2020-01-01 00:00:00")),
        (at("2020-01-01 00:00:00.500000"), at("2020-01-01 00:00:00")),
        (at("2020-03-08 01:59:00"), at("2020-03-08 02:30:00")),
    ]
    df = spark.createDataFrame(spans, "a timestamp_ntz, b timestamp_ntz").coalesce(1)
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        # The last ride is in the hour that a change to summer time skips.
        for zone in ("UTC", "America/New_York"):
            spark.conf.set("spark.sql.session.timeZone", zone)
            assert [r[0] for r in df.select(temporal.duration_seconds("a", "b")).collect()] == [260, 3600, 86390, 86399, 1860]
            assert [r[0] for r in df.select(temporal.duration_seconds("a", "b", "total")).collect()] == [260, 90000, -10, -1, 1860]
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    with pytest.raises(ValueError):
        temporal.duration_seconds("a", "b", "days")


def test_duration_labels(spark):
    assert one(spark, [0, 260, 3600, 3661, 86400, 59, None], temporal.duration_label, "long") == ["0s", "4m20s", "1h", "1h1m1s", "0s", "59s", None]


def test_month_texts(spark):
    df = spark.createDataFrame([(datetime(2020, 1, 31, 23, 50), datetime(2020, 2, 1))], "a timestamp_ntz, b timestamp_ntz")
    row = df.select(
        temporal.slice_label("a", "b"), temporal.year_month_int("b"), temporal.month_label_of("a"), temporal.month_label(F.year("a"), F.month("a"))
    ).first()
    assert tuple(row) == ("202001_202002", 202002, "2020-01", "2020-01")


def test_day_class_is_monday_based(spark):
    assert one(spark, [0, 4, 5, 6], temporal.day_class, "int") == ["Weekday", "Weekday", "Weekend", "Weekend"]


@pytest.mark.parametrize(
    ("station_id", "region"),
    [
        ("72", "NYC"),
        ("6551.03", "NYC"),
        ("3186", "NYC"),  # three digits match at the start
        ("S 5th St & Kent Ave", "NYC"),
        ("JC013", "JC"),
        ("Liberty State Park", "JC"),
        ("HB102", "HB"),
        ("SYS001", "SYS"),
        ("SYSY01", None),
        ("SYSY016", "SYS"),
        ("Lab - NYC", "SYS"),
        ("JCSYS", "SYS"),
        ("X-MTL-AOS-5.1", "SYS"),
        (None, "None"),
        ("None", "None"),
        ("North Pole", None),
        ("elsewhere", None),
        ("ZZ", None),
    ],
)
def test_regions(spark, station_id, region):
    assert one(spark, [station_id], regions.region_of) == [region]


def test_every_region_claims_an_id_alone(spark):
    ids = ["72", "JC013", "HB102", "SYS001", "JCSYS", "Lab - NYC", None, "4001.01", "Shop Morgan", "MTL-ECO5-LAB", "MTL-ECO51-1"]
    assert one(spark, ids, regions.region_matches) == [1] * len(ids)


def test_nyc_id_in_a_jc_file(spark):
    assert one(spark, ["3186", "HB102", "ZZ"], lambda c: regions.region_of(c, "JC")) == ["JC", "HB", None]


def test_is_trip_keeps_unrecognised_stations(spark):
    df = spark.createDataFrame([("72", "ZZ"), ("72", None), ("SYS001", "72"), ("None", "72"), ("ZZ", "ZZ")], "a string, b string").coalesce(1)
    assert [r[0] for r in df.select(regions.is_trip(F.col("a"), F.col("b"))).collect()] == [True, False, False, False, True]


def test_codes(spark):
    assert one(spark, ["docked_bike", "classic_bike", "electric_bike", "unknown", "motivate_dockless_bike", None], codes.rideable_type) == [
        "classic_bike",
        "classic_bike",
        "electric_bike",
        "unknown",
        None,
        None,
    ]
    assert one(spark, ["member", "casual", "x", None], codes.member_casual) == ["Subscriber", "Customer", None, None]
    assert one(spark, ["U", "M", "F", "2", "1.0", None], codes.gender_code) == [0, 1, 2, 2, 1, None]
    assert one(spark, ["72.0", "72", "6551.03", "7.00", "a.0", None], codes.station_id) == ["72", "72", "6551.03", "7.00", "a.0", None]
    assert one(spark, ["123.0", "123", "x", None], codes.whole_number) == [123, 123, None, None]
    rank = lambda c: codes.domain_rank(c, codes.RIDEABLE_TYPES)
    assert one(spark, ["unknown", "electric_bike", "tandem", None], rank) == [0, 2, None, None]


def test_strict_lookup_fails_on_unknown(spark):
    df = spark.createDataFrame([("Customer",), ("Nobody",)], "v string")
    with pytest.raises(Exception, match="unknown user type: Nobody"):
        df.select(codes.strict_lookup(F.col("v"), codes.USER_TYPE_DISPLAY, "user type")).collect()


def test_pattern_filters(spark):
    ids = ["JC001", "HB1", "4001.01", None]
    assert one(spark, ids, text.starts_with_pattern) == [True, True, False, False]
    assert one(spark, ids, lambda c: text.starts_with_pattern(c, negate=True)) == [False, False, True, True]
    assert one(spark, ids, lambda c: text.include_exclude(c, include=["^JC", "01$"])) == [True, False, True, False]
    assert one(spark, ids, lambda c: text.include_exclude(c, exclude=["^JC"])) == [False, True, True, True]
    assert one(spark, ids, text.include_exclude) == [True] * 4
    with pytest.raises(ValueError):
        text.include_exclude(F.col("v"), ["a"], ["b"])
    assert one(spark, ["a", "b", None], lambda c: text.not_equal_or_null(c, "a")) == [False, True, True]
    assert one(spark, ["x/JC-202101-trips.zip", "202212-trips.csv", "notes"], text.path_month) == ["202101", "202212", ""]
    assert one(spark, ["JC012", "HB1", "72"], text.id_prefix) == ["JC", "HB", ""]
