from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tests.conftest import rows
from tripweave.operators.normalize import add_slice_columns, domain_failures, normalize
from tripweave.schema import RIDE_COLUMNS, RIDE_SCHEMA
from tripweave.sources import headers

ERA1 = [
    "tripduration", "starttime", "stoptime", "start station id", "start station name", "start station latitude", "start station longitude",
    "end station id", "end station name", "end station latitude", "end station longitude", "bikeid", "usertype", "birth year", "gender",
]
ERA3 = [
    "ride_id", "rideable_type", "started_at", "ended_at", "start_station_name", "start_station_id", "end_station_name", "end_station_id",
    "start_lat", "start_lng", "end_lat", "end_lng", "member_casual",
]


def text_frame(spark, names, *values):
    return spark.createDataFrame(values, ", ".join(f"`{n}` string" for n in names))


def test_headers():
    assert headers.canonical_name("Start Station Latitude") == headers.canonical_name("start station latitude") == "start_lat"
    assert headers.canonical_name("start_lat") == "start_lat"
    assert headers.canonical_name("Bike ID") == headers.canonical_name("bikeid") == "bike_id"
    assert headers.canonical_name("started_at") == "start_time"
    assert headers.unexpected_headers([*ERA1, *ERA3, "Unnamed: 0", "speed"]) == ["speed"]
    assert headers.sort_columns(ERA1) == ["starttime", "stoptime", "bikeid"]
    assert headers.sort_columns(ERA3) == ["started_at", "ended_at", "ride_id"]
    with pytest.raises(ValueError):
        headers.sort_columns(["starttime", "Start Time"])


def test_expected_columns():
    assert "ride_id" not in headers.expected_columns(201912)
    assert headers.expected_columns(202001) == RIDE_COLUMNS
    assert set(RIDE_COLUMNS) - set(headers.expected_columns(202102)) == {"bike_id", "birth_year"}


def test_first_era(spark):
    raw = text_frame(
        spark,
        ERA1,
        ("634", "2013-06-01 00:00:01", "2013-06-01 00:10:35", "444.0", "Bway", "40.74", "-73.98", "434", "9 Ave", "40.7", "-74.0", "19678.0", "Subscriber", "1983", "1"),
        ("1", "9/1/2014 00:00:25", "9/1/2014 0:05:10", "444", "Bway", "x", "-73.98", "SYS001", "Depot", "40.7", "-74.0", "1", "Subscriber", None, "2"),
        ("1", "9/1/2014 00:00:25", "9/1/2014 0:05:10", "444", "Bway", "x", "-73.98", "Odd", "9 Ave", "40.7", "-74.0", None, "Guest", None, "U"),
    )
    out = normalize(raw)
    assert out.schema == RIDE_SCHEMA or out.columns == RIDE_COLUMNS
    assert [f.dataType for f in out.schema.fields] == [f.dataType for f in RIDE_SCHEMA.fields]
    first, odd = sorted(out.collect(), key=lambda r: r.start_time)
    assert (first.ride_id, first.rideable_type, first.start_station_id, first.bike_id, first.birth_year, first.gender) == (None, "unknown", "444", 19678, 1983, 1)
    assert first.start_time == datetime(2013, 6, 1, 0, 0, 1)
    assert (odd.start_time, odd.stop_time) == (datetime(2014, 9, 1, 0, 0, 25), datetime(2014, 9, 1, 0, 5, 10))
    assert (odd.start_lat, odd.end_region, odd.user_type, odd.gender, odd.bike_id) == (None, None, None, 0, None)


def test_third_era(spark):
    raw = text_frame(
        spark,
        [*ERA3, "Unnamed: 0", "speed"],
        ("A1", "docked_bike", "2021-02-01 00:00:01.123", "2021-02-01 00:10:00", "x", "3186", "y", "HB102", "40.7", "-74.0", "40.8", "-74.1", "member", "0", "9"),
        ("A2", "motivate_dockless_bike", "2021-02-01 00:00:01", "2021-02-01 00:10:00", "x", "JC001", "y", None, "40.7", "-74.0", "40.8", "-74.1", "casual", "0", "9"),
    ).withColumn("src", F.lit("JC-file"))
    (row,) = normalize(raw, publisher="JC", keep=["src"]).collect()
    assert (row.rideable_type, row.user_type, row.gender, row.start_region, row.end_region, row.src) == ("classic_bike", "Subscriber", 0, "JC", "HB", "JC-file")
    assert row.start_time.microsecond == 123000
    kept = normalize(raw, keep_incomplete=True).where("ride_id = 'A2'").first()
    assert (kept.start_region, kept.end_region, kept.rideable_type) == ("JC", "JC", None)


def test_user_type_twice(spark):
    raw = text_frame(spark, ["usertype", "member_casual", "start_station_id", "end_station_id"], ("Subscriber", "member", "72", "72"))
    with pytest.raises(ValueError):
        normalize(raw)


def test_normalised_rows_pass_through(spark, rides_of):
    rides = rides_of({}, {"gender": None, "end_region": None, "end_station_id": "Odd"})
    again = normalize(rides.drop("start_region", "end_region"))
    assert rows(again) == rows(rides)


def test_slices(rides_of):
    row = add_slice_columns(rides_of({})).first()
    assert (row.start_ym, row.end_ym) == (202001, 202002)


def test_codes_outside_their_domain(spark):
    rows_ = [("weird", "Z", "scooter"), ("Subscriber", "1", "docked_bike"), ("Customer", "7", None), (None, None, "unknown"), ("weird", "1.0", "classic_bike")]
    df = spark.createDataFrame([(*r, "2020-01-01 00:00:00", "2020-01-01 00:01:00") for r in rows_], "usertype string, gender string, rideable_type string, starttime string, stoptime string")
    found = domain_failures(df)
    assert rows(found) == [("gender", "7", 1), ("gender", "Z", 1), ("rideable_type", "scooter", 1), ("user_type", "weird", 2)]
    assert domain_failures(df.select("starttime", "stoptime")).count() == 0
    era3 = df.selectExpr("usertype as member_casual", "starttime as started_at", "stoptime as ended_at")
    assert rows(domain_failures(era3)) == [("member_casual", "Customer", 1), ("member_casual", "Subscriber", 1), ("member_casual", "weird", 2)]
