import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.conftest import rows
from tripweave.operators import aggregate as agg
from tripweave.operators.normalize import add_slice_columns
from tripweave.schema import aggregate_label, key_columns


def test_keys_are_ordered_and_checked(rides_of):
    assert key_columns("ymrgtb") == ["region", "start_year", "start_month", "gender", "user_type", "rideable_type"]
    assert key_columns("es") == ["start_station_id", "end_station_id"]
    assert aggregate_label("rymgtb", "dc") == "ymrgtb_cd"
    for keys, measures in (("yq", "c"), ("y", "x"), ("y", "")):
        with pytest.raises(ValueError):
            agg.aggregate_rides(rides_of({}), keys, measures)


def test_null_keys_are_left_out(rides_of):
    rides = rides_of({}, {"gender": None}, {"gender": 2, "start_region": None})
    assert rows(agg.aggregate_rides(rides, "g", "c")) == [(1, 1), (2, 1)]
    assert rows(agg.aggregate_rides(rides, "rg", "cd")) == [("NYC", 1, 1, 1200)]
    assert rows(agg.aggregate_rides(rides, "", "c")) == [(3,)]


def test_duration_alone(rides_of):
    assert agg.aggregate_rides(rides_of({}), "y", "d").columns == ["start_year", "duration"]


def test_storage_month_keeps_month_crossers_apart(rides_of):
    rides = rides_of({}, {"stop_time": "2020-01-31 23:59:00"}).withColumn("end_ym", F.date_format("stop_time", "yyyyMM").cast("int"))
    assert agg.ride_cube(rides).count() == 1
    assert rows(agg.ride_cube(rides, by_storage_month=True).select("end_ym", "count")) == [(202001, 1), (202002, 1)]


def test_rollup_equals_direct(rides_of):
    rides = rides_of({}, {"gender": 2}, {"gender": 2, "user_type": "Customer"}, {"start_region": "HB"})
    direct = agg.aggregate_rides(rides, "rg", "cd")
    rolled = agg.reaggregate(agg.ride_cube(rides), ["region", "gender"])
    assert rows(direct) == rows(rolled)


def test_display_and_short_cube(rides_of):
    rides = rides_of({"start_region": "HB"}, {"user_type": "Customer", "rideable_type": "electric_bike"})
    display = agg.cube_display(agg.ride_cube(rides))
    assert rows(display) == [(2020, 1, "HOB", "Annual", "classic_bike", 1, 1, 1200), (2020, 1, "NYC", "Daily", "electric_bike", 1, 1, 1200)]
    short = agg.cube_short(display)
    assert short.columns == ["y", "m", "r", "t", "b", "g", "c", "d"]
    assert rows(short) == [(20, 1, 0, 1, 2, 1, 1, 1200), (20, 1, 2, 0, 0, 1, 1, 1200)]


def test_cube_order_follows_domains(rides_of):
    rides = rides_of({"rideable_type": "electric_bike"}, {"rideable_type": "unknown"}, {}, {"user_type": "Customer"})
    ordered = agg.cube_display(agg.ride_cube(rides)).orderBy(*agg.cube_order())
    assert [(r.user_type, r.rideable_type) for r in ordered.collect()] == [
        ("Annual", "unknown"),
        ("Annual", "classic_bike"),
        ("Annual", "electric_bike"),
        ("Daily", "classic_bike"),
    ]


def test_histogram_and_peak(rides_of):
    rides = rides_of(
        {"start_time": "2023-03-01 00:00:00", "stop_time": "2023-03-01 00:04:20"},
        {"start_time": "2023-03-01 00:00:00", "stop_time": "2023-03-01 00:04:29"},
        {"start_time": "2023-03-01 00:00:00", "stop_time": "2023-03-01 00:00:05"},
    )
    hist = agg.duration_histogram(rides, 10)
    assert rows(hist) == [(0, 1), (260, 2)]
    assert rows(agg.duration_histogram(rides, 10, n=1)) == [(0, 1)]
    assert rows(agg.histogram_peak(hist)) == [(260, 2)]


def test_region_matrix_and_percentages(rides_of):
    rides = rides_of({}, {}, {"end_region": "NYC"}, {"end_region": None}, {"gender": 2})
    assert rows(agg.region_matrix(rides, ["NYC", "JC"])) == [("NYC", 1, 3)]
    out = agg.category_percentages(rides, F.col("gender").cast("string"), ["0", "1", "2"])
    assert rows(out) == [(2020, 1, None, 4, 1, None, 80.0, 20.0)]


def test_dockings(rides_of):
    out = agg.dockings(rides_of({})).select("station_id", "is_start", "day", "hour", "weekday")
    assert rows(out) == [("4001.01", True, 31, 23, 4), ("JC001", False, 1, 0, 5)]


def test_station_counts(spark, rides_of):
    rides = rides_of({}, {}, {"end_station_id": "HB101"}, {"end_station_id": "Odd"})
    stations = spark.createDataFrame([("JC001", "Grove"), ("HB101", "Hob"), ("4001.01", "A")], "id string, name string")
    january = ("2020-01-01", "2020-02-01")  # the default ride ends on the first of February
    out = agg.station_counts(rides, stations, *january, nj=True)
    assert rows(out) == [("HB101", "Hob", 1, 1 / 32), ("JC001", "Grove", 2, 2 / 32)]
    weekend = agg.station_counts(rides, stations, *january, nj=True, weekdays=False)
    assert rows(weekend) == [("HB101", "Hob", 1, 1 / 9), ("JC001", "Grove", 2, 2 / 9)]
    assert rows(agg.station_counts(rides, stations, *january, nj=False, weekdays=[4])) == [("4001.01", "A", 4, 4 / 5)]
    assert rows(agg.station_counts(rides, stations, *january, keys=["day"], nj=False)) == [("4001.01", "A", 31, 4)]
    # Dockings outside the period count neither above nor below the line.
    assert rows(agg.station_counts(rides, stations, "2020-02-01", "2020-02-02")) == [("HB101", "Hob", 1, 0.5), ("JC001", "Grove", 2, 1.0)]
    with pytest.raises(ValueError):
        agg.station_counts(rides, stations, *january, keys=["day"], daily_average=True)


def test_calendar_days():
    assert agg.calendar_days("2022-08-01", "2022-08-31") == 31
    assert agg.calendar_days("2022-08-01", "2022-08-31", True) == 23
    assert agg.calendar_days("2022-08-01", "2022-08-31", False) == 8
    assert agg.calendar_days("2022-08-01", "2022-08-31", [0, 6]) == 9


def test_same_station_share(rides_of):
    rides = rides_of({}, {"end_station_name": "A"}, {"end_station_name": None}, {})
    assert rows(agg.same_station_share(rides)) == [("2020-01", 1, 4, 0.25)]


def test_append_new_months(rides_of):
    """A ride from January into February is stored with February: it adds to January's key."""
    february = {"start_time": "2020-02-01 00:00:00", "stop_time": "2020-02-01 00:10:00"}
    january = {"stop_time": "2020-01-31 23:59:00"}
    rides = add_slice_columns(rides_of({}, january, january, february, {"start_time": "2020-03-05 00:00:00", "stop_time": "2020-03-05 00:05:00"}))
    build = lambda r: agg.aggregate_rides(r, "ym", "c")
    whole = rows(build(rides))
    assert whole == [(2020, 1, 3), (2020, 2, 1), (2020, 3, 1)]
    for through in (201912, 202001, 202002, 202003):
        stored = build(rides.where(f"end_ym <= {through}"))
        assert rows(agg.append_new_months(stored, rides, build, through)) == whole


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(
    data=st.lists(
        st.tuples(st.sampled_from(["NYC", "JC", None]), st.sampled_from([0, 1, None]), st.integers(-90000, 200000)), min_size=1, max_size=20
    ),
    keys=st.sampled_from(["r", "g", "rg"]),
)
def test_counts_add_up_to_rides_with_keys(spark, data, keys):
    from datetime import datetime, timedelta

    begin = datetime(2020, 1, 1)
    rows_in = [(r, g, begin, begin + timedelta(seconds=s)) for r, g, s in data]
    rides = spark.createDataFrame(rows_in, "start_region string, gender int, start_time timestamp_ntz, stop_time timestamp_ntz")
    out = agg.aggregate_rides(rides, keys, "cd").collect()
    known = [(r, g, s) for r, g, s in data if (r is not None or "r" not in keys) and (g is not None or "g" not in keys)]
    assert sum(row["count"] for row in out) == len(known)
    assert sum(row["duration"] for row in out) == sum(s % 86400 for _, _, s in known)
