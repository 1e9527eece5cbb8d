import pytest
from pyspark.sql import functions as F

from tests.conftest import rows
from tripweave.operators import aggregate as agg
from tripweave.operators import ranking
from tripweave.operators import stations as st


def test_meta_hist_counts_both_ends(rides_of):
    rides = rides_of({}, {"end_station_name": None}, {"start_station_id": None})
    assert rows(st.station_meta_hist(rides, "in")) == [("4001.01", "A", 2), ("JC001", "B", 2)]
    assert rows(st.station_meta_hist(rides, "il")) == [("4001.01", 40.7, -74.0, 2), ("JC001", 40.8, -74.1, 3)]
    # The month is that of the ride's start, for both ends.
    assert rows(st.station_meta_hist(rides, "ymi")) == [(2020, 1, "4001.01", 2), (2020, 1, "JC001", 3)]
    total = st.station_meta_hist(rides_of({}, {}), "in").agg(F.sum("count")).first()[0]
    assert total == 4


def test_names_break_ties_alphabetically(spark):
    hist = spark.createDataFrame([("1", "b", 3), ("1", "a", 3), ("1", "c", 1), ("2", "z", 1)], "id string, name string, count long")
    assert rows(st.station_names(hist)) == [("1", "a"), ("2", "z")]


def test_positions_are_weighted(spark):
    hist = spark.createDataFrame([("1", 10.0, 0.0, 3), ("1", 20.0, 4.0, 1)], "id string, lat double, lng double, count long")
    assert rows(st.station_positions(hist)) == [("1", 12.5, 1.0)]


def test_one_pass_table_equals_joined_profiles(rides_of):
    rides = rides_of(
        {},
        {"end_station_name": "B2", "end_lat": 40.9},
        {"end_station_name": "B2"},
        {"end_station_id": "start-less", "end_station_name": None, "end_lat": None},
        {"start_station_id": "nameless", "start_station_name": None},
        {"start_station_id": "bare", "start_station_name": None, "start_lat": None},
        {"start_station_id": None},
    )
    arrivals = agg.aggregate_rides(rides, "e", "c").select(F.col("end_station_id").alias("id"), F.col("count").alias("ends"))
    names, positions = st.station_names(st.station_meta_hist(rides, "in")), st.station_positions(st.station_meta_hist(rides, "il"))

    def rounded(df):
        return rows(df.withColumns({c: F.round(c, 9) for c in ("lat", "lng")}))

    joined = st.join_station_profiles(names, positions, arrivals)
    assert rounded(st.station_table(rides)) == rounded(joined)
    assert "bare" not in [r.id for r in joined.collect()]


@pytest.mark.parametrize("ranges", [1, 2, 7, 64, 500])
def test_dense_index(spark, ranges):
    ids = [f"{i * 7919 % 1000:04d}" for i in range(300)] + ["", "Z", "Å"]
    df = spark.createDataFrame([(i,) for i in ids * 2] + [(None,)], "id string")
    out = {r.id: r.idx for r in ranking.dense_index(df, "id", ranges=ranges).collect()}
    assert out == {i: n for n, i in enumerate(sorted(set(ids), key=lambda s: s.encode()))}


def test_first_per_group(spark):
    df = spark.createDataFrame([("g", 1, "x"), ("g", 5, "z"), ("g", 5, "y"), ("h", None, "n")], "g string, n int, v string")
    assert rows(ranking.first_per_group(df, "g", "n", ["v"])) == [("g", 5, "y"), ("h", None, "n")]


def test_pairs_round_trip(spark, rides_of):
    rides = rides_of({}, {}, {"start_station_id": "HB101"}, {"end_station_id": None})
    pairs = st.station_pairs(rides)
    index = st.station_index(st.station_table(rides))
    assert rows(index) == [(0, "4001.01"), (1, "HB101"), (2, "JC001")]
    encoded = st.encode_pairs(pairs, index)
    assert rows(encoded) == [(0, 2, 2), (1, 2, 1)]
    maps = st.pair_maps(encoded)
    assert {r.sidx: r.destinations for r in maps.collect()} == {0: {2: 2}, 1: {2: 1}}
    assert rows(st.explode_pair_maps(maps)) == rows(encoded)
    assert rows(st.decode_pairs(encoded, index)) == rows(pairs)
    assert {r.sid: r.destinations for r in st.recode_map_keys(maps, index).collect()} == {"4001.01": {"JC001": 2}, "HB101": {"JC001": 1}}
    partial = st.encode_pairs(pairs, index.where("idx <> 2"))
    assert [r.eidx for r in partial.collect()] == [None, None]


def test_destinations_weigh_against_the_busiest(spark):
    pairs = spark.createDataFrame([("a", "b", 8), ("a", "gone", 16), ("a", "a", 1), ("b", "a", 2)], "sid string, eid string, count long")
    stations = spark.createDataFrame(
        [("a", "A", 1.0, 2.0, 100), ("b", "B", 3.0, 4.0, 0)], "id string, name string, lat double, lng double, ends long"
    )
    out = st.station_destinations(pairs, stations, scale=2, origin="a").select("eid", "dst_name", "max_count", "weight")
    assert rows(out) == [("a", "A", 16, 0.7), ("b", "B", 16, 2.5)]
    assert st.station_destinations(pairs, stations).count() == 3


def test_mode_sketch(spark):
    data = [("s", "x", 5), ("s", "y", 5), ("s", "z", 2), ("s", "w", 2), ("s", "x", 1), ("t", "x", 3), ("u", "a", 1), ("u", "b", 1), ("u", "c", 1)]
    hist = spark.createDataFrame(data, "id string, name string, count long")
    out = {r.id: r for r in st.mode_sketch(hist, "id", ["name"]).withColumn("list", st.expand_runs(F.col("counts"))).collect()}
    s, t, u = out["s"], out["t"], out["u"]
    assert (s.name, s.mode_count, s.second, s.restsum, s.total, s.num, s.list) == ("x", 6, 5, 9, 15, 4, [6, 5, 2, 2])
    assert (s.first_second, s.mode_pct, s.below_threshold) == (1.2, 0.4, True)
    assert (t.second, t.first_second, t.mode_pct, t.num, t.below_threshold, t.list) == (None, None, 1.0, 1, False, [3])
    assert (u.name, u.second, u.first_second, u.list) == ("a", 1, 1.0, [1, 1, 1])


def test_mode_diagnostics(spark):
    hist = spark.createDataFrame([("s", "a", 6), ("s", "b", 2), ("s", "c", 2), ("s", "d", 1), ("t", "x", 3)], "id string, name string, count long")
    out = rows(st.mode_diagnostics(hist))
    assert out == [
        ("s", "a", 6, 11, 4, 6 / 11, 3.0),
        ("s", "b", 2, 11, 4, 2 / 11, 1.0),
        ("s", "c", 2, 11, 4, 2 / 11, 2.0),
        ("s", "d", 1, 11, 4, 1 / 11, None),
        ("t", "x", 3, 3, 1, 1.0, None),
    ]
