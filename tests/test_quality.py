import pytest
from pyspark.sql import functions as F

from tests.conftest import rows
from tripweave.operators import compare, quality, reconcile
from tripweave.operators.normalize import add_slice_columns
from tripweave.schema import RIDE_COLUMNS, TIME_KEY


def test_duplicates_with_nulls_are_one_row(rides_of):
    rides = rides_of({"birth_year": None}, {"birth_year": None}, {})
    assert quality.drop_duplicate_rows(rides).count() == 2
    filed = rides.withColumn("file", F.when(F.monotonically_increasing_id() % 2 == 0, "b").otherwise("a"))
    kept = quality.drop_duplicate_rows(filed, provenance=["file"])
    assert kept.columns == filed.columns
    assert kept.count() == 2


def test_rows_whose_hash_is_their_own_are_not_compared(rides_of):
    filed = rides_of({}, {}, {"bike_id": 8}, {"bike_id": None}, {"bike_id": None}, {"ride_id": None}, {"gender": None, "birth_year": 1}, {"gender": 1, "birth_year": None})
    filed = filed.withColumn("file", F.lit("b")).unionByName(rides_of({}, {"bike_id": 9}).withColumn("file", F.lit("a")))
    repeated = quality.repeated_hashes(filed)
    assert repeated.count() == 3  # one of two rows that differ in where a null is
    for run in (lambda **k: quality.drop_duplicate_rows(filed, **k), lambda **k: quality.drop_duplicate_rows(filed, ["file"], **k), lambda **k: quality.rows_without_copy(filed, **k)):
        assert rows(run(repeated=repeated)) == rows(run())
    every = filed.select(F.xxhash64(*RIDE_COLUMNS).alias("_row_hash")).distinct()
    assert rows(quality.drop_duplicate_rows(filed, repeated=every)) == rows(filed.distinct())


def test_rows_apart_from_a_filter_have_keys_of_their_own(spark, monkeypatch):
    df = spark.range(3000).selectExpr("IF(id % 7 = 0, id - id % 14, id) AS k", "IF(id % 5 = 0, NULL, id DIV 14 % 3) AS v", "id AS n")
    for words in (quality.FILTER_WORDS, 8, 1):
        monkeypatch.setattr(quality, "FILTER_WORDS", words)
        for keys in (["k"], ["k", "v"]):
            repeated = quality.repeated_keys(df.dropna(subset=keys), keys)
            apart, others = quality.rows_by_filter(df, repeated, keys)
            assert rows(apart.unionByName(others)) == rows(df)
            assert others.dropna(subset=keys).count() == others.count()
            shared = quality.rows_with_copies(df.dropna(subset=keys), keys)
            assert shared.count() > 0 and shared.exceptAll(others).count() == 0
            if words > 8:
                assert others.count() == shared.count()


def test_merged_rows_do_not_depend_on_the_filter(rides_of, monkeypatch):
    df = rides_of(*[{"start_time": f"2020-02-01 00:{i:02d}:00", "ride_id": f"r{i}", "bike_id": None if i % 4 else i} for i in range(20)])
    other = df.where("minute(start_time) % 3 = 0").withColumn("bike_id", F.lit(77))
    both = df.withColumn("file", F.lit("b")).unionByName(other.withColumn("file", F.lit("a"))).unionByName(rides_of({"stop_time": None}, {"stop_time": None}).withColumn("file", F.lit("a")))
    wanted = rows(reconcile.merge_duplicates(both))
    assert len(wanted) == 22
    assert rows(reconcile.merge_duplicates(both, repeated=quality.repeated_keys(both, TIME_KEY))) == wanted
    monkeypatch.setattr(quality, "FILTER_WORDS", 1)
    assert rows(reconcile.merge_duplicates(both)) == wanted


def test_key_violations(rides_of):
    rides = rides_of({}, {"gender": 2}, {"ride_id": None, "bike_id": 1}, {"ride_id": None, "bike_id": 2}, {"ride_id": None, "bike_id": 2, "gender": 0})
    assert [(r.ride_key, r.n_rows) for r in quality.key_violations(rides).orderBy("ride_key").collect()] == [("2", 2), ("r1", 2)]
    with pytest.raises(AssertionError, match="2 keys with 2 rows"):
        quality.assert_unique(rides)
    quality.assert_unique(rides, ["gender", "bike_id", "ride_id"])


def test_copies(spark):
    df = spark.createDataFrame([("a", 1), ("a", 1), ("a", 2), (None, 1), (None, 1), ("b", 9)], "k string, v int")
    assert rows(quality.rows_without_copy(df)) == [("a", 2), ("b", 9)]
    assert rows(quality.rows_with_copies(df, ["k"])) == [("a", 1), ("a", 1), ("a", 2), (None, 1), (None, 1)]
    assert rows(quality.repeated_keys(df, ["k"], at_least=3)) == [("a", 3)]
    assert rows(quality.frequency_of_frequencies(df, "k")) == [(1, 1), (2, 1), (3, 1)]
    old = spark.createDataFrame([("a", 1), ("c", 3)], "k string, v int")
    new = spark.createDataFrame([("a", 1), ("d", 4)], "k string, v int")
    assert rows(quality.unique_across(old, new, ["k", "v"])) == [("c", 3), ("d", 4)]


def test_region_violations(rides_of):
    rides = rides_of({"start_station_id": "odd"}, {"end_station_id": "odd"})
    assert rows(quality.region_violations(rides)) == [("odd", 2, 0)]


def test_null_profile(rides_of):
    rides = rides_of({"gender": 0}, {"gender": None, "rideable_type": "unknown"}, {"rideable_type": None, "bike_id": None})
    profile = {r.column: r.n_missing for r in quality.null_profile(rides).collect()}
    assert (profile["gender"], profile["rideable_type"], profile["bike_id"], profile["ride_id"], profile["Length"]) == (1, 1, 1, 0, 3)
    diff = {r.column: (r.missing_old, r.missing_new) for r in quality.null_profile_diff(rides.drop("bike_id"), rides_of({})).collect()}
    assert diff == {"gender": (1, 0), "rideable_type": (1, 0), "bike_id": (3, 0), "Length": (3, 1)}


def two(spark):
    old = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3), (None, 0)], "k string, v long")
    new = spark.createDataFrame([("a", 3), ("c", 1), (None, 5)], "k string, v long")
    return old, new


def test_comparisons(spark):
    old, new = two(spark)
    assert rows(compare.key_status(old, new, ["k"])) == [("a", 2, 1, "both"), ("b", 1, 0, "lost"), ("c", 0, 1, "added"), (None, 1, 1, "both")]
    assert rows(compare.added_keys(old, new, ["k"])) == [("c",)]
    assert rows(compare.lost_keys(old, new, ["k"])) == [("b",)]
    assert rows(compare.common_keys(old, new, ["k"])) == [("a",), (None,)]
    assert rows(compare.set_statistics(old, new, ["k"])) == [(4, 3, 1, 1, 2)]
    assert rows(compare.set_statistics(old.limit(0), new.limit(0), ["k"])) == [(0, 0, 0, 0, 0)]
    # The old side has "a" twice: it has no one value there.
    assert rows(compare.mismatches(old, new, ["k"], ["v"])) == [("a", 2, 1, None, 3), (None, 1, 1, 0, 5)]
    assert rows(compare.snapshot_diff(old, new, ["k"], ["v"]).select("k", "v_old", "v_new")) == [("a", None, 3), ("b", 3, None), ("c", None, 1), (None, 0, 5)]


def filed(rides_of, *changes):
    """Rides that share start and stop, each from the file named by its ride id."""
    return rides_of(*changes).withColumn("file", F.col("ride_id"))


def merged(df, **options):
    return [(r.ride_id, r.birth_year, r.gender, r.bike_id) for r in reconcile.merge_duplicates(df, **options).collect()]


def test_merge_keeps_the_later_row(rides_of):
    blank = {"birth_year": None, "gender": 0, "bike_id": None}
    assert merged(filed(rides_of, {"ride_id": "201912"}, {"ride_id": "202001", "gender": 2})) == [("202001", 1980, 2, 7)]
    assert merged(filed(rides_of, {"ride_id": "202001", **blank}, {"ride_id": "201912"})) == [("202001", 1980, 1, 7)]
    # The three attributes come from one row: a later row with any of them keeps its own.
    assert merged(filed(rides_of, {"ride_id": "201912"}, {"ride_id": "202001", **blank, "gender": 2})) == [("202001", None, 2, None)]
    assert merged(filed(rides_of, {"ride_id": "201912", **blank}, {"ride_id": "202001", **blank})) == [("202001", None, 0, None)]
    assert merged(filed(rides_of, {})) == [("r1", 1980, 1, 7)]


def test_merge_of_more_than_two(rides_of):
    three = filed(rides_of, {"ride_id": "a"}, {"ride_id": "b"}, {"ride_id": "c"})
    assert sorted(merged(three)) == [("a", 1980, 1, 7), ("b", 1980, 1, 7), ("c", 1980, 1, 7)]
    # Copies of one ride in three files are one ride; rows without a key are no group.
    assert merged(three.withColumn("ride_id", F.lit("same"))) == [("same", 1980, 1, 7)]
    assert len(merged(three.withColumn("stop_time", F.lit(None).cast("timestamp_ntz")))) == 3
    assert [r.n_rows for r in reconcile.merge_violations(three).collect()] == [3]
    with pytest.raises(Exception, match="more than two rides"):
        merged(three, strict=True)


def test_duplicate_provenance(rides_of):
    df = filed(rides_of, {"ride_id": "201912.parquet"}, {"ride_id": "202001.parquet"}, {"ride_id": "x", "stop_time": "2020-02-02 00:00:00"})
    assert rows(reconcile.duplicate_provenance(df)) == [("201912:1 202001:1", 1)]


def test_backfill(spark, rides_of):
    new = rides_of(
        {"ride_id": "filled", "birth_year": None, "gender": 0, "bike_id": None},
        {"ride_id": "kept", "stop_time": "2020-02-01 01:00:00"},
        {"ride_id": "unmatched", "stop_time": "2020-02-01 02:00:00", "birth_year": None, "gender": 0, "bike_id": None},
        {"ride_id": "genderless", "stop_time": "2020-02-01 01:00:00", "gender": None, "birth_year": 1},
    )
    old = spark.createDataFrame(
        [(r.start_time, r.stop_time, g, y, b) for r, g, y, b in zip(new.limit(2).collect(), "FU", [1970, 1971], ["123.0", "5"], strict=True)],
        "start_time timestamp_ntz, stop_time timestamp_ntz, gender string, birth_year int, bike_id string",
    )
    out = {r.ride_id: (r.birth_year, r.gender, r.bike_id) for r in reconcile.backfill(new, old).collect()}
    assert out == {"filled": (1970, 2, 123), "kept": (1980, 1, 7), "unmatched": (None, 0, None), "genderless": (1, 0, 7)}
    assert reconcile.backfill(new, old.unionByName(old), strict=False).count() == 4
    with pytest.raises(Exception, match="repeats a start and stop"):
        reconcile.backfill(new, old.unionByName(old)).collect()
    stats = {r.column: (r.missing_before, r.missing_after, r.filled, r.ratio) for r in reconcile.backfill_statistics(reconcile.backfill(new, old, keep_before=True)).collect()}
    assert stats == {"birth_year": (2, 1, 1, 0.5), "gender": (3, 2, 1, 1 / 3), "bike_id": (2, 1, 1, 0.5)}


def test_consolidate(rides_of):
    blank = {"birth_year": None, "gender": 0, "bike_id": None}
    slices = add_slice_columns(
        rides_of(
            {"ride_id": "new", **blank},
            {"ride_id": "old-era", "start_time": "2019-05-01 00:00:00", "stop_time": "2019-05-01 00:01:00"},
            {"ride_id": "old-era", "start_time": "2019-05-01 00:00:00", "stop_time": "2019-05-01 00:01:00"},
            {"ride_id": "bad", "start_time": "2013-07-01 00:00:00", "stop_time": "2013-07-01 00:10:34"},
        )
    ).withColumns({"src_ym": F.when(F.col("ride_id") == "bad", 201306).otherwise(F.col("start_ym")), "file": F.col("ride_id")})
    copies = slices.unionByName(slices.where("ride_id = 'new'").withColumns({"src_ym": F.lit(201912), "file": F.lit("a")}))
    older = add_slice_columns(rides_of({"ride_id": "v0"}))
    out = {r.ride_id: (r.gender, r.bike_id) for r in reconcile.consolidate(copies, older).collect()}
    assert out == {"new": (1, 7), "old-era": (1, 7)}
    assert reconcile.consolidate(copies).count() == 2
    assert reconcile.exclude_slices(copies, []).count() == 5


def test_consolidate_loses_only_copies(rides_of):
    """Rows in = rows out + the merged pair's other row + the exact copies."""
    slices = add_slice_columns(
        rides_of(
            {"ride_id": "unread", "stop_time": None},
            *[{"ride_id": f"triple-{i}", "start_time": "2020-01-05 00:00:00", "stop_time": "2020-01-05 00:01:00"} for i in range(3)],
            {"ride_id": "pair-a", "start_time": "2020-01-06 00:00:00", "stop_time": "2020-01-06 00:01:00"},
            {"ride_id": "pair-b", "start_time": "2020-01-06 00:00:00", "stop_time": "2020-01-06 00:01:00"},
            {"ride_id": "late", "start_time": "2023-01-06 00:00:00", "stop_time": "2023-01-06 00:01:00"},
            {"ride_id": "late", "start_time": "2023-01-06 00:00:00", "stop_time": "2023-01-06 00:01:00"},
        )
    ).withColumn("file", F.col("ride_id"))
    older = add_slice_columns(rides_of({"ride_id": "v0"}))
    kept = ["late", "pair-b", "triple-0", "triple-1", "triple-2", "unread"]
    assert sorted(r.ride_id for r in reconcile.consolidate(slices, older).collect()) == kept
    assert reconcile.consolidate(slices, older, check_unique=True).count() == len(kept)
    with pytest.raises(Exception, match="more than two rides"):
        reconcile.consolidate(slices, older, strict=True).collect()
    same_id = slices.withColumn("ride_id", F.when(F.col("ride_id").startswith("triple"), "t").otherwise(F.col("ride_id"))).withColumn("birth_year", F.pmod(F.hash("file"), F.lit(1000)))
    with pytest.raises(AssertionError, match="1 keys with 3 rows"):
        reconcile.consolidate(same_id, older, check_unique=True)


def test_time_key_is_the_snapshot_key():
    assert TIME_KEY == ["start_time", "stop_time"]
