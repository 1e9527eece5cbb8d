import random
from functools import reduce

import pytest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tests.conftest import rows
from tripweave.operators import reconcile
from tripweave.operators.normalize import add_slice_columns
from tripweave.streaming import ingest
from tripweave.streaming.ingest import read_ride_stream
from tripweave.streaming.merge import read_merged, store_merged


def drain(frame, name, mode="append"):
    query = frame.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return frame.sparkSession.table(name)


def test_refresh_end_months(spark, rides_of, tmp_path):
    source, table, checkpoint = (str(tmp_path / n) for n in ("in", "table", "check"))
    batch = add_slice_columns(rides_of({}, {"stop_time": "2020-01-31 23:59:00"}))
    batch.write.parquet(source)

    def run():
        stream = ingest.read_ride_stream(spark, source, batch.schema, max_files=1)
        ingest.refresh_end_months(stream, table, checkpoint).awaitTermination()
        return spark.read.parquet(table)

    assert rows(run().select(*batch.columns)) == rows(batch)
    # A later publication repeats a ride and adds one to an old month.
    late = add_slice_columns(rides_of({}, {"ride_id": "late"}))
    late.write.mode("append").parquet(source)
    assert rows(run().groupBy("end_ym").count()) == [(202001, 1), (202002, 2)]


def test_copies_and_daily_counts(spark, rides_of, tmp_path):
    source = str(tmp_path / "in")
    day = {"start_time": "2020-01-01 10:00:00", "stop_time": "2020-01-01 10:05:00"}
    rides_of(day, {**day, "ride_id": "r2"}, day).coalesce(1).write.parquet(source)
    rides_of(day, {"start_time": "2020-06-01 00:00:00", "stop_time": "2020-06-01 00:05:00"}).coalesce(1).write.mode("append").parquet(source)
    schema = spark.read.parquet(source).schema
    unique = ingest.first_publication(ingest.read_ride_stream(spark, source, schema))
    assert drain(unique, "unique_rides").count() == 3
    daily = ingest.daily_counts(ingest.read_ride_stream(spark, source, schema))
    # The last day stays open until the watermark passes it.
    assert [(str(r.day), r.region, r.n) for r in drain(daily, "daily").collect()] == [("2020-01-01", "NYC", 4)]


@pytest.fixture(autouse=True)
def utc(spark):
    assert spark.range(1).select(F.current_timezone()).first()[0] == "UTC"


def publications(rides_of):
    """Rides published once, twice and more often, with and without attributes, in three files, some without a stop time."""
    empty = {"birth_year": None, "gender": 0, "bike_id": None}
    second = {"start_time": "2020-01-31 23:51:00"}
    third = {"start_time": "2020-01-31 23:52:00"}
    rides = [
        ({}, "a"), ({**empty, "ride_id": "r2"}, "b"),
        (second, "c"), ({**second, **empty}, "a"),
        ({**third, "ride_id": "x"}, "a"), ({**third, "ride_id": "x"}, "c"), ({**third, "ride_id": "y", "start_lat": 40.123456789}, "b"),
        ({"start_time": "2020-01-31 23:53:00", "start_station_name": 'a "b", é|c', **empty}, "b"),
        ({"start_time": "2020-01-31 23:54:00", "gender": None}, "b"), ({"start_time": "2020-01-31 23:54:00", "gender": 2, "birth_year": 1}, "b"),
        ({"stop_time": None}, "a"), ({"stop_time": None}, "a"),
    ]
    return [(rides_of(r).withColumn("file", F.lit(f))) for r, f in rides]


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_merged_across_any_batches(spark, rides_of, tmp_path, seed):
    """Files in any order, one or several a batch, with a restart in between: the same rides as one batch gives."""
    rng, rides = random.Random(seed), publications(rides_of)
    rng.shuffle(rides)
    folder, table, checkpoint = (str(tmp_path / n) for n in ("in", "out", "checkpoint"))
    parts, batches = [rides[i::4] for i in range(4)], 0
    for k, part in enumerate(parts):
        reduce(DataFrame.unionByName, part).coalesce(1).write.mode("append").parquet(folder)
        if k in (1, 3):
            stream = read_ride_stream(spark, folder, rides[0].schema, max_files=1 + seed % 2)
            query = store_merged(stream, table, checkpoint)
            query.awaitTermination()
            batches += len([p for p in query.recentProgress if p["numInputRows"]])
    assert batches >= 2
    wanted = reconcile.merge_duplicates(reduce(DataFrame.unionByName, rides))
    assert rows(read_merged(spark, table).select(*wanted.columns)) == rows(wanted)


def test_state_goes_when_no_copy_can_come(spark, rides_of, tmp_path):
    """A ride of a year later moves the watermark; the timers of the earlier rides clear their state."""
    folder, table, checkpoint = (str(tmp_path / n) for n in ("in", "out", "checkpoint"))
    later = {"start_time": "2021-03-01 00:00:00", "stop_time": "2021-03-01 00:10:00"}
    for k, r in enumerate(({}, later, {**later, "start_time": "2021-03-01 00:01:00"})):
        rides_of(r).withColumn("file", F.lit(str(k))).coalesce(1).write.mode("append").parquet(folder)
        query = store_merged(read_ride_stream(spark, folder, spark.read.parquet(folder).schema), table, checkpoint, late_by="1 days")
        query.awaitTermination()
    state = [s["numRowsTotal"] for p in query.recentProgress for s in p["stateOperators"]]
    assert read_merged(spark, table).count() == 3 and state[-1] <= 2 * 2
