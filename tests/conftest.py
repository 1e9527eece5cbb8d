import os
import sys
from datetime import datetime

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tripweave.schema import RIDE_COLUMNS, RIDE_SCHEMA
from tripweave.session import build_session


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    os.environ.setdefault("TRIPWEAVE_DRIVER_MEMORY", "6g")
    session = build_session("tests", master="local[8]", shuffle_partitions=4, settings={"spark.sql.warehouse.dir": str(tmp_path_factory.mktemp("warehouse"))})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def at(text: str) -> datetime:
    return datetime.fromisoformat(text)


RIDE = {
    "ride_id": "r1",
    "start_time": at("2020-01-31 23:50:00"),
    "stop_time": at("2020-02-01 00:10:00"),
    "start_station_id": "4001.01",
    "start_station_name": "A",
    "start_lat": 40.7,
    "start_lng": -74.0,
    "start_region": "NYC",
    "end_station_id": "JC001",
    "end_station_name": "B",
    "end_lat": 40.8,
    "end_lng": -74.1,
    "end_region": "JC",
    "rideable_type": "classic_bike",
    "user_type": "Subscriber",
    "gender": 1,
    "birth_year": 1980,
    "bike_id": 7,
}


def ride(**changes) -> tuple:
    row = {**RIDE, **{k: at(v) if k in ("start_time", "stop_time") and isinstance(v, str) else v for k, v in changes.items()}}
    return tuple(row[c] for c in RIDE_COLUMNS)


@pytest.fixture(scope="session")
def rides_of(spark):
    """Frame of rides, each given as the changes to a default ride."""

    def build(*changes):
        return spark.createDataFrame([ride(**c) for c in changes], RIDE_SCHEMA)

    return build


def rows(df) -> list[tuple]:
    return sorted((tuple(r) for r in df.collect()), key=lambda r: tuple((v is None, str(v)) for v in r))
