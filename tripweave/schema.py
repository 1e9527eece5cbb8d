"""Column names, types and key letters shared by every operator."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tripweave.functions import temporal

# The normalised ride row, in output order.
RIDE_TYPES = {
    "ride_id": T.StringType(),
    "start_time": T.TimestampNTZType(),
    "stop_time": T.TimestampNTZType(),
    "start_station_id": T.StringType(),
    "start_station_name": T.StringType(),
    "start_lat": T.DoubleType(),
    "start_lng": T.DoubleType(),
    "start_region": T.StringType(),
    "end_station_id": T.StringType(),
    "end_station_name": T.StringType(),
    "end_lat": T.DoubleType(),
    "end_lng": T.DoubleType(),
    "end_region": T.StringType(),
    "rideable_type": T.StringType(),
    "user_type": T.StringType(),
    "gender": T.IntegerType(),
    "birth_year": T.IntegerType(),
    "bike_id": T.IntegerType(),
}
RIDE_COLUMNS = list(RIDE_TYPES)
RIDE_SCHEMA = T.StructType([T.StructField(n, t, True) for n, t in RIDE_TYPES.items()])

#: Exact start and stop identify a ride across snapshots.
TIME_KEY = ["start_time", "stop_time"]
#: Attributes that later snapshots of the same month may have lost.
BACKFILL_COLUMNS = ["birth_year", "gender", "bike_id"]
#: Storage layout of normalised slices.
SLICE_COLUMNS = ["src_ym", "start_ym", "end_ym"]


@dataclass(frozen=True)
class Key:
    """One letter of a group-by specification and the columns it stands for.

    Columns are made when they are used: a registry of finished columns would cost a call to the JVM each.
    """

    letter: str
    name: str
    columns: tuple[tuple[str, Callable[[], Column]], ...]


def _own(*names: str) -> tuple[tuple[str, Callable[[], Column]], ...]:
    """Key columns that are ride columns."""
    return tuple((n, lambda n=n: F.col(n)) for n in names)


# Group-by letters of a ride aggregate, in output column order. Rides belong to the region and the calendar
# month they start in.
RIDE_KEYS = [
    Key("r", "region", (("region", lambda: F.col("start_region")),)),
    Key("y", "year", (("start_year", lambda: F.year("start_time")),)),
    Key("m", "month", (("start_month", lambda: F.month("start_time")),)),
    Key("d", "day", (("start_day", lambda: F.dayofmonth("start_time")),)),
    Key("w", "weekday", (("start_weekday", lambda: F.weekday("start_time")),)),
    Key("h", "hour", (("start_hour", lambda: F.hour("start_time")),)),
    Key("g", "gender", _own("gender")),
    Key("t", "user_type", _own("user_type")),
    Key("b", "rideable_type", _own("rideable_type")),
    Key("s", "start_station", _own("start_station_id")),
    Key("e", "end_station", _own("end_station_id")),
    Key("n", "start_name", _own("start_station_name")),
    Key("N", "end_name", _own("end_station_name")),
    Key("l", "start_position", _own("start_lat", "start_lng")),
    Key("L", "end_position", _own("end_lat", "end_lng")),
]

#: Measures of a ride aggregate: letter -> column name.
RIDE_MEASURES = {"c": "count", "d": "duration"}


def measure_value(letter: str, duration_mode: str = "component") -> Column:
    """What one ride adds to a measure."""
    if letter == "c":
        return F.lit(1).cast("long")
    return temporal.duration_seconds("start_time", "stop_time", duration_mode)


def select_keys(letters: str, registry: list[Key]) -> list[Key]:
    """Keys named by ``letters``, in registry order whatever the letter order."""
    known = {k.letter for k in registry}
    unknown = sorted(set(letters) - known)
    if unknown:
        raise ValueError(f"unknown group-by letters {unknown}; choose from {sorted(known)}")
    return [k for k in registry if k.letter in letters]


def key_columns(letters: str) -> list[str]:
    """Output column names of a ride aggregate for ``letters``."""
    return [name for k in select_keys(letters, RIDE_KEYS) for name, _ in k.columns]


def aggregate_label(letters: str, measures: str) -> str:
    """Storage name of an aggregate, such as ``ymrgtb_cd``."""
    # Label order of the letters.
    order = "ymdwhrgtbsenNlL"
    select_keys(letters, RIDE_KEYS)
    return "".join(c for c in order if c in letters) + "_" + "".join(c for c in "cd" if c in measures)
