"""Plan-time header work: canonical names, dropped and missing columns, sort columns, schema differences."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripweave.schema import RIDE_COLUMNS

# Published display name -> our column.
DISPLAY_NAMES = {
    "Ride ID": "ride_id",
    "Start Time": "start_time",
    "Stop Time": "stop_time",
    "Start Station ID": "start_station_id",
    "Start Station Name": "start_station_name",
    "Start Station Latitude": "start_lat",
    "Start Station Longitude": "start_lng",
    "Start Region": "start_region",
    "End Station ID": "end_station_id",
    "End Station Name": "end_station_name",
    "End Station Latitude": "end_lat",
    "End Station Longitude": "end_lng",
    "End Region": "end_region",
    "Rideable Type": "rideable_type",
    "User Type": "user_type",
    "Gender": "gender",
    "Birth Year": "birth_year",
    "Bike ID": "bike_id",
}
# Snake-case headers of the third era that are not our own names already.
THIRD_ERA_NAMES = {
    "started_at": "start_time",
    "ended_at": "stop_time",
    "member_casual": "member_casual",
}
# Columns that carry nothing.
DROPPED = ["Unnamed: 0", "rideable_type_duplicate_column_name_1", "Trip Duration", "tripduration"]
# Per header era, the columns a raw file is sorted by.
SORT_COLUMNS = [
    ["Start Time", "starttime", "started_at"],
    ["Stop Time", "stoptime", "ended_at"],
    ["Bike ID", "bikeid", "ride_id"],
]


def squash(header: str) -> str:
    """Lower case without whitespace and slashes."""
    return re.sub(r"[\s/]", "", header.lower())


_CANONICAL = {squash(display): name for display, name in DISPLAY_NAMES.items()}
_CANONICAL |= {name: name for name in RIDE_COLUMNS} | THIRD_ERA_NAMES


def canonical_name(header: str) -> str | None:
    """Our column for a published header, or None if it is not a known one."""
    return _CANONICAL.get(squash(header.strip('"﻿')))


def unexpected_headers(headers: Iterable[str]) -> list[str]:
    """Headers that are neither known nor on the drop list."""
    return [h for h in headers if canonical_name(h) is None and h not in DROPPED]


def harmonize_columns(df: DataFrame, keep: Iterable[str] = ()) -> DataFrame:
    """Rename to canonical names, drop known ballast, leave ``keep`` columns as they are.

    Columns that nobody knows are left out; ``unexpected_headers(df.columns)`` names them.
    """
    keep = list(keep)
    named = {h: canonical_name(h) for h in df.columns if h not in keep and h not in DROPPED}
    chosen = {h: n for h, n in named.items() if n}
    doubled = sorted({n for n in chosen.values() if list(chosen.values()).count(n) > 1})
    if doubled:
        raise ValueError(f"more than one header for {doubled}")
    if "member_casual" in chosen.values() and "user_type" in chosen.values():
        raise ValueError("a file has either a user type or a member/casual column, not both")
    return df.select(*[F.col(f"`{h}`").alias(n) for h, n in chosen.items()], *keep)


def sort_columns(columns: Iterable[str]) -> list[str]:
    """Start, stop and id column of a raw file, whatever its header era."""
    columns = list(columns)
    found = []
    for choices in SORT_COLUMNS:
        present = [c for c in choices if c in columns]
        if len(present) != 1:
            raise ValueError(f"expected exactly one of {choices}, found {present}")
        found += present
    return found


def column_diff(old: DataFrame, new: DataFrame) -> dict[str, list[str]]:
    """Columns added, removed and shared between two schemas."""
    before, after = old.columns, new.columns
    return {
        "added": [c for c in after if c not in before],
        "removed": [c for c in before if c not in after],
        "both": [c for c in after if c in before],
    }


def expected_columns(year_month: int) -> list[str]:
    """Columns that the source of a month can fill.

    Ride ids begin in 2020-01; bike ids and birth years end with 2021-01.
    """
    missing: list[str] = []
    if year_month < 202001:
        missing = ["ride_id"]
    elif year_month >= 202102:
        missing = ["bike_id", "birth_year"]
    return [c for c in RIDE_COLUMNS if c not in missing]


def column_presence(df: DataFrame, year_month: int) -> dict[str, list[str]]:
    """Extra and missing columns of a month against what its era provides."""
    expected = expected_columns(year_month)
    return {
        "extra": [c for c in df.columns if c not in expected],
        "missing": [c for c in expected if c not in df.columns],
    }
