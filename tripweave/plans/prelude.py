"""SQL that derives the trip tables from the base tables; every SQL twin starts with it."""

from __future__ import annotations

from tripweave.sources.fixture import BEGIN, RAW_COLUMNS

# Written out here on purpose: a wrong pattern in the library then shows as a difference.
_REGION_TESTS = r"""CASE
  WHEN ID IS NULL OR ID = 'None' THEN 'None'
  WHEN regexp_matches(ID, '^[0-9]{4}\.[0-9][0-9]') OR regexp_matches(ID, '^[0-9]{1,3}') THEN 'NYC'
  WHEN starts_with(ID, 'S 5th St & Kent Ave') OR starts_with(ID, 'MTL-ECO51-1') OR starts_with(ID, 'MTL-ECO5-LAB') OR starts_with(ID, 'Shop Morgan') THEN 'NYC'
  WHEN regexp_matches(ID, '^JC[0-9]{3}') OR starts_with(ID, 'Liberty State Park') THEN 'JC'
  WHEN regexp_matches(ID, '^HB[0-9]{3}') THEN 'HB'
  WHEN regexp_matches(ID, '^SYSY?[0-9]{3}') OR starts_with(ID, 'Lab - NYC') OR starts_with(ID, 'JCSYS') OR starts_with(ID, 'X-MTL-AOS-5.1') THEN 'SYS'
  END"""


def region_sql(station_id: str) -> str:
    return _REGION_TESTS.replace("ID", station_id)


_RAW = ",\n  ".join(f'{e} AS "{n}"' for n, e in RAW_COLUMNS.items())

PRELUDE = f"""src AS (
  SELECT *, o_custkey % 40 AS ks, l_suppkey % 40 AS ke, {BEGIN} AS t0
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
raw AS (
  SELECT {_RAW}
  FROM src),
coded AS (
  SELECT ride_id, started_at AS start_time, ended_at AS stop_time,
    start_station_id, start_station_name, start_lat, start_lng, {region_sql("start_station_id")} AS start_region,
    end_station_id, end_station_name, end_lat, end_lng, {region_sql("end_station_id")} AS end_region,
    CASE WHEN rideable_type = 'docked_bike' THEN 'classic_bike'
         WHEN rideable_type IN ('unknown', 'classic_bike', 'electric_bike') THEN rideable_type END AS rideable_type,
    CASE member_casual WHEN 'member' THEN 'Subscriber' WHEN 'casual' THEN 'Customer' END AS user_type,
    gender, "birth year" AS birth_year, bikeid AS bike_id, file
  FROM raw),
normalized AS (
  SELECT * FROM coded
  WHERE coalesce(start_region, '') NOT IN ('None', 'SYS') AND coalesce(end_region, '') NOT IN ('None', 'SYS')),
rides AS (
  SELECT DISTINCT *, CAST(year(start_time) * 100 + month(start_time) AS INT) AS start_ym,
    CAST(year(stop_time) * 100 + month(stop_time) AS INT) AS end_ym
  FROM normalized)"""

# Pieces that many twins share.
YEAR = "CAST(year(start_time) AS INT)"
MONTH = "CAST(month(start_time) AS INT)"
DAY = "CAST(day(start_time) AS INT)"
WEEKDAY = "CAST(isodow(start_time) - 1 AS INT)"
HOUR = "CAST(hour(start_time) AS INT)"
_MICROS = "date_diff('microsecond', start_time, stop_time)"
DURATION = f"((({_MICROS}) % 86400000000 + 86400000000) % 86400000000) // 1000000"
RIDES_AND_SECONDS = f"CAST(count(*) AS BIGINT) AS count, CAST(sum({DURATION}) AS BIGINT) AS duration"


def with_prelude(body: str, **tables: str) -> str:
    """``body`` over the prelude and further named tables."""
    named = "".join(f",\n{name} AS (\n{sql}\n)" for name, sql in tables.items())
    return f"WITH {PRELUDE}{named}\n{body}"


def keyed(keys: dict[str, str], measures: str = "CAST(count(*) AS BIGINT) AS count", source: str = "rides") -> str:
    """Null-dropping aggregate over named key expressions."""
    columns = ", ".join(f"{e} AS {n}" for n, e in keys.items())
    groups = ", ".join(str(i + 1) for i in range(len(keys)))
    known = " AND ".join(f"{e} IS NOT NULL" for e in keys.values())
    return f"SELECT {columns}, {measures} FROM {source} WHERE {known} GROUP BY {groups}"
