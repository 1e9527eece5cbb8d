"""Ride aggregates, cubes, histograms and counts."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tripweave.functions import codes, temporal, text
from tripweave.operators import aggregate as agg
from tripweave.operators import quality
from tripweave.plans.prelude import DAY, DURATION, HOUR, MONTH, RIDES_AND_SECONDS, WEEKDAY, YEAR, keyed, with_prelude
from tripweave.plans.registry import query

CUBE_KEYS = {
    "region": "start_region",
    "start_year": YEAR,
    "start_month": MONTH,
    "gender": "gender",
    "user_type": "user_type",
    "rideable_type": "rideable_type",
}
CUBE_SQL = keyed(CUBE_KEYS, RIDES_AND_SECONDS)
DISPLAY_SQL = """SELECT start_year AS year, start_month AS month,
    CASE region WHEN 'HB' THEN 'HOB' ELSE region END AS region,
    CASE user_type WHEN 'Customer' THEN 'Daily' WHEN 'Subscriber' THEN 'Annual' END AS user_type,
    rideable_type, gender, count, duration FROM cube"""


@query("agg_ymrgtb_cd", with_prelude(CUBE_SQL))
def _(w):
    return agg.aggregate_rides(w.rides, "ymrgtb", "cd")


@query("agg_se_c", with_prelude(keyed({"start_station_id": "start_station_id", "end_station_id": "end_station_id"})))
def _(w):
    return agg.aggregate_rides(w.rides, "se", "c")


@query("agg_e_c", with_prelude(keyed({"end_station_id": "end_station_id"})))
def _(w):
    return agg.aggregate_rides(w.rides, "e", "c")


@query("agg_s_c", with_prelude(keyed({"start_station_id": "start_station_id"})))
def _(w):
    return agg.aggregate_rides(w.rides, "s", "c")


@query("agg_weekday_hour", with_prelude(keyed({"start_weekday": WEEKDAY, "start_hour": HOUR}, RIDES_AND_SECONDS)))
def _(w):
    return agg.aggregate_rides(w.rides, "wh", "cd")


@query("agg_day_cd", with_prelude(keyed({"start_year": YEAR, "start_month": MONTH, "start_day": DAY}, RIDES_AND_SECONDS)))
def _(w):
    return agg.aggregate_rides(w.rides, "ymd", "cd")


@query(
    "agg_duration_only",
    with_prelude(keyed({"start_year": YEAR, "user_type": "user_type"}, f"CAST(sum({DURATION}) AS BIGINT) AS duration")),
)
def _(w):
    return agg.aggregate_rides(w.rides, "yt", "d")


@query(
    "agg_total_duration",
    with_prelude(
        keyed(
            {"start_year": YEAR},
            "CAST(count(*) AS BIGINT) AS count, CAST(sum(date_diff('microsecond', start_time, stop_time) // 1000000) AS BIGINT) AS duration",
        )
    ),
)
def _(w):
    return agg.aggregate_rides(w.rides, "y", "cd", duration_mode="total")


@query("agg_month_region_gender_weekday", with_prelude(keyed({"region": "start_region", "start_year": YEAR, "start_month": MONTH, "start_weekday": WEEKDAY, "gender": "gender"})))
def _(w):
    return agg.aggregate_rides(w.rides, "ymrgw", "c")


@query("agg_station_names", with_prelude(keyed({"start_station_name": "start_station_name", "end_station_name": "end_station_name"}, RIDES_AND_SECONDS)))
def _(w):
    return agg.aggregate_rides(w.rides, "nN", "cd")


@query(
    "agg_positions",
    with_prelude(keyed({"start_lat": "start_lat", "start_lng": "start_lng", "end_lat": "end_lat", "end_lng": "end_lng"})),
)
def _(w):
    return agg.aggregate_rides(w.rides, "lL", "c")


@query(
    "aggregate_rollup",
    with_prelude(
        "SELECT region, start_year, CAST(sum(count) AS BIGINT) AS count, CAST(sum(duration) AS BIGINT) AS duration FROM cube GROUP BY region, start_year",
        cube=CUBE_SQL,
    ),
)
def _(w):
    return agg.reaggregate(w.cube, ["region", "start_year"])


@query(
    "aggregate_month_merge",
    with_prelude(keyed({"start_station_id": "start_station_id", "end_station_id": "end_station_id"})),
)
def _(w):
    by_month = agg.aggregate_rides(w.rides, "se", "c", by=["end_ym"])
    return agg.reaggregate(by_month, ["start_station_id", "end_station_id"])


@query("cube_relabel", with_prelude(DISPLAY_SQL, cube=CUBE_SQL))
def _(w):
    return agg.cube_display(agg.ride_cube(w.rides))


@query("cube_by_storage_month", with_prelude(keyed({"end_ym": "end_ym", **CUBE_KEYS}, RIDES_AND_SECONDS)))
def _(w):
    return agg.ride_cube(w.rides, by_storage_month=True)


@query(
    "cube_short_codes",
    with_prelude(
        """SELECT year - 2000 AS y, month AS m,
        CASE region WHEN 'NYC' THEN 0 WHEN 'JC' THEN 1 WHEN 'HOB' THEN 2 END AS r,
        CASE user_type WHEN 'Annual' THEN 0 WHEN 'Daily' THEN 1 END AS t,
        CASE rideable_type WHEN 'classic_bike' THEN 0 WHEN 'docked_bike' THEN 1 WHEN 'electric_bike' THEN 2 WHEN 'unknown' THEN 3 END AS b,
        gender AS g, count AS c, duration AS d FROM display""",
        cube=CUBE_SQL,
        display=DISPLAY_SQL,
    ),
)
def _(w):
    return agg.cube_short(agg.cube_display(w.cube))


@query(
    "cube_sorted",
    with_prelude(
        """SELECT *, CAST(row_number() OVER (PARTITION BY year, month, region
          ORDER BY CASE user_type WHEN 'Annual' THEN 0 ELSE 1 END,
            CASE rideable_type WHEN 'unknown' THEN 0 WHEN 'classic_bike' THEN 1 ELSE 2 END, gender) AS INT) AS position
        FROM display""",
        cube=CUBE_SQL,
        display=DISPLAY_SQL,
    ),
)
def _(w):
    display = agg.cube_display(w.cube)
    order = Window.partitionBy("year", "month", "region").orderBy(*agg.cube_order())
    return display.withColumn("position", F.row_number().over(order)).orderBy(*agg.cube_order())


@query(
    "value_counts",
    with_prelude("SELECT user_type, rideable_type, CAST(count(*) AS BIGINT) AS n FROM rides GROUP BY 1, 2"),
)
def _(w):
    return quality.value_counts(w.rides, "user_type", "rideable_type")


@query(
    "freq_of_freq",
    with_prelude(
        "SELECT n, CAST(count(*) AS BIGINT) AS n_values FROM times GROUP BY n",
        times="SELECT start_time, stop_time, CAST(count(*) AS BIGINT) AS n FROM rides GROUP BY 1, 2",
    ),
)
def _(w):
    return quality.frequency_of_frequencies(w.rides, "start_time", "stop_time")


@query(
    "repeated_keys",
    with_prelude("SELECT start_station_id, start_time, CAST(count(*) AS BIGINT) AS dupes FROM rides GROUP BY 1, 2 HAVING count(*) > 1"),
)
def _(w):
    return quality.repeated_keys(w.rides, ["start_station_id", "start_time"])


HIST_SQL = f"SELECT CAST(({DURATION}) // 10 * 10 AS BIGINT) AS bucket, CAST(count(*) AS BIGINT) AS n_rides FROM rides GROUP BY 1"


@query("duration_hist", with_prelude(HIST_SQL))
def _(w):
    return agg.duration_histogram(w.rides, 10)


@query("duration_hist_head", with_prelude("SELECT * FROM hist ORDER BY bucket LIMIT 100", hist=HIST_SQL))
def _(w):
    return agg.duration_histogram(w.rides, 10, n=100)


@query("duration_peak", with_prelude("SELECT * FROM hist ORDER BY n_rides DESC, bucket LIMIT 1", hist=HIST_SQL))
def _(w):
    return agg.histogram_peak(agg.duration_histogram(w.rides, 10))


@query(
    "duration_labels",
    with_prelude(
        """SELECT bucket, n_rides, CASE WHEN bucket = 0 THEN '0s' ELSE
          CASE WHEN bucket // 3600 % 24 > 0 THEN CAST(bucket // 3600 % 24 AS VARCHAR) || 'h' ELSE '' END ||
          CASE WHEN bucket // 60 % 60 > 0 THEN CAST(bucket // 60 % 60 AS VARCHAR) || 'm' ELSE '' END ||
          CASE WHEN bucket % 60 > 0 THEN CAST(bucket % 60 AS VARCHAR) || 's' ELSE '' END END AS label FROM hist""",
        hist=HIST_SQL,
    ),
)
def _(w):
    return agg.duration_histogram(w.rides, 10).withColumn("label", temporal.duration_label("bucket"))


@query(
    "region_matrix",
    with_prelude(
        """SELECT start_region, nullif(CAST(count(*) FILTER (end_region = 'NYC') AS BIGINT), 0) AS "NYC",
        nullif(CAST(count(*) FILTER (end_region = 'JC') AS BIGINT), 0) AS "JC",
        nullif(CAST(count(*) FILTER (end_region = 'HB') AS BIGINT), 0) AS "HB"
        FROM rides WHERE start_region IS NOT NULL AND end_region IS NOT NULL GROUP BY 1"""
    ),
)
def _(w):
    return agg.region_matrix(w.rides, ["NYC", "JC", "HB"])


def _pct_sql(column: str, by: str) -> tuple[str, str]:
    groups = f"{YEAR} AS year, {MONTH} AS month" + (", start_region AS region" if by else "")
    rest = "start_region IS NOT NULL AND " if by else ""
    names = ", year, month" + (", region" if by else "")
    inner = f"SELECT {groups}, {column} AS k FROM rides WHERE {rest}{column} IS NOT NULL"
    return inner, names.lstrip(", ")


_G_SQL, _G_KEYS = _pct_sql("CASE gender WHEN 0 THEN 'U' WHEN 1 THEN 'M' WHEN 2 THEN 'F' END", "")
_T_SQL, _T_KEYS = _pct_sql("user_type", "region")


def _wide_pct(keys: str, values: list[str]) -> str:
    counts = ", ".join(f"CAST(count(*) FILTER (k = '{v}') AS BIGINT) AS n_{v}" for v in values)
    return f"SELECT {keys}, count(*) AS total, {counts} FROM k GROUP BY ALL"


def _pct_columns(keys: str, values: list[str]) -> str:
    shares = ", ".join(f'nullif(n_{v}, 0) AS "{v}", round(nullif(n_{v}, 0) / total * 100, 1) AS "{v}_pct"' for v in values)
    return f"SELECT {keys}, {shares} FROM wide"


@query("category_pct", with_prelude(_pct_columns(_G_KEYS, ["U", "M", "F"]), k=_G_SQL, wide=_wide_pct(_G_KEYS, ["U", "M", "F"])))
def _(w):
    letters = codes.lookup(F.col("gender"), codes.GENDER_LETTERS)
    return agg.category_percentages(w.rides, letters, ["U", "M", "F"])


@query(
    "category_pct_by_region",
    with_prelude(_pct_columns(_T_KEYS, ["Subscriber", "Customer"]), k=_T_SQL, wide=_wide_pct(_T_KEYS, ["Subscriber", "Customer"])),
)
def _(w):
    return agg.category_percentages(w.rides, F.col("user_type"), ["Subscriber", "Customer"], by_region=True)


DOCKINGS_SQL = """SELECT start_station_id AS station_id, start_station_name AS station_name, start_lat AS lat, start_lng AS lng,
    start_time AS time, true AS is_start FROM rides
  UNION ALL SELECT end_station_id, end_station_name, end_lat, end_lng, stop_time, false FROM rides"""


@query(
    "dockings_unpivot",
    with_prelude(
        """SELECT station_id, is_start, CAST(isodow(time) - 1 AS INT) AS weekday, CAST(hour(time) AS INT) AS hour, CAST(count(*) AS BIGINT) AS n
        FROM dockings GROUP BY 1, 2, 3, 4""",
        dockings=DOCKINGS_SQL,
    ),
)
def _(w):
    return agg.dockings(w.rides).groupBy("station_id", "is_start", "weekday", "hour").agg(F.count("*").alias("n"))


STATION_NAME_SQL = """SELECT id, name FROM (
    SELECT station_id AS id, station_name AS name,
      row_number() OVER (PARTITION BY station_id ORDER BY count(*) DESC, station_name) AS rn
    FROM dockings WHERE station_id IS NOT NULL AND station_name IS NOT NULL GROUP BY 1, 2) WHERE rn = 1"""


@query(
    "station_daily_avg",
    with_prelude(
        """SELECT station_id, name AS station_name, CAST(count(*) AS BIGINT) AS n,
          count(*) / (SELECT count(*) FROM range(DATE '1995-01-01', DATE '2001-09-01', INTERVAL 1 DAY) r(d) WHERE isodow(d) < 6) AS avg
        FROM dockings JOIN names ON station_id = id
        WHERE time >= DATE '1995-01-01' AND time < DATE '2001-09-01' AND isodow(time) < 6 AND regexp_matches(station_id, '^(?:JC|HB)') GROUP BY 1, 2""",
        dockings=DOCKINGS_SQL,
        names=STATION_NAME_SQL,
    ),
)
def _(w):
    return agg.station_counts(w.rides, w.stations, "1995-01-01", "2001-08-31", nj=True, weekdays=True)


@query(
    "station_month_avg",
    with_prelude(
        """SELECT station_id, name AS station_name, CAST(count(*) AS BIGINT) AS n, count(*) / 31 AS avg FROM dockings JOIN names ON station_id = id
        WHERE time >= TIMESTAMP '1996-01-01 00:00:00' AND time < TIMESTAMP '1996-02-01 00:00:00' GROUP BY 1, 2""",
        dockings=DOCKINGS_SQL,
        names=STATION_NAME_SQL,
    ),
)
def _(w):
    """One month strictly inside the data."""
    return agg.station_counts(w.rides, w.stations, "1996-01-01", "1996-01-31")


@query(
    "station_daily_avg_outside_nj",
    with_prelude(
        """SELECT station_id, name AS station_name, CAST(count(*) AS BIGINT) AS n,
          count(*) / (SELECT count(*) FROM range(DATE '1995-01-01', DATE '2001-09-01', INTERVAL 1 DAY) r(d) WHERE isodow(d) IN (1, 6)) AS avg
        FROM dockings JOIN names ON station_id = id
        WHERE time >= DATE '1995-01-01' AND time < DATE '2001-09-01' AND isodow(time) IN (1, 6) AND NOT regexp_matches(station_id, '^(?:JC|HB)') GROUP BY 1, 2""",
        dockings=DOCKINGS_SQL,
        names=STATION_NAME_SQL,
    ),
)
def _(w):
    return agg.station_counts(w.rides, w.stations, "1995-01-01", "2001-08-31", nj=False, weekdays=[0, 5])


@query(
    "station_day_counts",
    with_prelude(
        """SELECT station_id, name AS station_name, CAST(day(time) AS INT) AS day, CAST(isodow(time) - 1 AS INT) AS weekday,
          CAST(count(*) AS BIGINT) AS n, CASE WHEN isodow(time) < 6 THEN 'Weekday' ELSE 'Weekend' END AS day_class
        FROM dockings JOIN names ON station_id = id WHERE time >= DATE '1995-01-01' AND time < DATE '2001-09-01'
          AND regexp_matches(station_id, '^(?:JC|HB)') GROUP BY 1, 2, 3, 4, 6""",
        dockings=DOCKINGS_SQL,
        names=STATION_NAME_SQL,
    ),
)
def _(w):
    counts = agg.station_counts(w.rides, w.stations, "1995-01-01", "2001-08-31", keys=["day", "weekday"], nj=True)
    return counts.withColumn("day_class", temporal.day_class("weekday"))


@query(
    "topk_stations",
    with_prelude(
        """SELECT station_id, CAST(count(*) AS BIGINT) AS n FROM dockings WHERE station_id IS NOT NULL
        GROUP BY 1 ORDER BY n DESC, station_id LIMIT 5""",
        dockings=DOCKINGS_SQL,
    ),
)
def _(w):
    counts = agg.dockings(w.rides).where(F.col("station_id").isNotNull()).groupBy("station_id").agg(F.count("*").alias("n"))
    return agg.top_k(counts, "n", 5, ["station_id"])


@query(
    "topk_station_days",
    with_prelude(
        """SELECT station_id, CAST(time AS DATE) AS date, CAST(count(*) AS BIGINT) AS n FROM dockings
        WHERE regexp_matches(station_id, '^JC') GROUP BY 1, 2 ORDER BY n DESC, station_id, date LIMIT 50""",
        dockings=DOCKINGS_SQL,
    ),
)
def _(w):
    events = agg.dockings(w.rides).where(text.starts_with_pattern(F.col("station_id"), "JC"))
    counts = events.groupBy("station_id", F.col("time").cast("date").alias("date")).agg(F.count("*").alias("n"))
    return agg.top_k(counts, "n", 50, ["station_id", "date"])


@query(
    "same_station_share",
    with_prelude(
        """SELECT strftime(start_time, '%Y-%m') AS month, CAST(count(*) FILTER (start_station_name = end_station_name) AS BIGINT) AS same,
        CAST(count(*) AS BIGINT) AS total, count(*) FILTER (start_station_name = end_station_name) / count(*) AS share FROM rides GROUP BY 1"""
    ),
)
def _(w):
    return agg.same_station_share(w.rides)


@query(
    "station_coverage",
    with_prelude("SELECT CAST(count(DISTINCT start_station_id) AS BIGINT) AS n_start, CAST(count(DISTINCT end_station_id) AS BIGINT) AS n_end FROM rides"),
)
def _(w):
    return agg.station_coverage(w.rides)


@query(
    "region_exclusion",
    with_prelude(
        """SELECT start_region, start_station_id, end_station_id, CAST(count(*) AS BIGINT) AS n FROM rides
        WHERE start_region IS DISTINCT FROM 'NYC' AND rideable_type IS DISTINCT FROM 'electric_bike' GROUP BY 1, 2, 3"""
    ),
)
def _(w):
    kept = w.rides.where(text.not_equal_or_null(F.col("start_region"), "NYC") & text.not_equal_or_null(F.col("rideable_type"), "electric_bike"))
    return kept.groupBy("start_region", "start_station_id", "end_station_id").agg(F.count("*").alias("n"))


@query(
    "station_id_prefix",
    with_prelude(
        """SELECT regexp_extract(start_station_id, '^(JC|HB)\\d+', 1) AS prefix, CAST(count(*) AS BIGINT) AS n FROM rides
        WHERE start_station_id IS NOT NULL GROUP BY 1"""
    ),
)
def _(w):
    prefixed = w.rides.where(F.col("start_station_id").isNotNull()).select(text.id_prefix(F.col("start_station_id")).alias("prefix"))
    return prefixed.groupBy("prefix").agg(F.count("*").alias("n"))


@query("incremental_months", with_prelude(keyed({"region": "start_region", "start_year": YEAR, "start_month": MONTH, "start_weekday": WEEKDAY, "gender": "gender"})))
def _(w):
    def build(rides):
        return agg.aggregate_rides(rides, "ymrgw", "c")

    stored = build(w.rides.where(F.col("end_ym") <= 199812))
    return agg.append_new_months(stored, w.rides, build, through=199812)
